import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from curatrix.llm import common, simhash
from tests.llm import cases


def plain_fingerprint(text, width=3):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_match_the_definition(small):
    for _, text in cases.texts(small)[:60] + [(0, ""), (0, "A b"), (0, None), (0, "x"), (0, "É Ça VA")]:
        assert simhash.fingerprint_of(text) == plain_fingerprint(text)


def test_operator_against_brute_force(spark, small):
    got = {r.doc_id: r for r in simhash.op10_simhash_pigeonring(spark, small).collect()}
    fps = {d: plain_fingerprint(t) for d, t in cases.texts(small)}
    want = cases.components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", want[d]) for d in fps}


def test_no_link_is_lost_in_crowded_and_ordinary_buckets(spark):
    rng = random.Random(3)
    fps = {0}
    for size in (300, 40, 5):  # a group of near copies, far over the pairwise bound, and small ones
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    for _ in range(200):  # pairs at distance 2 exactly
        x = rng.getrandbits(64)
        a, b = rng.sample(range(64), 2)
        fps |= {x, x ^ 1 << a ^ 1 << b}
    signed = [simhash._signed(x) for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in common.components(edges, "a", "b").collect()}
    want = cases.components(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    assert {x: roots.get(x, x) for x in signed} == want
    assert all(((e.a ^ e.b) & (1 << 64) - 1).bit_count() <= 2 for e in edges.collect())


def test_edge_rows(spark):
    rows = simhash.near_duplicates(cases.docs(spark)).collect()
    assert len(rows) == len(cases.ROWS)
    empty = [r for r in rows if r.fp == 0]
    assert {r.component_id for r in empty} == {1} and len(empty) == 4
    assert {r.component_id for r in rows if r.doc_id == 5} == {5}
    assert simhash.near_duplicates(cases.docs(spark, [])).count() == 0


def test_keep_one_keeps_one_row_of_each_group(spark):
    docs = cases.docs(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(1, "")] == 1 and got[(5, "one")] == 1 and sum(got.values()) == 6
    assert simhash.keep_one(cases.docs(spark, [])).count() == 0


def test_keep_unlike_drops_edited_copies(spark):
    rng = random.Random(5)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def edited(base, n):
        out = list(base)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"x{rng.randrange(10**6)}"
        return out

    texts = [words(rng.randint(30, 200)) for _ in range(60)]
    texts += [edited(t, rng.randint(1, 6)) for t in texts]
    centre = words(300)  # a crowded group
    texts += [edited(centre, rng.randint(0, 4)) for _ in range(150)]
    texts = [" ".join(t) for t in texts] + ["a short text", "A short  text", "", None]
    sets = [simhash._set_of(t, 5).tolist() for t in texts]
    sets = [set(s) for s in sets]

    def alike(a, b):
        x, y = sets[a], sets[b]
        return x == y or 100 * len(x & y) >= 80 * len(x | y) > 0

    root = cases.components(range(len(texts)), alike)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    far = [i for i in range(60) if root[60 + i] == i and (plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[60 + i])).bit_count() > 2]
    assert len(far) > 5
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == set(root.values())


def test_keep_unlike_edge_rows(spark):
    docs = cases.docs(spark)
    kept = simhash.keep_unlike(docs)
    assert kept.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    assert got[(1, "")] == 1 and got[(5, "one")] == 1 and sum(got.values()) == 6
    assert simhash.keep_unlike(cases.docs(spark, [])).count() == 0


@pytest.mark.parametrize("pairwise", [6, 48, 400])
def test_links_through_leaves_of_different_hubs(spark, monkeypatch, pairwise):
    """Groups around centres that only their own edited copies link: no link may be lost, whatever the size of a band."""
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = random.Random(11)

    def edited(base, n):
        out = list(base)
        for i in rng.sample(range(0, len(out), 5), n):
            out[i] = f"x{rng.randrange(10**6)}"
        return out

    texts, centre = [], [f"w{rng.randrange(10**6)}" for _ in range(300)]
    for _ in range(7):
        texts += [centre] + [edited(centre, 2) for _ in range(20)]
        centre = edited(edited(centre, 5), 5)  # linked neither to the centre before it nor, mostly, to its copies ...
        texts.append(edited(texts[-21], 5))  # ... but through a text between
        texts.append([c if i % 2 else t for i, (c, t) in enumerate(zip(centre, texts[-22], strict=True))])
    sets = [set(simhash._set_of(" ".join(t), 5).tolist()) for t in texts]
    root = cases.components(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_unlike(docs).collect()} == set(root.values())


def test_the_pipelines_stage_links_by_fingerprint_too(spark):
    """The groups are those of both kinds of links together, also where one leads to the other."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    base = " ".join(words[:200])
    again = base + " " + base + " " + base  # nearly the shingles of ``base``, three times
    short = " ".join(words[:40] * 60 + words[200:215])  # one passage over and over: few different shingles
    tail = " ".join(words[:40] * 60 + words[300:315])
    edited = " ".join(words[:40] * 60 + words[300:314] + ["x"])
    texts = [base, again, short, tail, edited, "", None, " ".join(rng.sample(words, 100))]
    fps, sets = [plain_fingerprint(t) for t in texts], [set(simhash._set_of(t, 5).tolist()) for t in texts]

    def by_bits(a, b):
        return (fps[a] ^ fps[b]).bit_count() <= 2

    def by_sets(a, b):
        return sets[a] == sets[b] or 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0

    both = cases.components(range(len(texts)), lambda a, b: by_bits(a, b) or by_sets(a, b))
    assert set(both.values()) < set(cases.components(range(len(texts)), by_sets).values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == set(both.values())


def test_bands_of_texts_that_are_not_alike_take_few_rounds(spark, monkeypatch):
    """Each round is many jobs, whose records the driver keeps: what the first hub leaves of a band all become hubs at once."""
    monkeypatch.setattr(simhash, "PAIRWISE", 6)
    rounds, searches = [], []
    met, components = simhash._met, common.components
    monkeypatch.setattr(simhash, "_met", lambda *a: rounds.append(1) or met(*a))
    monkeypatch.setattr(common, "components", lambda *a: searches.append(1) or components(*a))
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[:112], *(f"x{rng.randrange(10**6)}" for _ in range(n % 7 + 12)), *base[112:]]) for n in range(70)]
    sets = [set(simhash._set_of(t, 5).tolist()) for t in texts]
    root = cases.components(range(len(texts)), lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_unlike(docs).collect()} == set(root.values())
    assert len(rounds) == 2 and len(searches) <= 2


@pytest.mark.parametrize("held", [1 << 20, 2000])
def test_hubs_that_are_alike_make_no_square_of_edges(spark, monkeypatch, held):
    """Also where the hubs are held in several turns."""
    monkeypatch.setattr(simhash, "HUB_BYTES", held)
    sets = spark.createDataFrame([(bytes([i]), list(range(30)) + [100 + i]) for i in range(40)] + [(b"z", [7])], "node binary, shingles array<long>").repartition(2)
    rest = spark.createDataFrame([(k, bytes([i])) for k in (5, 6) for i in range(40)] + [(5, b"z")], "key long, node binary")
    hubs = rest.where("key = 5").withColumnRenamed("node", "b").repartition(3)
    turns = 1 if held > 2000 else 8
    edges = simhash._met(rest, hubs, sets, 80).collect()
    assert len(edges) <= turns * 4 * 82
    assert {r.root for r in common.components(spark.createDataFrame(edges), "a", "b").collect()} == {bytes([0])}
    other = hubs.withColumn("key", F.lit(9).cast("long"))
    assert simhash._met(rest, other, sets, 80).count() == 0  # alike, but of no common band
