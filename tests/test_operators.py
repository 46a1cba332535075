"""Operators that depend on order or state, against plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curatrix.operators import catalog, dedup, graph, store
from curatrix.sources import tables
from curatrix.streaming import discovery


def plain_greedy(rows, percent=95):
    owner, accepted, out = {}, [], {}
    for r in sorted(rows, key=lambda r: (r["rank"], r["id"])):
        winner = next((owner[i, k] for i, k in enumerate(r["keys"]) if k is not None and (i, k) in owner), None)
        if winner is None and r["tokens"]:
            winner = next((o["id"] for o in accepted if o["source"] == r["source"] and 100 * len(set(o["tokens"]) & set(r["tokens"])) >= percent * len(set(o["tokens"]) | set(r["tokens"]))), None)
        if winner is None:
            accepted.append(r)
            for i, k in enumerate(r["keys"]):
                if k is not None:
                    owner.setdefault((i, k), r["id"])
        out[r["id"]] = winner
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_fold_is_the_scan(spark, seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(24)]
    rows = []
    for i in range(150):
        tokens = sorted(rng.sample(words, rng.choice([0, 2, 21, 22])))
        rows.append({"id": i, "rank": rng.randint(0, 60), "keys": [rng.choice([None, *range(70)]), rng.choice([None, *range(60)])], "tokens": tokens, "source": rng.choice("ab")})
    rows += [dict(rows[5], id=900 + i, rank=70) for i in range(30)]
    df = spark.createDataFrame([(r["id"], r["rank"], *[None if k is None else str(k) for k in r["keys"]], r["tokens"], r["source"]) for r in rows], "id long, rank long, a string, b string, tokens array<string>, source string")
    got = {r.id: r.winner for r in dedup.greedy(df, "id", "rank", ["a", "b"], "tokens", ["source"]).collect()}
    assert got == plain_greedy(rows)
    named = df.withColumn("id", F.format_string("r%04d", "id"))  # ids of any type
    again = {r.id: r.winner for r in dedup.greedy(named, "id", "rank", ["a", "b"], "tokens", ["source"]).collect()}
    assert again == {f"r{i:04d}": None if w is None else f"r{w:04d}" for i, w in got.items()}


def test_greedy_fold_of_documents(spark, small):
    """The registered query against the plain loop over the same rows."""
    from curatrix.plans import records

    got = {r.id: r.winner for r in records.q_dedup_greedy(spark, small).collect()}
    rows = []
    for r in tables.table(spark, small, "documents").collect():
        tokens = sorted(set(re.findall("[a-z0-9]+", r.text.split("\n")[0].lower())))
        rows.append({"id": r.doc_id, "rank": r.doc_id - r.n_chars * 1_000_000, "keys": [r.text, f"{r.source}|{r.text[:40]}"], "tokens": tokens, "source": r.source})
    assert got == plain_greedy(rows) and any(got.values())


def test_greedy_fold_edges(spark):
    schema = "id string, rank long, a string, tokens array<string>, source string"
    df = spark.createDataFrame([("x", 1, None, None, None), ("y", 1, "k", [], "s"), ("z", 2, "k", None, None)], schema)
    assert {r.id: r.winner for r in dedup.greedy(df, "id", "rank", ["a"], "tokens", ["source"]).collect()} == {"x": None, "y": None, "z": "y"}
    assert dedup.greedy(df.limit(0), "id", "rank", ["a"], "tokens", ["source"]).count() == 0
    chain = spark.createDataFrame([(f"c{i:03d}", i, str(i // 2), None, str((i + 1) // 2)) for i in range(40)], schema)
    got = {r.id: r.winner for r in dedup.greedy(chain, "id", "rank", ["a", "source"], "tokens", []).collect()}
    assert got == {f"c{i:03d}": None if i % 2 == 0 else f"c{i - 1:03d}" for i in range(40)}


def test_a_star_is_dealt_out(spark):
    n = 100_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    out = graph.components(star)
    assert out.count() == n and out.where("root != 0").isEmpty()
    # no task gets the hub's edges whole
    hub = spark.range(1, n).select(F.lit(0).alias("u"), F.col("id").alias("v"))
    one = graph.labelled(hub, spark.createDataFrame([(0, 7)], "u int, m int"), "u", "v")
    assert one.count() == n - 1 and one.where("m != 7").isEmpty()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 180), rng.randint(100, 180)) for _ in range(60)] + [(200, 201 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_titles_loses_no_pair(spark, percent):
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, rng.choice("ab"), rng.sample(words, rng.randint(1, 25))) for i in range(120)]
    base = rows[0][2]
    rows += [(200 + i, "a", sorted(set(base) - {base[i % len(base)]} | {f"x{i % 3}"})) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>")
    classes = dedup.title_classes(df, "id", "tokens", "block")
    got = {(r.a, r.b) for r in dedup.similar_titles(classes, percent).collect()}
    c = classes.collect()
    want = {(x.class_id, y.class_id) for x in c for y in c if x.class_id < y.class_id and x.block == y.block and 100 * len(set(x.tokens) & set(y.tokens)) >= percent * len(set(x.tokens) | set(y.tokens))}
    assert got == want and (want or percent == 95)


@pytest.mark.parametrize("common", [0, 5, 100_000])
def test_similar_rows_moves_the_tokens_of_pairs_only(spark, monkeypatch, common):
    """The token sets of all rows were shuffled and written before, each token as a row, several times."""
    monkeypatch.setattr(dedup, "COMMON", common)
    kept = {}
    real = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    rng = random.Random(common)
    words = [f"w{i}" for i in range(20_000)]
    rows = [(i, rng.choice("ab"), [*rng.sample(words, rng.randint(0, 60)), "the"]) for i in range(150)] + [(500, None, ["x"]), (501, "a", [])]
    base = words[:40]
    rows += [(200 + i, "ab"[i % 2], sorted({*base} - {base[i]} | {f"x{i % 3}"})) for i in range(0, 40, 7)] + [(300, "a", base), (301, "a", base), (302, None, base), (303, None, base[1:])]
    df = spark.createDataFrame(rows, "id long, block string, tokens array<string>")
    got = sorted(tuple(r) for r in dedup.similar_rows(df, "id", "tokens", "block", 90).collect())
    c = dedup.title_classes(df, "id", "tokens", "block").collect()

    def total(x, y):
        return len({*x.tokens} | {*y.tokens})

    alike = [(x, y, len({*x.tokens} & {*y.tokens})) for x in c for y in c if x.class_id < y.class_id and x.block is not None and x.block == y.block]
    want = sorted((x.class_id, y.class_id, n, total(x, y), x.n, y.n) for x, y, n in alike if 100 * n >= 90 * total(x, y))
    assert got == want and len(want) > 3
    assert [n for n, t in kept.items() if "tokens" in t.columns] == ["tokens"]
    assert kept["tokens"].count() < (40 if common else len(rows))


def test_resolve_respects_conflicts(spark):
    schema = "id long, doi string, url string, title string, author string, year int"
    old = spark.createDataFrame([(1, "10.1/a", "u1", "test", "x", 2001), (2, None, "u2", "test", "y", 2002), (3, None, "u3", "other", "z", 2003)], schema)
    new = spark.createDataFrame([(10, "10.1/a", None, "zzz", None, None), (11, "10.1/b", "u1", "test", "x", 2001), (12, "10.1/b", "u2", "q", None, None), (13, None, None, "test", "y", 2002), (14, None, None, "test", "q", 1), (15, None, None, None, None, None)], schema)
    got = {r.id: (r.target, r.via) for r in catalog.resolve(old, new, "id", ["doi", "url"], "title", ["author", "year"], conflict="doi").collect()}
    assert got == {10: (1, "doi"), 11: (None, "ambiguous"), 12: (2, "url"), 13: (2, "multi_field"), 14: (None, "ambiguous"), 15: (None, "new")}


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a", "t0"), (2, "b", "t0")], "k int, v string, at string")
    new = spark.createDataFrame([(2, None, "t1"), (3, "c", "t1")], "k int, v string, at string")
    once = store.upsert(old, new, ["k"], once=["at"])
    assert {tuple(r) for r in once.collect()} == {(1, "a", "t0", "keep"), (2, None, "t0", "update"), (3, "c", "t1", "insert")}
    twice = store.upsert(once.drop("outcome"), new, ["k"], once=["at"])
    assert {tuple(r)[:3] for r in twice.collect()} == {tuple(r)[:3] for r in once.collect()}
    assert {tuple(r) for r in store.update_only(old, new, ["k"], ["v"]).collect()} == {(1, "a", "t0"), (2, "b", "t0")}


def test_history_cap(spark):
    rows = [(u, i, f"e{i}") for u in range(3) for i in range(15 * (u + 1))]
    got = {r.u: r for r in store.provenance(spark.createDataFrame(rows, "u int, i int, e string"), "u", ["i"], F.col("e")).collect()}
    assert got[2].n == 45 and got[2].history == [f"e{i}" for i in range(25, 45)] and got[0].history == [f"e{i}" for i in range(15)]
    assert (got[1].first, got[1].last) == ("e0", "e29")
    df = spark.createDataFrame([([f"o{i}" for i in range(19)], ["n1", "n2"]), (None, ["n1"])], "o array<string>, n array<string>")
    assert [len(r[0]) for r in df.select(store.merge_history(F.col("o"), F.col("n"))).collect()] == [20, 1]


def test_census(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\nbroken\n')
    x = tables.census_lines(spark, str(tmp_path / "lines"), "id string, n int, _corrupt string")
    assert Counter(r.id for r in x.collect()) == Counter(["a", "b", None])
    assert tables.census_gate(x, "id", 3).first().verdict == "identity"
    assert tables.census_gate(x.where("id is not null"), "id", 3).first().verdict == "count"
    assert tables.census_gate(x.where("id is not null"), "id", 2, F.col("n") < 2).first().verdict == "unapproved"
    (tmp_path / "doc.json").write_text('{"datasets": [{"id": 1}, {"id": 2}]}')
    assert tables.census_document(spark, str(tmp_path / "doc.json")).count() == 2
    assert [r.payload is None for r in tables.landing_zone(spark, str(tmp_path / "lines")).collect()] == [False, False, True]


def test_stream_equals_batch(spark, tmp_path, small):
    events = tables.table(spark, small, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = discovery.windowed_counts(stream, "ts", "event_type", "1 day", "60 days").writeStream.format("memory").queryName("counts").outputMode("complete")
    run.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(120)
    want = Counter(tuple(r) for r in discovery.windowed_counts(events, "ts", "event_type", "1 day").collect())
    assert Counter(tuple(r) for r in spark.table("counts").collect()) == want


def test_upsert_stream(spark, tmp_path, small):
    events = tables.table(spark, small, "events")
    events.write.parquet(str(tmp_path / "in"))
    seen = {}
    fn = discovery.upsert_each_batch(lambda df, _: seen.update({r.user_id: r.event_id for r in df.collect()}), ["user_id"], "ts")
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(fn).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(120)
    want = {r.user_id: r.e for r in events.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("e")).collect()}
    assert seen == want


def test_nearest_vectors_of_chunks_and_blocks(spark, tmp_path, monkeypatch):
    """Ties after rounding go to the least id, across chunks; each pair of a chunk and a block is one row, not one per pair of vectors."""
    from curatrix.plans import records

    rng = random.Random(4)
    centre = [rng.gauss(0, 1) for _ in range(6)]
    vectors = [(i, [x + rng.gauss(0, 0.004) for x in centre] if i % 3 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(records, "CHUNK", 64)
    monkeypatch.setattr(records, "BLOCK", 3)
    calls = []
    real = records.written
    monkeypatch.setattr(records, "written", lambda df, name: calls.append((name, (out := real(df, name)).count())) or out)
    got = sorted(tuple(r) for r in records.q_cosine_topk(spark, str(tmp_path)).collect())
    rows = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(str(tmp_path / "embeddings.parquet")).collect()}

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    want = []
    for q in range(0, 400, 50):
        near = sorted((-round(dot(rows[q], v) / (dot(rows[q], rows[q]) ** 0.5 * dot(v, v) ** 0.5), 4), i) for i, v in rows.items() if i != q)[:5]
        want += [(q, r, i, -c) for r, (c, i) in enumerate(near)]
    assert got == sorted(want)
    assert dict(calls)["chunks"] == 7 and dict(calls)["blocks"] == 3


def test_shared_key_guard_counts_without_distinct_values(spark, small):
    """Parts of a supplier and order are rows already; a distinct count held them in one more table of the task."""
    from curatrix.plans import records

    plan = records.q_shared_key_guard(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(l_partkey" in plan and plan.count("HashAggregate") <= 2


def test_places_of_the_fold_take_16_bytes(spark):
    """Their names are most of what the fold shuffles and writes."""
    place = spark.range(3).select(dedup._place("k0", F.col("id")).alias("p"))
    assert place.schema["p"].dataType.typeName() == "binary"
    assert len({bytes(r.p) for r in place.collect()}) == 3 and all(len(r.p) == 16 for r in place.collect())
