import random

import pyarrow as pa
import pytest

from curatrix.operators import fold as K
from curatrix.plans import upserts

RECORDS = "id string, doi string, url string, title string, source_keys array<string>, repositories array<string>, authors array<string>, participants long, modality array<string>, year int"
SOURCES = "seq long, id string, repository string, source_key string, doi string, url string, refs array<string>, title string, authors array<string>, participants long, modality array<string>, year int, valid boolean"
R = [c.split()[0] for c in RECORDS.split(", ")]
S = [c.split()[0] for c in SOURCES.split(", ")]


def plain(records, sources):
    """The rule as a loop."""
    state = [dict(zip(R, r, strict=True)) | {"created": -1} for r in sorted(records)]
    out = []
    for s in sorted((dict(zip(S, s, strict=True)) for s in sources), key=lambda s: s["seq"]):
        def clash(r):
            return r["doi"] and s["doi"] and r["doi"] != s["doi"]

        def first(test):
            return next((r for r in state if test(r)), None)

        def signals(r):
            n = sum(bool(({*(r[c] or [])} & {*(s[c] or [])}) - {None}) for c in ("authors", "modality"))
            return n + sum(r[c] is not None and r[c] == s[c] for c in ("participants", "year"))

        ways = [("doi", first(lambda r: s["doi"] and r["doi"] == s["doi"]))]
        ways += [("cross_reference", first(lambda r: k in r["source_keys"])) for k in s["refs"] or []]
        ways += [("source_url", first(lambda r: s["url"] and r["url"] == s["url"])), ("source_key", first(lambda r: s["source_key"] in r["source_keys"]))]
        ways.append(("multi_field", first(lambda r: s["title"] and r["title"] == s["title"] and s["repository"] not in r["repositories"] and not clash(r) and signals(r) >= 2)))
        via, target = next(((w, r) for w, r in ways if r is not None and not clash(r)), (None, None))
        ambiguous = bool(s["title"]) and any(r["title"] == s["title"] and r is not target for r in state)
        if target is None and not s["valid"]:
            out.append((s["seq"], s["id"], "invalid", None, None, ambiguous))
            continue
        if target is None:
            state.append({**{c: s[c] for c in ("id", "doi", "url", "title", "participants", "year")}, "authors": list(s["authors"] or []), "modality": list(s["modality"] or []), "source_keys": [s["source_key"]], "repositories": [s["repository"]]})
            out.append((s["seq"], s["id"], "inserted", s["id"], "new", ambiguous))
            continue
        for c in ("doi", "participants", "year"):
            target[c] = s[c] if target[c] is None else target[c]
        for c, v in (("authors", s["authors"]), ("modality", s["modality"]), ("source_keys", [s["source_key"]]), ("repositories", [s["repository"]])):
            target[c] = [*(target[c] or []), *(x for x in v or [] if x not in (target[c] or []))]
        out.append((s["seq"], s["id"], "merged", target["id"], via, ambiguous))
    return out


def rows(seed, n_records, n, dense):
    r = random.Random(seed)

    def maybe(p, v):
        return v if r.random() < p else None

    def fields():
        return dict(doi=maybe(0.3, f"10/{r.randrange(dense)}"), url=maybe(0.4, f"u{r.randrange(2 * dense)}"), title=maybe(0.8, f"t{r.randrange(max(1, dense // 3))}"), authors=maybe(0.7, [f"a{r.randrange(3)}" for _ in range(r.randrange(3))]), participants=maybe(0.6, r.randrange(3)), modality=maybe(0.7, [r.choice(["eeg", "meg", None])]), year=maybe(0.6, 2000 + r.randrange(2)))

    records, used = [], set()
    for i in range(n_records):
        f = fields()
        if f["doi"] in used:
            f["doi"] = None
        used.add(f["doi"])
        records.append(tuple({**f, "id": f"r{i:03}", "source_keys": [f"x:{i}"], "repositories": ["x"]}[c] for c in R))
    sources = []
    for seq in range(n):
        repository = r.choice("wxyz")
        key = f"{repository}:{r.randrange(2 * dense)}"
        refs = maybe(0.2, [f"{r.choice('wxyz')}:{r.randrange(2 * dense)}" for _ in range(r.randrange(3))])
        sources.append(tuple({**fields(), "seq": seq * 3, "id": f"n{seq:03}", "repository": repository, "source_key": key, "refs": refs, "valid": r.random() < 0.9}[c] for c in S))
    return records, sources


@pytest.mark.parametrize(("seed", "n_records", "n", "dense"), [(1, 20, 300, 60), (2, 0, 200, 8), (3, 10, 60, 3)])
def test_short_rest(spark, seed, n_records, n, dense):
    records, sources = rows(seed, n_records, n, dense)
    got = K.fold(spark.createDataFrame(records, RECORDS), spark.createDataFrame(sources, SOURCES).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain(records, sources)


@pytest.mark.parametrize(("seed", "n_records", "n", "dense", "loop"), [(2, 0, 9, 4, 0)])
def test_rounds(spark, monkeypatch, seed, n_records, n, dense, loop):
    monkeypatch.setattr(K, "LOOP", loop)
    records, sources = rows(seed, n_records, n, dense)
    got = K.fold(spark.createDataFrame(records, RECORDS), spark.createDataFrame(sources, SOURCES).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain(records, sources)


def test_keys_that_an_earlier_source_brings(spark):
    def source(seq, repository, number, **f):
        return tuple({**dict.fromkeys(S), "seq": seq, "id": f"n{seq}", "repository": repository, "source_key": f"{repository}:{number}", "valid": True, **f}[c] for c in S)

    sources = [
        source(1, "a", 1, url="u", title="T"),
        source(2, "b", 1, url="u", doi="10/x"),  # brings a DOI
        source(3, "c", 1, doi="10/x", authors=["p"], year=2001),  # found by it, brings signals
        source(4, "d", 1, title="T", authors=["p"], year=2001),  # found by these
        source(5, "e", 1, refs=["d:1"], doi="10/y"),  # its DOI forbids it
        source(6, "f", 1, refs=["e:1", "d:1"]),
        source(7, "g", 1, title="T"),
    ]
    got = [tuple(r)[2:] for r in K.fold(spark.createDataFrame([], RECORDS), spark.createDataFrame(sources, SOURCES)).orderBy("seq").collect()]
    assert got == [
        ("inserted", "n1", "new", False),
        ("merged", "n1", "source_url", False),
        ("merged", "n1", "doi", False),
        ("merged", "n1", "multi_field", False),
        ("inserted", "n5", "new", False),
        ("merged", "n5", "cross_reference", False),
        ("inserted", "n7", "new", True),
    ]


def test_many_mirrors_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(K, "LOOP", 0)
    real = K._ready
    monkeypatch.setattr(K, "_ready", lambda *a: rounds.append(1) or real(*a))
    sources = [tuple({**dict.fromkeys(S), "seq": i, "id": f"n{i:04}", "repository": "a", "source_key": f"a:{i}", "doi": "10/x" if i % 2 else None, "url": None if i % 2 else "page", "title": "Test", "year": 2000, "modality": ["eeg"], "valid": True}[c] for c in S) for i in range(40)]
    got = K.fold(spark.createDataFrame([], RECORDS), spark.createDataFrame(sources, SOURCES)).collect()
    assert sorted(tuple(r) for r in got) == plain([], sources)
    assert len(rounds) <= 6
    assert K.fold(spark.createDataFrame([], RECORDS), spark.createDataFrame([], SOURCES)).count() == 0


def test_chains_take_slices_and_no_rounds(spark, monkeypatch):
    """Sources of many repositories that share title and signals depend on one another; each took a round before."""
    monkeypatch.setattr(K, "LOOP", 25)
    monkeypatch.setattr(K, "LOOP_RECORDS", 60)
    rounds = []
    real = K._ready
    monkeypatch.setattr(K, "_ready", lambda *a: rounds.append(1) or real(*a))
    records, sources = rows(5, 10, 70, 4)
    got = K.fold(spark.createDataFrame(records, RECORDS), spark.createDataFrame(sources, SOURCES).repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain(records, sources)
    assert not rounds


def test_slices_and_rounds_in_turn(spark, monkeypatch):
    """A round that comes between slices decides out of order; what follows must still count in order."""
    monkeypatch.setattr(K, "LOOP", 12)
    turns = []
    real = K._slice
    monkeypatch.setattr(K, "_slice", lambda *a: None if turns.append(1) or len(turns) == 2 else real(*a))
    records, sources = rows(9, 4, 40, 12)
    got = K.fold(spark.createDataFrame(records, RECORDS), spark.createDataFrame(sources, SOURCES)).collect()
    assert sorted(tuple(r) for r in got) == plain(records, sources)
    assert len(turns) > 2


def test_few_of_many_alike_records_go_along(spark, monkeypatch):
    """All 90 records share title and signals with the sources; they were too many for a slice before, and rounds followed."""
    monkeypatch.setattr(K, "LOOP", 8)
    monkeypatch.setattr(K, "LOOP_RECORDS", 40)
    rounds, near = [], []
    real_ready, real_near = K._ready, K._near
    monkeypatch.setattr(K, "_ready", lambda *a: rounds.append(1) or real_ready(*a))
    monkeypatch.setattr(K, "_near", lambda *a: near.append(real_near(*a)) or near[-1])
    alike = dict(title="Test", authors=["p"], year=2000, modality=["eeg"])
    records = [tuple({**dict.fromkeys(R), **alike, "id": f"r{i:03}", "source_keys": [f"x:{i}"], "repositories": ["x" if i % 3 else "a"], "doi": None if i % 4 else f"10/{i}"}[c] for c in R) for i in range(90)]
    sources = [tuple({**dict.fromkeys(S), **alike, "seq": i, "id": f"n{i:03}", "repository": "ab"[i % 2], "source_key": f"k:{i}", "doi": None if i % 3 else f"11/{i}", "valid": True}[c] for c in S) for i in range(12)]
    got = K.fold(spark.createDataFrame(records, RECORDS), spark.createDataFrame(sources, SOURCES)).collect()
    assert sorted(tuple(r) for r in got) == plain(records, sources)
    assert not rounds
    assert len(near) == 2


@pytest.mark.parametrize(("seed", "few"), [(1, 0), (2, 1), (3, 3)])
def test_loop_passes_over_records_once(monkeypatch, seed, few):
    """The plain loop, on places so full that those passed over are remembered; widened records enter among them."""
    monkeypatch.setattr(K._Places, "FEW", few)
    records, sources = rows(seed, 40, 300, 6)
    types = [("id", pa.string()), ("created", pa.int64()), ("doi", pa.string()), ("url", pa.string()), ("title", pa.string())]
    lists = [(c, pa.list_(pa.string())) for c in ("source_keys", "repositories", "authors", "modality")]
    state = pa.Table.from_pylist([dict(zip(R, r, strict=True)) | {"created": -1} for r in records], pa.schema([*types, *lists, ("participants", pa.int64()), ("year", pa.int32())]))
    out = K._loop(pa.Table.from_pylist([dict(zip(S, s, strict=True)) for s in sources]), state).to_pylist()
    wanted = [(seq, via, target) if action == "merged" else (seq, None, None) for seq, _, action, target, via, _ in plain(records, sources)]
    assert [(r["seq"], r["way"], r["target"]) for r in out if r["record"] is None] == wanted
    changed = {r["record"]["id"] for r in out if r["record"] is not None}
    assert changed == {target for *_, target, _, _ in plain(records, sources) if target is not None}


def test_records_query_in_slices(spark, monkeypatch, small):
    """q_canonical_records by small slices, each with few records, is as by one slice; slices took more records along before and so were more."""
    whole = {r.id: r for r in upserts.q_canonical_records(spark, small).collect()}
    slices, rounds = [], []
    real_slice, real_ready = K._slice, K._ready
    monkeypatch.setattr(K, "_slice", lambda *a: slices.append(1) or real_slice(*a))
    monkeypatch.setattr(K, "_ready", lambda *a: rounds.append(1) or real_ready(*a))
    monkeypatch.setattr(K, "LOOP", 60)
    monkeypatch.setattr(K, "LOOP_RECORDS", 25)
    assert {r.id: r for r in upserts.q_canonical_records(spark, small).collect()} == whole
    assert not rounds
    assert len(slices) == 3
