from collections import Counter, defaultdict

from curatrix.llm import mixing
from tests.llm import cases


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


def plain_targets(sizes):
    """Reshare what exceeds three times a source until no target does."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        left = total - sum(out.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    return out


def check(rows):
    groups = by_source(rows)
    sizes = {s: sum(r.size for r in g) for s, g in groups.items()}
    want = plain_targets(sizes)
    for s, g in groups.items():
        assert {r.source_size for r in g} == {sizes[s]}
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in g)
        assert all(0 <= r.taken <= 3 * r.size for r in g)
        assert abs(sum(r.taken for r in g) - want[s]) <= 0.5 + 1e-6
        full = [r.taken // r.size for r in g if r.size > 4 * mixing.BLOCK]
        assert not full or max(full) - min(full) <= 1  # no second pass before the first has ended


def test_documents(spark, small):
    first = mixing.op1_low_discrepancy_mix(spark, small).collect()
    assert len(first) == len(cases.texts(small))
    check(first)
    assert Counter(first) == Counter(mixing.op1_low_discrepancy_mix(spark, small).repartition(3).collect())


def test_edge_rows(spark):
    rows = mixing.mix(cases.docs(spark)).collect()
    assert len(rows) == len(cases.ROWS)
    check(rows)
    assert mixing.mix(cases.docs(spark, [])).count() == 0
    assert [r.target for r in mixing.mix(cases.docs(spark, [(1, "", "en", "a"), (2, None, "en", None)])).collect()] == [0.0, 0.0]


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate([("a", 5), ("a", 7), ("b", 90), ("c", 130), ("c", 70), ("d", 1), ("e", 2000), (None, 3)])]
    out = mixing.mix(cases.docs(spark, rows)).collect()
    check(out)
    assert {r.doc_id for r in out if r.taken} == {r.doc_id for r in out}


def test_prefixes_of_the_schedule_keep_the_shares(spark):
    rows = spark.createDataFrame([("a", 400_000), ("b", 90_000), (None, 60_000)], "source string, size long")
    sources = mixing.targets(rows)
    target = {r.sid: r.target for r in sources.collect()}
    slots = [r.sid for r in mixing.schedule(sources).orderBy("t").collect()]
    total = sum(target.values())
    for n in (200, 1000, len(slots) // 2):
        seen = Counter(slots[:n])
        for sid, t in target.items():
            assert abs(seen[sid] / n - t / total) < 0.03
