import random

import pytest

from curatrix.operators import provenance as P
from curatrix.streaming import provenance as S

COLUMNS = (*P.FIELDS, *P.OTHER, *P.STATE)
ROW = ", ".join(f"{c} string" for c in (*P.FIELDS, *P.OTHER)) + f", discovery_history array<{P.EVENT}>, discovery_count long, first_seen_at string, last_seen_at string"
NOW = "2024-05-05T00:00:00"


def derived(p):
    if p.get("discovery_history"):
        return [dict(zip(P.EVENT_FIELDS, e, strict=True)) for e in p["discovery_history"] if e is not None]
    if not p.get("source_repository"):
        return []
    return [{"source": p["source_repository"], **{c: p[c] for c in P.FIELDS[1:]}, "harvested_at": p["harvested_at"] or NOW}]


def plain(existing, incoming):
    """One merge, field by field."""
    old, new = derived(existing), derived(incoming)
    out = {c: incoming[c] if incoming[c] is not None else existing.get(c) for c in (*P.FIELDS, *P.OTHER)}
    count = existing.get("discovery_count")
    out["discovery_history"] = [tuple(e[c] for c in P.EVENT_FIELDS) for e in (old + new)[-20:]]
    out["discovery_count"] = (len(old) if count is None else count) + len(new)
    out["first_seen_at"] = existing.get("first_seen_at") or (old[0]["harvested_at"] if old else None) or (new[0]["harvested_at"] if new else None) or incoming["first_seen_at"]
    out["last_seen_at"] = (new[-1]["harvested_at"] if new else None) or incoming["last_seen_at"] or existing.get("last_seen_at") or out["harvested_at"]
    return out


def snapshot(r, i):
    def maybe(p, v):
        return v if r.random() < p else None

    history = [(f"h{r.randrange(3)}", None, None, f"q{i}", f"2024-02-{k:02}", None) for k in range(1, r.randrange(2, 30))]
    return (
        maybe(0.7, f"repo{r.randrange(3)}"), maybe(0.5, "scan"), None, maybe(0.5, f"q{i}"), maybe(0.6, f"2024-03-{i % 28 + 1:02}"), maybe(0.3, f"v{i}"), maybe(0.3, f"k{i}"),
        maybe(0.2, history), None, maybe(0.2, f"2023-{i % 12 + 1:02}"), maybe(0.3, f"2025-{i % 12 + 1:02}"),
    )


@pytest.fixture(scope="module")
def case():
    r = random.Random(4)
    stored = {k: snapshot(r, k) for k in range(8)}
    stored = {k: (*v[:8], r.choice([None, 41]), *v[9:]) for k, v in stored.items()}
    incoming = [(r.randrange(12), 10 * n + 1, *snapshot(r, n)) for n in range(90)]
    state = {k: dict(zip(COLUMNS, v, strict=True)) for k, v in stored.items()}
    for key, _, *p in incoming:
        state[key] = plain(state.get(key, {}), dict(zip(COLUMNS, p, strict=True)))
    touched = {k for k, *_ in incoming}
    return stored, incoming, {k: tuple(v[c] for c in COLUMNS) for k, v in state.items()}, touched


def told(rows):
    return {r[0]: tuple([tuple(e) for e in v] if isinstance(v, list) else v for v in r[1:]) for r in rows}


def frames(spark, stored, incoming):
    s = spark.createDataFrame([(k, *v) for k, v in stored.items()], f"key long, {ROW}")
    return s, spark.createDataFrame(incoming, f"key long, seq long, {ROW}")


def test_batch_is_the_loop(spark, case):
    stored, incoming, want, _ = case
    s, x = frames(spark, stored, incoming)
    assert told(P.merge(s, x.repartition(3), ["key"], "seq", NOW).select("key", *COLUMNS).collect()) == want
    # in two batches as in one
    half = spark.createDataFrame(P.merge(s, x.where("seq < 400"), ["key"], "seq", NOW).collect(), f"key long, {ROW}")
    assert told(P.merge(half, x.where("seq >= 400"), ["key"], "seq", NOW).select("key", *COLUMNS).collect()) == want
    assert P.merge(s.limit(0), x.limit(0), ["key"], "seq", NOW).count() == 0


def test_stream_is_the_batch(spark, case, tmp_path):
    stored, incoming, want, touched = case
    s, x = frames(spark, stored, incoming)
    for i, part in enumerate((incoming[1::2], incoming[::2])):  # out of order across micro-batches
        spark.createDataFrame(part, x.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = S.stream(source, s, "key", "seq", NOW)
        q = out.writeStream.foreachBatch(lambda df, n: df.write.parquet(f"{tmp_path}/out/{n}")).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {}
    for n in range(2):
        got |= told(spark.read.parquet(f"{tmp_path}/out/{n}").select("key", *COLUMNS).collect())
    assert got == {k: want[k] for k in touched}


def test_discoveries_go_to_the_record_they_belong_to(spark):
    empty = (None,) * len(COLUMNS)
    record = "source string, source_id string, url_key string, doi string, title string"
    stored = spark.createDataFrame(
        [("a", "1", "u1", None, "old", "t0", "t0", *empty), ("a", "2", "u2", "10/x", "old", "t0", "t0", *empty), ("z", "9", None, "", "old", "t0", "t0", *empty)], f"{record}, ingested_at string, updated_at string, {ROW}"
    )

    def row(n, *key, repo="b"):
        return (n, *key, f"new{n}", repo, *empty[1:])

    incoming = spark.createDataFrame(
        [row(1, "b", "5", "u1", "10/x"), row(2, "b", "6", "u9", "10/x"), row(3, "b", "7", "u7", ""), row(4, "b", "7", "u7", None), row(5, "a", "2", "u2", None, repo="a")], f"seq long, {record}, {ROW}"
    )
    out = {(r.source, r.source_id): r for r in P.upsert_discoveries(stored, incoming, "seq", ["title"], NOW).collect()}
    assert set(out) == {("a", "1"), ("a", "2"), ("z", "9"), ("b", "7")}
    one, two, new = out["a", "1"], out["a", "2"], out["b", "7"]
    assert (one.title, one.outcome, one.ingested_at, one.updated_at, one.dedup_key, one.source_repository) == ("new1", "update", "t0", NOW, "a:1", "a")
    assert [e.source for e in one.discovery_history] == ["b"]  # the event tells where it came from
    assert (two.title, two.doi, two.discovery_count, [e.source for e in two.discovery_history]) == ("new5", None, 2, ["b", "a"])
    assert (new.outcome, new.title, new.discovery_count, new.ingested_at, new.dedup_key) == ("insert", "new4", 2, NOW, None)
    assert (out["z", "9"].outcome, out["z", "9"].updated_at) == ("keep", "t0")
