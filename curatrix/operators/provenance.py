"""Provenance as stored state: snapshots that keep every discovery's count, first and last time and the latest events.

A merge is a sum over discoveries: counts add up, the earliest and the latest value by order count, the last events stay. So the order in
which discoveries arrive does not matter, batches may be cut anywhere, and one key's discoveries are combined before they
meet. :func:`merge` does it for tables, :mod:`curatrix.streaming.provenance` for a stream, with equal results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.operators.graph import labelled
from curatrix.operators.store import HISTORY, PARTS, merge_history

#: What a snapshot says of its discovery; an event has the same, the first as ``source``. Fixed values.
FIELDS = ("source_repository", "discovery_method", "source_api", "harvest_query", "harvested_at", "pipeline_version")
EVENT_FIELDS = ("source", *FIELDS[1:])
EVENT = "struct<" + ",".join(f"{c}:string" for c in EVENT_FIELDS) + ">"
#: Further columns of a snapshot, and of the state.
OTHER = ("dedup_key",)
STATE = ("discovery_history", "discovery_count", "first_seen_at", "last_seen_at")


def events(now: str | None = None) -> Column:
    """The events of a snapshot: its history, or one derived from its fields where it has none, or none without a repository.

    A derived event without a time takes ``now``."""
    history = F.array_compact(F.coalesce(F.col("discovery_history").cast(f"array<{EVENT}>"), F.array().cast(f"array<{EVENT}>")))
    at = F.coalesce(F.nullif(F.col("harvested_at"), F.lit("")), F.lit(now).cast("string"))
    own = F.struct(*[(at if c == "harvested_at" else F.col(c)).cast("string").alias(e) for c, e in zip(FIELDS, EVENT_FIELDS, strict=True)])
    known = F.col("source_repository").isNotNull() & (F.col("source_repository") != "")
    return F.when(F.size(history) > 0, history).when(known, F.array(own)).otherwise(F.array().cast(f"array<{EVENT}>"))


def retargeted(incoming: DataFrame, source: str, source_id: str, to_source: str, to_id: str, now: str | None = None) -> DataFrame:
    """``incoming`` with its events in a column ``_events``, and its snapshot naming the record it goes to where that is another."""
    x = incoming.withColumn("_events", events(now))
    other = F.col(to_source).isNotNull() & ((F.col(to_source) != F.col(source)) | (F.col(to_id) != F.col(source_id)))
    return x.withColumns(
        {
            "source_repository": F.when(other, F.col(to_source)).otherwise(F.col("source_repository")),
            "dedup_key": F.when(other, F.concat_ws(":", to_source, to_id)).otherwise(F.col("dedup_key")),
        }
    )


def summary(incoming: DataFrame, keys: list[str], order: str, now: str | None = None, cap: int = HISTORY) -> DataFrame:
    """Per key, what its discoveries add: n, first, last, latest (the last ``cap`` events) and the last value of each field.

    The last events are chosen inside each of many parts of a key first, so no task ranks all events of one."""
    x = incoming if "_events" in incoming.columns else incoming.withColumn("_events", events(now))
    x = x.withColumn("_at", F.col(order))
    size = F.size("_events")
    first = F.coalesce(F.get("_events", F.lit(0))["harvested_at"], F.col("first_seen_at"))
    last = F.coalesce(F.get("_events", size - 1)["harvested_at"], F.col("last_seen_at"))
    total = x.groupBy(*keys).agg(
        F.sum(size).cast("long").alias("n"),
        F.min_by(first, F.when(first.isNotNull(), F.col("_at"))).alias("first"),
        F.max_by(last, F.when(last.isNotNull(), F.col("_at"))).alias("last"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_{c}") for c in (*FIELDS, *OTHER)],
    )
    # a row's own events beyond the cap can never be among the last
    e = x.select(*keys, "_at", F.posexplode("_events").alias("pos", "event"), size.alias("size")).where(F.col("pos") >= F.col("size") - cap)
    e = e.select(*keys, F.struct("_at", "pos", "event").alias("e")).withColumn("part", F.pmod(F.xxhash64("e"), F.lit(PARTS)))
    for by in ([*keys, "part"], keys):
        e = e.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("e._at").desc(), F.col("e.pos").desc()))).where(F.col("back") <= cap)
    latest = e.groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("latest"))
    return total.join(latest, keys, "left").withColumn("latest", F.transform("latest", lambda r: r["event"]))


def merge(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str, now: str | None = None, cap: int = HISTORY) -> DataFrame:
    """One row per key of ``stored`` (unique there) or ``incoming``: FIELDS, OTHER and STATE after all discoveries.

    A stored snapshot without history counts as one event, as does an incoming row without one; incoming fields win where they are not null, the
    last by ``order`` (unique for a key). The count is of all events, the history of the last ``cap``. Stored rows without
    discoveries stay as they are. Keys must not be null."""
    old = stored.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in (*FIELDS, *OTHER, *STATE)], events(now).alias("_old_events"))
    both = old.join(summary(incoming, keys, order, now, cap), keys, "full_outer")
    none = F.array().cast(f"array<{EVENT}>")
    known = F.coalesce("_old_events", none)
    new = F.col("n").isNotNull()
    value = {c: F.coalesce(f"_{c}", f"_old_{c}") for c in (*FIELDS, *OTHER)}
    before = F.coalesce(F.col("_old_discovery_count").cast("long"), F.size(known).cast("long"))
    state = {
        "discovery_history": F.when(new, merge_history(known, F.coalesce("latest", none), cap)).otherwise(F.col("_old_discovery_history").cast(f"array<{EVENT}>")),
        "discovery_count": F.when(new, before + F.col("n")).otherwise(F.col("_old_discovery_count").cast("long")),
        "first_seen_at": F.when(new, F.coalesce("_old_first_seen_at", F.get(known, F.lit(0))["harvested_at"], "first")).otherwise(F.col("_old_first_seen_at")),
        "last_seen_at": F.when(new, F.coalesce("last", "_old_last_seen_at", value["harvested_at"])).otherwise(F.col("_old_last_seen_at")),
    }
    return both.select(*keys, *[v.alias(c) for c, v in (value | state).items()])


def targets(existing: DataFrame, incoming: DataFrame, row: str, id: list[str], keys: list[str]) -> DataFrame:
    """(row, target, via) of incoming rows: the least ``id`` of the existing rows that share the first of ``keys`` that any shares.

    Null and empty keys are shared with none. Each key is reduced to one record first, and a key that very many rows have is
    met in several tasks."""

    def opened(df: DataFrame, *keep: Column) -> DataFrame:
        named = F.array(*[F.struct(F.lit(i).alias("rank"), F.col(k).cast("string").alias("v")) for i, k in enumerate(keys)])
        x = df.select(*keep, F.explode(F.filter(named, lambda n: n["v"].isNotNull() & (n["v"] != ""))).alias("k"))
        return x.withColumn("place", F.concat_ws(":", "k.rank", "k.v")).withColumn("rank", F.col("k.rank")).drop("k")

    held = opened(existing, F.struct(*id).alias("target")).groupBy("place").agg(F.min("target").alias("target"))
    found = labelled(opened(incoming, F.col(row)), held, "place", row).groupBy(row).agg(F.min(F.struct("rank", "target")).alias("best"))
    via = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("best.rank") + 1)
    return incoming.select(row).join(found, row, "left").select(row, F.col("best.target").alias("target"), F.when(F.col("best").isNotNull(), via).otherwise("new").alias("via"))


def upsert_discoveries(stored: DataFrame, incoming: DataFrame, order: str, payload: list[str], now: str, cap: int = HISTORY) -> DataFrame:
    """``stored`` records with ``incoming`` discoveries written to the record they belong to, or to one of their own.

    Both sides have source, source_id (not null), url_key, doi, ``payload`` and the columns of a snapshot; ``stored``
    also ingested_at, updated_at. A discovery belongs to the stored record with its url_key, else its doi, else its identity; its
    snapshot then names that record. The last discovery by ``order`` (unique) gives the payload and the keys, whatever is null
    in it; ingested_at stays as first written. ``outcome``: insert, update or keep."""
    identity = F.concat_ws(":", "source", "source_id")
    to = targets(stored.withColumn("identity", identity), incoming.withColumn("identity", identity), order, ["source", "source_id"], ["url_key", "doi", "identity"])
    x = incoming.join(to.select(order, F.col("target.source").alias("to_source"), F.col("target.source_id").alias("to_id")), order)
    x = retargeted(x, "source", "source_id", "to_source", "to_id", now)
    x = x.withColumns({"source": F.coalesce("to_source", "source"), "source_id": F.coalesce("to_id", "source_id")}).drop("to_source", "to_id")
    keys, columns = ["source", "source_id"], ["url_key", "doi", *payload]
    last = x.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("new"))
    old = stored.select(*keys, F.struct(*columns).alias("old"), F.lit(True).alias("was"), F.col("ingested_at").alias("_ingested"), F.col("updated_at").alias("_updated"))
    both = old.join(last, keys, "full_outer")
    new = F.col("new").isNotNull()
    out = both.select(
        *keys, *[F.when(new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in columns], F.when(F.col("was"), F.col("_ingested")).otherwise(F.lit(now)).alias("ingested_at"),
        F.when(new, F.lit(now)).otherwise(F.col("_updated")).alias("updated_at"), F.when(F.col("was").isNull(), "insert").when(new, "update").otherwise("keep").alias("outcome"),
    )
    return out.join(merge(stored, x, keys, order, now, cap), keys)
