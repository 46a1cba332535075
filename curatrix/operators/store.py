"""Writing to the catalog: upserts that keep first-seen times and history, and update-only changes.

Plain tables have no row-level merge, so an upsert is a full outer join; the caller writes the result to
a new path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HISTORY = 20
#: Parts in which the last events of a key are chosen first.
PARTS = 64


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], once: list[str] = ()) -> DataFrame:
    """``existing`` with ``incoming`` rows replaced or added by key; ``once`` columns stay as first written.

    Both sides hold a key once. A column ``outcome`` says insert, update or keep."""
    values = [c for c in existing.columns if c not in keys]
    e = existing.withColumn("_e", F.lit(True)).select(*keys, "_e", *[F.col(c).alias(f"_e_{c}") for c in values])
    i = incoming.withColumn("_i", F.lit(True)).select(*keys, "_i", *[F.col(c).alias(f"_i_{c}") for c in values])
    both = e.join(i, keys, "full_outer")
    new = F.col("_i").isNotNull()

    def value(c: str) -> Column:
        if c in once:
            return F.coalesce(f"_e_{c}", f"_i_{c}")
        return F.when(new, F.col(f"_i_{c}")).otherwise(F.col(f"_e_{c}"))

    outcome = F.when(F.col("_e").isNull(), "insert").when(new, "update").otherwise("keep")
    return both.select(*keys, *[value(c).alias(c) for c in values], outcome.alias("outcome"))


def update_only(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``existing`` with ``columns`` changed where a change has the key; nothing is added."""
    c = changes.select(*keys, *[F.col(x).alias(f"_new_{x}") for x in columns])
    return existing.join(c, keys, "left").select(*[F.coalesce(f"_new_{x}", x).alias(x) if x in columns else F.col(x) for x in existing.columns])


def merge_history(old: Column, new: Column, cap: int = HISTORY) -> Column:
    """Old events, then new ones; the last ``cap`` of them."""
    both = F.concat(F.coalesce(old, F.slice(new, 1, 0)), new)
    return F.slice(both, F.greatest(F.size(both) - cap + 1, F.lit(1)), cap)


def provenance(events: DataFrame, key: str, order: list[str], event: Column, cap: int = HISTORY) -> DataFrame:
    """Per key: count, first and last event, and the last ``cap`` events in order.

    The last ones are chosen in two steps, first inside each of many parts of a key, so a key with a third
    of all events is not ranked by one task, and an array never outgrows the cap."""
    x = events.select(key, F.struct(*order, event.alias("event")).alias("e"))
    x = x.withColumn("part", F.pmod(F.xxhash64("e"), F.lit(PARTS)))
    near = x.withColumn("back", F.row_number().over(Window.partitionBy(key, "part").orderBy(F.col("e").desc()))).where(F.col("back") <= cap)
    last = near.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.col("e").desc()))).where(F.col("back") <= cap)
    last = last.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("history"))
    total = x.groupBy(key).agg(F.count("*").alias("n"), F.min("e")["event"].alias("first"), F.max("e")["event"].alias("last"))
    return total.join(last, key).select(key, "n", "first", "last", F.transform("history", lambda e: e["event"]).alias("history"))
