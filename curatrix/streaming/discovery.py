"""Discovery events as a stream: windowed counts with late data, and upserts of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and ``by``; works on batch and stream. In a stream, events later than ``late`` are left out.

    ``time`` may be a timestamp without zone, which streams refuse: it is read as UTC session time."""
    x = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    return x.groupBy(F.window("_time", size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def upsert_each_batch(write: Callable[[DataFrame, int], None], keys: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the latest row per key of a micro-batch goes to ``write``, with the batch id, so
    that a batch that runs twice can be told."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
        write(latest, batch_id)

    return run
