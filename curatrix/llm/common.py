"""What the corpus operators share: reading tables, text keys, and written intermediates and components from the library.

Every operator treats a null text as an empty one unless it says otherwise, never identifies a row
by ``doc_id`` alone (ids may be null or repeat) and reads only the columns it names, so extra
columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curatrix.operators.graph import components, labelled  # noqa: F401
from curatrix.operators.shared import forget, small, written  # noqa: F401

#: Rows in an Arrow batch: a batch of very long documents must still fit beside the executor's heap.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that a Python worker holds at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text: two hashes, the second seeded by the first value hashed."""
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores before it until no column of ``df`` is called so."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, in ``order`` inside a group), ``count`` (rows of the group) and ``group_no``
    (from 0, in the order of the groups); nulls first, rows equal in ``order`` in any order.

    The rows are sorted by range over all partitions, so a group of any size is spread over as many tasks as it
    needs; each stretch of a group in a partition learns how many rows of the group stand before it. ``rows`` is read
    twice, so it should be written or cheap."""
    by = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    x = tied.repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    x = written(x, "sorted").withColumn("_part", F.shiftright("_at", 33))
    runs = x.groupBy("_part", *group).agg(F.min("_at").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"_before": before, "count": F.sum("_n").over(whole)}).withColumn("_first", (F.col("_before") == 0).cast("long"))
    parts = runs.groupBy("_part").agg(F.sum("_first").alias("_firsts"))
    earlier = F.coalesce(F.sum("_firsts").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    parts = parts.select("_part", earlier.alias("_earlier"))
    inside = F.sum("_first").over(Window.partitionBy("_part").orderBy("_from"))
    runs = runs.withColumn("_inside", inside).join(parts, "_part").withColumn("group_no", F.col("_earlier") + F.col("_inside") - 1)
    runs = runs.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_from", "_before", "count", "group_no")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = x.join(runs, same)
    return out.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_from")).alias("rank"), "count", "group_no")
