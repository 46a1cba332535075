"""Intermediate tables in the folder that driver and executors share, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table, written as JSON, up to which it may be broadcast.
BROADCAST_BYTES = 32 << 20

_written: set[str] = set()


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Only a session in one process may do without: it gets a temporary folder, which on a cluster every
    executor would look for on a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, computes once, survives lost executors.

    The table goes when the driver ends, or earlier by :func:`forget`."""
    spark = df.sparkSession
    path = f"{folder(spark)}/curatrix-{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    system, target = _system(spark, path)
    system.deleteOnExit(target)
    _written.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._curatrix_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of :func:`written` that nothing will read again."""
    for df in tables:
        path = getattr(df, "_curatrix_path", None)
        if path in _written:
            _written.discard(path)
            system, target = _system(df.sparkSession, path)
            system.cancelDeleteOnExit(target)
            system.delete(target, True)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, marked for broadcast where its measured bytes are few; else as it is, for a join by shuffle.

    ``df`` is worked out once more for that, so it should be written or cheap."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))).first()[0]
    return F.broadcast(df) if (size or 0) <= limit else df
