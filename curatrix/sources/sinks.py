"""Writers: JSON reports and messages for a bus, as Spark writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """Each section as JSON lines in a folder of its name."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value) rows for a message bus, the whole row as JSON; write them with the sink at hand."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def rebuild(existing: DataFrame, bad: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``existing`` without the records of ``bad``, with ``fresh`` ones in their place."""
    return existing.join(bad.select(key).distinct(), key, "left_anti").unionByName(fresh)
