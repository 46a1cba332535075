"""Readers: catalog tables, and census files with their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def census_lines(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON lines, one record each; records that do not parse are null in every column but _corrupt."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("encoding", "UTF-8")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def census_document(spark: SparkSession, path: str, array: str | None = "datasets") -> DataFrame:
    """One JSON document whose ``array`` holds the records, or that is an array of records itself (None)."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole if array is None else whole.select(F.explode(array).alias("r")).select("r.*")


def landing_zone(spark: SparkSession, path: str) -> DataFrame:
    """Raw payloads, a JSON object a line, as VARIANT beside their text; bad lines have a null variant."""
    return spark.read.text(path).select(F.col("value").alias("raw"), F.try_parse_json("value").alias("payload"))


def census_gate(df: DataFrame, key: str, expected: int | Column, approved=None) -> DataFrame:
    """One row: counts against what is expected (a number or an aggregate), and the verdict on the whole input."""
    checks = df.agg(
        (F.lit(expected) if isinstance(expected, int) else expected).cast("long").alias("expected"),
        F.count("*").alias("n_rows"),
        F.count_distinct(key).alias("n_keys"),
        F.count_if(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")).alias("n_missing"),
        (F.count_if(~approved) if approved is not None else F.lit(0)).cast("long").alias("n_unapproved"),
    )
    verdict = (
        F.when(F.col("n_rows") != F.col("expected"), "count")
        .when(F.col("n_missing") > 0, "identity")
        .when(F.col("n_keys") != F.col("n_rows"), "duplicates")
        .when(F.col("n_unapproved") > 0, "unapproved")
        .otherwise("pass")
    )
    return checks.withColumn("verdict", verdict)
