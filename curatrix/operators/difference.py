"""Differences of two files that should say the same of the same records, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _told(df: DataFrame, c: str) -> Column:
    """A value as text: arrays, maps and structs as JSON; empty ones and empty texts say nothing, as null does."""
    kind = df.schema[c].dataType.typeName()
    v = F.to_json(F.col(f"`{c}`")) if kind in ("array", "map", "struct") else F.col(f"`{c}`").cast("string")
    return F.when(~v.isin("", "[]", "{}"), v)


def differences(left: DataFrame, right: DataFrame, key: str, names: dict[str, str] | None = None, leave: list[str] = ()) -> DataFrame:
    """(key, field, left, right, kind): one row per field that differs (kind ``value``), per record that one side lacks
    (``only_left``, ``only_right``) and per key that a side has more than once (``repeated_left``, ``repeated_right``).

    Fields are all columns that both sides have, but ``leave``, and those of ``names`` (left name to right name). Types may differ:
    values are compared as texts, empty and null alike. The first of repeated rows, in the order of their values, is compared. Rows
    with a null key are one record. Each side is reduced by key before the one join, and only what differs is opened into rows."""
    fields = {c: c for c in left.columns if c in right.columns and c != key and c not in leave} | (names or {})

    def side(df: DataFrame, columns: list[str]) -> DataFrame:
        values = F.array(*[_told(df, c) for c in columns]).cast("array<string>")
        return df.select(F.col(key), values.alias("v")).groupBy(key).agg(F.min("v").alias("v"), F.count("*").alias("n"))

    a, b = side(left, list(fields)).alias("a"), side(right, list(fields.values())).alias("b")
    both = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")), "full_outer")
    none = F.lit(None).cast("string")

    def row(kind: str, field: Column = none, x: Column = none, y: Column = none) -> Column:
        return F.struct(field.alias("field"), x.alias("left"), y.alias("right"), F.lit(kind).alias("kind"))

    apart = [row("value", F.lit(c), F.get("a.v", F.lit(i)), F.get("b.v", F.lit(i))) for i, c in enumerate(fields)]
    values = F.filter(F.array(*apart), lambda r: ~r["left"].eqNullSafe(r["right"])) if apart else F.array().cast("array<struct<field:string,left:string,right:string,kind:string>>")
    missing = F.when(F.col("b.n").isNull(), F.array(row("only_left"))).when(F.col("a.n").isNull(), F.array(row("only_right"))).otherwise(values)
    repeated = F.array_compact(F.array(F.when(F.col("a.n") > 1, row("repeated_left")), F.when(F.col("b.n") > 1, row("repeated_right"))))
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(F.concat(missing, repeated)).alias("d")).select(key, "d.*")
