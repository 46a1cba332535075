"""Connected components by joins, for groups of records that have to do with one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.operators.shared import forget, written

#: Parts into which the rows of one key are dealt where they meet its label.
SALT = 16


def labelled(rows: DataFrame, label: DataFrame, on: str, by: str) -> DataFrame:
    """``rows`` joined to the one row that ``label`` has of each ``on``.

    A value that very many rows share is spread over SALT tasks by their ``by``; each has its label."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))
    return dealt.join(label.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [on, "_salt"]).drop("_salt")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of all nodes of undirected edges; root is the least node of the component.

    Alternates the large-star and small-star steps of distributed component search. Each step is an
    aggregation (partial, so that hubs are combined before the shuffle) and a salted equi-join; the edges of
    each round are written, so lineage stays short. The search ends when the edges are stars: no node has two of
    them but as the least one. Self-loops and null ends are dropped; no edges give no
    rows."""
    cur = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} != {b}").distinct(), "edges")
    while True:
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = labelled(sym, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            labelled(large, low, "u", "v")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        nxt = written(small, "edges")
        forget(cur, large)
        cur = nxt
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(cur.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
        if not ends.agg(F.count_if(F.expr("ups > 1 or (ups = 1 and least = 0)"))).first()[0]:
            break
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
