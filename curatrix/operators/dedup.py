"""Duplicates of catalog records: title similarity and the greedy order-dependent fold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from curatrix.operators.graph import labelled
from curatrix.operators.shared import forget, small, written


def title_classes(df: DataFrame, id: str, tokens: str, block: str) -> DataFrame:
    """(class_id, block, tokens, n): rows of one block with equal token sets are one class, named by its least id."""
    x = df.select(F.col(id).alias("id"), F.col(block).alias("block"), F.array_sort(tokens).alias("tokens")).where(F.size("tokens") > 0)
    return x.groupBy("block", "tokens").agg(F.min("id").alias("class_id"), F.count("*").alias("n"))


#: Tokens whose order of rarity is known to all tasks; those that are rarer come before them, in any order.
COMMON = 100_000
#: Bits that tell how many tokens two sets differ by at least.
BITS = 512


def _place(kind: str, value: Column) -> Column:
    """Where rows meet: a name of a key's value, or of a title in its block, in 16 bytes."""
    return F.unhex(F.md5(F.to_json(F.struct(F.lit(kind).alias("kind"), value.alias("value")))))


def _alike(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with their size, those aside that are so short that one token more is too much: different sets of n and more tokens have n + 1 together at least."""
    size = F.size("tokens")
    return rows.withColumn("size", size).where(size * 100 >= (size + 1) * percent)


def _hashes() -> Column:
    return F.transform("tokens", lambda t: F.xxhash64(t))


def _with_heads(rows: DataFrame, percent: int) -> DataFrame:
    """``rows`` with ``heads`` and ``bits`` instead of ``tokens``.

    heads: the hashes of the first tokens in order of rarity; two sets that are so similar share one of these. bits: whether the hashes of an odd number of tokens end
    in the number of the bit; two sets differ by as many tokens as bits at least. The order is worked out inside a row, so tokens take no shuffle; only counts of hashes do. Tokens of one hash count as one token."""
    counts = rows.select(F.explode(_hashes()).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    common = counts.where("df > 1").orderBy(F.desc("df"), "h").limit(COMMON).toArrow()["h"].to_numpy()
    by_hash = np.argsort(common)
    common, rank = common[by_hash], (len(common) - np.arange(len(common)))[by_hash]  # the rarest first

    def first(batches):
        for batch in batches:
            lists = batch.column("heads")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(n)), n)
            order = np.zeros(len(flat), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
                order = np.where(common[at] == flat, rank[at], 0)
            by = np.lexsort((flat, order, row))
            keep = n - (n.astype(np.int64) * percent + 99) // 100 + 1
            starts = np.cumsum(n) - n
            taken = by[np.arange(len(flat)) - np.repeat(starts, n) < np.repeat(keep, n)]
            heads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keep)]), pa.int32()), pa.array(flat[taken], pa.int64()))
            odd = np.bincount(row * BITS + (flat & (BITS - 1)), minlength=len(n) * BITS) & 1
            words = np.packbits(odd.astype(np.uint8)).view(np.int64)
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * (BITS // 64), pa.int32()), pa.array(words))
            yield batch.set_column(batch.schema.get_field_index("heads"), "heads", heads).append_column("bits", bits)

    out = rows.withColumn("heads", _hashes()).drop("tokens")
    return out.mapInArrow(first, StructType([*out.schema, StructField("bits", out.schema["heads"].dataType)]))


def _met(classes: DataFrame, percent: int) -> DataFrame:
    """(x, y) of the keys of classes that have one of their ``heads`` in common, and sizes and ``bits`` that differ by as little as they may.

    Heads meet by block, token and a step of sizes; those that no other class of the block has are dropped first."""
    heads = classes.where("block is not null").select("key", "size", F.explode("heads").alias("head"), "block").select("key", "size", F.xxhash64("block", "head").alias("place"))
    heads = written(heads.withColumn("n", F.count("*").over(Window.partitionBy("place"))).where("n > 1").drop("n"), "heads")
    # sizes in steps so wide that a set and a larger one as similar are of one step, or of the next
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(100 / percent)).cast("int") if percent < 100 else F.col("size")
    a = heads.withColumn("step", F.explode(F.array(step, step + 1))).alias("a")
    b = heads.withColumn("step", step).alias("b")
    met = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.step") == F.col("b.step")))
    met = met.where((F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.key") < F.col("b.key"))))
    met = met.where(F.col("a.size") * 100 >= F.col("b.size") * percent)
    met = met.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()
    for c in "xy":
        met = met.join(classes.select(F.col("key").alias(c), F.struct("size", "bits").alias(f"of_{c}")), c)
    apart = F.aggregate(F.zip_with("of_x.bits", "of_y.bits", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, m: n + m)
    met = written(met.where(apart * (100 + percent) <= (F.col("of_x.size") + F.col("of_y.size")) * (100 - percent)).select("x", "y"), "met")
    forget(heads)
    return met


def _tested(met: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """(x, y, shared, total) of the pairs that are as similar as ``percent``, by an exact test in integers; ``held``: key, block, tokens, rows of a key being equal."""
    pairs = (
        met.join(held.withColumnsRenamed({"key": "x", "block": "block_x", "tokens": "left"}), "x")
        .join(held.withColumnsRenamed({"key": "y", "block": "block_y", "tokens": "right"}), "y")
        .where("block_x = block_y")
        .select("x", "y", F.size(F.array_intersect("left", "right")).alias("shared"), F.size(F.array_union("left", "right")).alias("total"))
    )
    return pairs.where(F.col("shared") * 100 >= F.col("total") * percent).distinct()


def similar_titles(classes: DataFrame, percent: int = 95) -> DataFrame:
    """Pairs (a, b, shared, total) of classes of one block whose Jaccard similarity is at least ``percent``.

    Prefix filter: with tokens in order of rarity, two sets that are so similar share one of their first
    n - ceil(n * percent / 100) + 1 tokens, and their sizes differ by as little. The exact test is in integers: 100 * shared >= percent * total.
    ``classes`` are worked out three times, so they should be written or cheap."""
    held = classes.select(F.col("class_id").alias("key"), "block", "tokens")
    met = _met(written(_with_heads(_alike(held, percent), percent), "classes"), percent)
    held = held.join(small(met.select(F.explode(F.array("x", "y")).alias("key")).distinct()), "key", "left_semi")
    return _tested(met, held, percent).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared", "total")


def similar_rows(df: DataFrame, id: str, tokens: str, block: str, percent: int = 95) -> DataFrame:
    """Pairs (a, b, shared, total, n_a, n_b) of classes of rows, as :func:`similar_titles` of :func:`title_classes` with the sizes of both.

    Classes are named by a digest until the pairs are known, so only the token sets of these are shuffled or written. ``df`` is worked out three times."""
    x = df.select(F.col(id).alias("id"), F.col(block).alias("block"), F.array_sort(tokens).alias("tokens")).where(F.size("tokens") > 0)
    x = _alike(x.withColumn("key", _place("class", F.struct("block", "tokens"))), percent)
    rows = _with_heads(x, percent)
    classes = written(rows.groupBy("block", "key", "size", "heads", "bits").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "classes")
    met = _met(classes, percent)
    named = classes.select("key", "class_id", "n").join(met.select(F.explode(F.array("x", "y")).alias("key")).distinct(), "key", "left_semi")
    named = written(named, "named")
    # one row of each class; where ids repeat, more, which are equal
    held = x.join(small(named.select("key", F.col("class_id").alias("id"))), ["key", "id"], "left_semi").select("key", "block", "tokens")
    pairs = _tested(met, written(held, "tokens"), percent)
    for c in "xy":
        pairs = pairs.join(named.select(F.col("key").alias(c), F.struct("class_id", "n").alias(f"of_{c}")), c)
    first = F.col("of_x.class_id") < F.col("of_y.class_id")
    a, b = F.when(first, F.col("of_x")).otherwise(F.col("of_y")), F.when(first, F.col("of_y")).otherwise(F.col("of_x"))
    pairs = pairs.where("of_x.class_id <> of_y.class_id").select(a.alias("a"), b.alias("b"), "shared", "total")
    return pairs.select(F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), "shared", "total", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def greedy(df: DataFrame, id: str, order: str, keys: list[str], tokens: str, blocks: list[str], percent: int = 95) -> DataFrame:
    """Rows (id, winner, via): scans by ``order`` (then id) and drops what meets an accepted row, never a dropped one.

    A row meets an accepted row by an equal key (in the order of ``keys``) or by a title as similar as
    ``percent`` in one of ``blocks``; ``via`` is key0, key1, ... or title. Accepted rows have no winner.
    ``id`` is of any type and names a row; null keys, null blocks and empty titles meet nothing.

    The scan is worked out in rounds of joins: a row that comes first among all undecided rows it could
    meet is accepted, what meets it is dropped, and the rest goes on to the next round. Rows equal in
    all keys, titles and blocks are one row of the rounds."""
    x = df.select(
        F.col(id).alias("id"),
        F.struct(F.col(order).alias("order"), F.col(id).alias("id")).alias("ord"),
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.array_sort(tokens), F.array().cast("array<string>")).alias("tokens"),
        *[F.col(b).alias(f"b{i}") for i, b in enumerate(blocks)],
    )
    same = [c for c in x.columns if c not in ("id", "ord")]
    firsts = written(x.groupBy(*same).agg(F.min("ord").alias("ord")), "firsts")

    def titled(i: int) -> Column:
        return F.struct(F.col(f"b{i}").alias("block"), F.col("tokens").alias("tokens"))

    some_title = [F.col(f"b{i}").isNotNull() & (F.size("tokens") > 0) for i in range(len(blocks))]
    meets = [F.when(F.col(f"k{i}").isNotNull(), F.struct(F.lit(i).alias("kind"), _place(f"k{i}", F.col(f"k{i}")).alias("place"))) for i in range(len(keys))]
    meets += [F.when(some, F.struct(F.lit(len(keys)).alias("kind"), _place(f"b{i}", titled(i)).alias("place"))) for i, some in enumerate(some_title)]
    places = F.array_compact(F.array(*meets))
    members = written(firsts.select("ord", F.explode(places).alias("p")).select("ord", "p.kind", "p.place"), "members")
    edges = None
    for i, some in enumerate(some_title):
        classes = firsts.where(some).select(_place(f"b{i}", titled(i)).alias("class_id"), F.col(f"b{i}").cast("string").alias("block"), "tokens").distinct()
        pairs = similar_titles(written(classes, "classes"), percent).select("a", "b")
        edges = pairs if edges is None else edges.unionByName(pairs)
    if edges is None:
        edges = members.select(F.col("place").alias("a"), F.col("place").alias("b")).limit(0)
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "similar")

    def reached(least: DataFrame) -> DataFrame:
        """(place, m): the least ``m`` of a place and of those of similar titles."""
        over = edges.join(least.withColumnRenamed("place", "b"), "b").select(F.col("a").alias("place"), "m")
        return least.unionByName(over).groupBy("place").agg(F.min("m").alias("m"))

    alone = firsts.where(F.size(places) == 0).select("ord")
    accepted, left = [written(alone, "accepted")], members
    while not left.isEmpty():
        bound = reached(left.groupBy("place").agg(F.min("ord").alias("m")))
        best = labelled(left, bound, "place", "ord").groupBy("ord").agg(F.max(F.col("m") < F.col("ord")).alias("later")).where("not later")
        now = written(best.select("ord"), "accepted")
        taken = reached(left.join(now, "ord").groupBy("place").agg(F.min("ord").alias("m")))
        met = labelled(left, taken, "place", "ord").select("ord").distinct()
        rest = written(left.join(met.unionByName(now), "ord", "left_anti"), "members")
        if left is not members:
            forget(left)
        left = rest
        accepted.append(now)
    won = accepted[0]
    for part in accepted[1:]:
        won = won.unionByName(part)
    labels = reached(members.join(won, "ord").groupBy("place").agg(F.min("ord").alias("m")))
    rows = x.select("id", "ord", F.explode_outer(places).alias("p")).select("id", "ord", "p.kind", "p.place")
    met = labelled(rows.where("place is not null"), labels, "place", "ord").where(F.col("m") < F.col("ord"))
    winner = met.groupBy("ord").agg(F.min(F.struct("kind", "m")).alias("w"))
    via = F.when(F.col("w.kind") < len(keys), F.concat(F.lit("key"), F.col("w.kind"))).when(F.col("w").isNotNull(), "title")
    return x.select("id", "ord").join(winner, "ord", "left").select("id", F.col("w.m.id").alias("winner"), via.alias("via"))


def best_of(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row of each key, the first in ``order``; combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
