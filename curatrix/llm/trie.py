"""The prefix trie of conversations, by blocks of turns.

Each conversation is cut into blocks of BLOCK turns, and the digests of its blocks are chained, so equal chains mean
equal beginnings. Conversations are grouped by these chains first. Where a beginning goes on with one block only, all turns of that
block have the members of the block; only where siblings diverge are the turns inside the blocks compared, and only
one representative of each different block takes part.

Sums over subtrees need no walk. A node belongs to its least member, so each conversation owns the nodes from some
depth to its end, and brings to a subtree the leaf it owns, if any, and the bytes of the turns that it shares
with smaller conversations. Both are sums over the members of a node.

A conversation of very many turns is sorted over all partitions and its chain is worked out in stretches of STRETCH blocks;
the ids that end at one node are hashed as a stream of sorted pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import common
from curatrix.llm.sqltext import crc32

#: Turns in a block.
BLOCK = 4
#: Blocks chained in one task.
STRETCH = 256
#: Ids joined to one text before they are hashed.
PIECE = 4096
#: Conversations that share a beginning when rebuilt, and the greatest number of turns taken over.
FAMILY, TAKEN = 5, 9


def _hash(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*values), 256))


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, n, key, bytes): each turn's place from 0, the turns of its conversation, a digest that names (role, text).

    Turns stand in the order of ``turn``, nulls first, then of the digest. Null roles and texts are empty. Rows
    without a conversation are left out."""
    r, t = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    x = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        _hash(F.octet_length(r).cast("string"), F.lit(":"), r, t).alias("key"),
        F.octet_length(t).cast("long").alias("bytes"),
    )
    x = common.ranked(common.written(x, "turns"), ["conv_id"], ["turn", "key"])
    return x.select("conv_id", F.col("rank").alias("pos"), F.col("count").alias("n"), "key", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id), turns (conv_id, pos, key, bytes)): the first h turns of each are those of the first
    conversation of its family, h being the id's checksum modulo TAKEN; its own turns after its first h follow."""
    convs = rows.where("pos = 0").select("conv_id", F.col("n").alias("own"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN})
    heads = rows.where(F.col("pos") < TAKEN - 1).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "bytes"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), 1, F.col("h").cast("int")))
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    # h turns of each go: a long conversation meets its few numbers in many tasks
    shift = convs.select("conv_id", "h", F.size("head").alias("given"))
    after = common.labelled(rows, shift, "conv_id", "pos").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "key", "bytes")
    return convs.select("conv_id"), first.unionByName(after)


def _chained(blocks: DataFrame) -> DataFrame:
    """(c, k, prefix, before) of blocks (c, k, digest, bytes): the chain of digests through block k, and the bytes before it.

    Stretches of one conversation know what stands before them from the chain of the stretches' own digests, so no task
    holds more than STRETCH blocks of it."""
    rows = F.array_sort(F.collect_list(F.struct("k", "digest", "bytes")))
    x = blocks.groupBy("c", F.floor(F.col("k") / STRETCH).cast("long").alias("part")).agg(rows.alias("rows"))
    if (blocks.agg(F.max("k")).first()[0] or 0) < STRETCH:
        x = x.withColumns({"chain": F.lit(b""), "from": F.lit(0).cast("long")})
    else:
        x = common.written(x, "stretches")
        parts = x.select("c", F.col("part").alias("k"), F.unhex(F.sha2(F.array_join(F.transform("rows", lambda r: F.hex(r["digest"])), ""), 256)).alias("digest"), F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["bytes"]).alias("bytes"))
        parts = common.written(parts, "parts")
        up = _chained(parts).join(parts.select("c", "k", "bytes"), ["c", "k"]).select("c", (F.col("k") + 1).alias("part"), F.col("prefix").alias("chain"), (F.col("before") + F.col("bytes")).alias("from"))
        x = x.join(up, ["c", "part"], "left").withColumns({"chain": F.coalesce("chain", F.lit(b"")), "from": F.coalesce("from", F.lit(0).cast("long"))})
    start = F.struct(F.col("chain").alias("p"), F.col("from").alias("b"), F.array().cast("array<struct<k:bigint,prefix:binary,before:bigint>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        p = _hash(a["p"], r["digest"])
        return F.struct(p.alias("p"), (a["b"] + r["bytes"]).alias("b"), F.concat(a["out"], F.array(F.struct(r["k"].alias("k"), p.alias("prefix"), a["b"].alias("before")))).alias("out"))

    return x.select("c", F.explode(F.aggregate("rows", start, step)["out"]).alias("o")).select("c", "o.*")


def _block_digest(members: Column, upto: Column | None = None) -> Column:
    """Digest of the keys of a block's turns, or of the first ``upto``."""
    keys = F.transform(members, lambda t: F.hex(t["key"]))
    return F.unhex(F.sha2(F.array_join(keys if upto is None else F.slice(keys, 1, upto), ""), 256))


def _ends_hashed(ends: DataFrame) -> DataFrame:
    """(end, ends_sha256) of (end, conv_id): the SHA-256 of the ids of a node, ascending, comma-joined.

    The ids are sorted over all partitions and joined to texts of PIECE ids there; one task then hashes the texts of a node in
    order, one after another, holding none."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["end", "first", "text"])

        for batch in batches:
            for e, i in zip(batch["end"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if ids and (e != end or len(ids) == PIECE):
                    yield out()
                    ids = []
                end = e
                ids.append(i)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, h = None, None
        for batch in batches:
            done = []
            for e, t in zip(batch["end"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if h is not None and e == end:
                    h.update(b"," + t.encode())
                    continue
                if h is not None:
                    done.append((end, h.hexdigest()))
                end, h = e, hashlib.sha256(t.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["end", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.binary()), pa.array([h.hexdigest()])], ["end", "ends_sha256"])

    pieces = ends.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id").mapInArrow(joined, "end binary, first long, text string")
    return pieces.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "end binary, ends_sha256 string")


def trie(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of the trie of sequences: ``convs`` (conv_id, long) and their ``rows`` (conv_id, pos, key, bytes).

    Returns conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. A conversation
    without turns is a member of the root alone. Without conversations there are no nodes."""
    common.small_batches(convs.sparkSession)
    block = rows.groupBy(F.col("conv_id").alias("c"), F.floor(F.col("pos") / BLOCK).cast("long").alias("k")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns"))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["bytes"])
    block = common.written(block.select("c", "k", "turns", _block_digest(F.col("turns")).alias("digest"), size.alias("bytes")), "blocks")
    chain = common.written(_chained(block.select("c", "k", "digest", "bytes")), "chain")
    # the chain before a block: its own but one
    parent = chain.select("c", (F.col("k") + 1).alias("k"), F.col("prefix").alias("parent"))
    placed = block.select("c", "k", "turns", "bytes").join(chain, ["c", "k"]).join(parent, ["c", "k"], "left").withColumn("parent", F.coalesce("parent", F.lit(b"")))
    placed = common.written(placed, "placed")
    groups = placed.groupBy("prefix").agg(F.count("*").alias("n"), F.min("c").alias("conv"), *[F.first(c).alias(c) for c in ("k", "parent", "before", "turns")])
    groups = common.written(groups, "groups")
    ends = placed.groupBy(F.col("c").alias("conv_id")).agg(F.max_by(F.struct(F.col("prefix").alias("end"), (F.col("before") + F.col("bytes")).alias("total")), "k").alias("e")).select("conv_id", "e.*")
    ends = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("end", F.lit(b"")).alias("end"), F.coalesce("total", F.lit(0).cast("long")).alias("total"))
    ends = common.written(ends, "ends")
    top = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")).where("n > 0")

    # blocks with the number of their siblings and the node they grow from
    siblings = groups.groupBy("parent").agg(F.count("*").alias("siblings"))
    above = groups.select(F.col("prefix").alias("parent"), F.col("conv").alias("from_conv")).unionByName(top.select(F.lit(b"").alias("parent"), F.col("conv").alias("from_conv")))
    grown = common.written(common.labelled(groups, siblings.join(above, "parent"), "parent", "prefix"), "grown")
    base = F.col("k") * BLOCK

    def opened(x: DataFrame, *keep: str) -> DataFrame:
        x = x.select(*keep, "prefix", "parent", "k", "turns", "before", F.posexplode("turns").alias("j", "t"))
        earlier = F.aggregate(F.slice("turns", 1, F.col("j")), F.col("before"), lambda a, t: a + t["bytes"])
        return x.withColumns({"depth": base + F.col("j") + 1, "bytes": F.col("t")["bytes"], "earlier": earlier})

    alone = opened(grown.where("siblings = 1"), "n", "conv", "from_conv")
    plain = alone.select(
        F.when(F.col("j") + 1 == F.size("turns"), F.col("prefix")).alias("key"), F.col("prefix").alias("block"), "conv", "depth",
        F.when(F.col("j") == 0, F.col("from_conv")).otherwise(F.col("conv")).alias("parent_conv"), "n", "bytes", F.col("earlier").alias("before"),
    )

    def key(upto: Column) -> Column:
        return F.when(upto == 0, F.col("parent")).otherwise(_hash(F.col("parent"), _block_digest(F.col("turns"), upto)))

    apart = opened(grown.where("siblings > 1"), "n", "conv", "from_conv")
    apart = apart.select("prefix", key(F.col("j") + 1).alias("key"), key(F.col("j")).alias("parent_key"), "j", "n", "conv", "from_conv", "depth", "bytes", "earlier")
    apart = common.written(apart, "apart")
    merged = apart.groupBy("key").agg(F.min("conv").alias("conv"), F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("parent_key", "j", "from_conv", "depth", "bytes", "earlier")])
    merged = common.written(merged, "merged")
    inner = merged.where("j > 0")
    inner = common.labelled(inner, merged.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv")), "parent_key", "key")
    columns = ["key", F.lit(None).cast("binary").alias("block"), "conv", "depth", "parent_conv", "n", "bytes", F.col("earlier").alias("before")]
    refined = inner.select(*columns).unionByName(merged.where("j = 0").withColumn("parent_conv", F.col("from_conv")).select(*columns))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = top.select(F.lit(b"").alias("key"), F.lit(None).cast("binary").alias("block"), "conv", zero.alias("depth"), none.alias("parent_conv"), "n", zero.alias("bytes"), zero.alias("before"))
    nodes = common.written(plain.unionByName(refined).unionByName(root), "nodes")

    # what ends at a node, and who owns it
    ended = ends.groupBy("end").agg(F.count("*").alias("n_ends")).join(_ends_hashed(ends), "end").withColumnRenamed("end", "key")
    # only turns that end a block or stand in one that diverges can be the end of a conversation
    keyed = nodes.where("key is not null").join(ended, "key", "left")
    rest = nodes.where("key is null").withColumns({"n_ends": none, "ends_sha256": F.lit(None).cast("string")})
    nodes = common.written(keyed.unionByName(rest).withColumn("leaf", F.coalesce("n_ends", zero) == F.col("n")), "ended")
    owned = nodes.groupBy(F.col("conv").alias("conv_id")).agg(F.min_by("before", "depth").alias("shared"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    owners = ends.join(owned, "conv_id", "left").select(F.col("conv_id").alias("c"), F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", zero).alias("leaf"))
    owners = common.written(owners, "owners")

    # sums over members: by block, then by the turns inside blocks that diverge
    sums = [F.sum("leaf").alias("leaves"), F.sum("shared").alias("shared"), F.min(F.struct("c", F.col("shared").alias("own"))).alias("least")]
    again = [F.sum("leaves").alias("leaves"), F.sum("shared").alias("shared"), F.min("least").alias("least")]
    by_block = common.written(common.labelled(placed.select("c", "k", "prefix"), owners, "c", "k").groupBy("prefix").agg(*sums), "sums")
    by_turn = apart.select("prefix", "key").join(by_block, "prefix").groupBy("key").agg(*again)
    by_root = owners.agg(*sums).withColumn("key", F.lit(b""))
    summed = nodes.where("block is not null").join(by_block.withColumnRenamed("prefix", "block"), "block")
    summed = summed.unionByName(nodes.where("block is null").join(by_turn.unionByName(by_root), "key"))
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    saved = F.col("shared") - F.col("least.own") - (F.col("n") - 1) * F.col("before")
    return summed.join(children, ["conv", "depth"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op13_block_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations.

    Turns with equal numbers, repeated rows among them, stand in the order of the digest of role and text; each is a turn. Null roles
    and texts are empty, of any length otherwise. Rows without a conv_id belong to no conversation. An empty table gives no
    nodes. Columns of other names are not read."""
    return trie(*rebuilt(common.written(turns(common.table(spark, sf_dir, "conversations")), "ordered")))


OP13_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id AS c, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT *, sha256(strlen(role)::VARCHAR || ':' || role || text) AS key, strlen(text) AS bytes FROM t),
ordered AS (SELECT c, list({{'key': key, 'bytes': bytes}} ORDER BY turn NULLS FIRST, key) AS turns FROM keyed GROUP BY c),
whole AS (
  SELECT o.c, list_concat(COALESCE(b.turns[1:h], []), o.turns[h + 1 : len(o.turns)]) AS turns
  FROM (SELECT *, {crc32("c::VARCHAR")} % {TAKEN} AS h FROM ordered) o LEFT JOIN ordered b ON b.c = o.c - o.c % {FAMILY}),
paths AS (
  SELECT c, depth, len(turns) AS n, array_to_string(list_transform(turns[1:depth], lambda x: x.key), '') AS path,
         CASE WHEN depth > 0 THEN turns[depth].bytes ELSE 0 END AS bytes
  FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole)),
nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(COALESCE(string_agg(CASE WHEN n = depth THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n
  LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[1 : 64 * (n.depth - 1)]),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT conv_id, depth, conv_id AS top_conv, depth AS top_depth FROM linked
  UNION ALL SELECT l.conv_id, l.depth, b.top_conv, b.top_depth FROM below b
  JOIN linked l ON l.parent_conv_id = b.conv_id AND l.depth = b.depth + 1)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, COALESCE(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, l.ends_sha256
FROM linked l LEFT JOIN children k ON k.conv_id = l.conv_id AND k.depth = l.depth
JOIN (SELECT b.top_conv, b.top_depth, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((l.n_convs - 1) * l.bytes)::BIGINT AS saved_tokens
      FROM below b JOIN linked l ON l.conv_id = b.conv_id AND l.depth = b.depth LEFT JOIN children k ON k.conv_id = b.conv_id AND k.depth = b.depth GROUP BY ALL) s
  ON s.top_conv = l.conv_id AND s.top_depth = l.depth
"""
