"""A manifest that proves each row of a dataset: one hash tree a source, kept as a log in completion order.

A tree has runs of three nodes and all leaves at one depth. It is built by aligned builders: a builder takes
3 ** LEVELS consecutive nodes of a source, and appends each node to its log as soon as the node is complete, which
is postorder. The place of a node in such a log has a closed form (how many nodes of each level are complete by
then), so a proof is read by addresses; nothing is searched. The tops of the builders are the leaves of builders of the next
tier, until one node is left, the source's subroot; the subroots form one more tree.

No builder holds more than 3 ** LEVELS leaves, however large a source is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import common
from curatrix.llm.sqltext import crc32

#: Nodes hashed together.
RUN = 3
#: Levels of a builder.
LEVELS = 5
SEGMENT = RUN**LEVELS
#: Bytes of a digest.
WIDTH = 32
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(digests: bytes) -> bytes:
    """The digest of digests, which enter as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    up, wide = 0, 1
    while wide < leaves:
        up, wide = up + 1, wide * RUN
    return up


def position(level: int, index: int, leaves: int, top: int) -> int:
    """Place, from 0, of a node in the postorder log of a tree of ``leaves`` leaves and ``top`` levels above them.

    Of its own level and those below, all nodes are complete up to its last leaf; of a level above, those whose
    nodes all stand before it."""
    end = min((index + 1) * RUN**level, leaves)
    below = sum(-(-end // RUN**j) for j in range(level + 1))
    return below + sum(index // RUN ** (j - level) for j in range(level + 1, top + 1)) - 1


def append_log(digests: list[bytes], top: int) -> bytes:
    """All nodes over ``digests``, in the order in which they become complete; the last is the top."""
    log: list[bytes] = []
    runs: list[list[bytes]] = [[] for _ in range(top)]

    def add(level: int, digest: bytes) -> None:
        log.append(digest)
        if level < top:
            runs[level].append(digest)
            if len(runs[level]) == RUN:
                close(level)

    def close(level: int) -> None:
        run, runs[level] = runs[level], []
        add(level + 1, _hash(b"".join(run)))

    for d in digests:
        add(0, d)
    for level in range(top):
        if runs[level]:
            close(level)
    return b"".join(log)


@lru_cache(maxsize=1024)
def addresses(leaves: int, top: int) -> list[list[tuple[list[int], list[int]]]]:
    """For each leaf, level by level, the places of its siblings to the left and to the right."""
    out = []
    for leaf in range(leaves):
        path = []
        for level in range(top):
            index = leaf // RUN**level
            first, width = index - index % RUN, -(-leaves // RUN**level)
            around = [(j, position(level, j, leaves, top)) for j in range(first, min(first + RUN, width)) if j != index]
            path.append(([p for j, p in around if j < index], [p for j, p in around if j > index]))
        out.append(path)
    return out


def _siblings(log: bytes, path: list[tuple[list[int], list[int]]]) -> list[tuple[bytes, bytes]]:
    return [tuple(b"".join(log[p * WIDTH : (p + 1) * WIDTH] for p in side) for side in sides) for sides in path]


def _digest(*values: Column) -> Column:
    """H of values, each `-` if null, else its byte count, `:` and itself."""
    texts = [v.cast("string") for v in values]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _segments(nodes: DataFrame) -> DataFrame:
    """Logs of the builders over nodes (g, i, m, digest, id, other): node i of m of the tree g; id and other go along.

    Returns (g, seg, m, top, log, ids, others)."""
    members = F.array_sort(F.collect_list(F.struct("i", "digest", "id", "other")))
    rows = nodes.groupBy("g", F.floor(F.col("i") / SEGMENT).cast("long").alias("seg")).agg(F.first("m").alias("m"), members.alias("rows"))
    kind = nodes.schema["id"].dataType.simpleString()
    schema = f"g long, seg long, m long, top int, log binary, ids array<{kind}>, others array<binary>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = [min(LEVELS, height(m)) for m in batch["m"].to_pylist()]
            members = batch["rows"]
            flat = members.flatten()
            digests, offsets = flat.field("digest").to_pylist(), members.offsets.to_pylist()
            base = offsets[0]
            logs = [append_log(digests[a - base : b - base], top) for a, b, top in zip(offsets[:-1], offsets[1:], tops, strict=True)]
            starts = pa.array([o - base for o in offsets], pa.int32())
            lists = [pa.ListArray.from_arrays(starts, flat.field(c)) for c in ("id", "other")]
            yield pa.RecordBatch.from_arrays(
                [batch["g"], batch["seg"], batch["m"], pa.array(tops, pa.int32()), pa.array(logs, pa.binary()), *lists],
                ["g", "seg", "m", "top", "log", "ids", "others"],
            )

    return common.written(rows.mapInArrow(build, schema), "log")


PATH = "left array<binary>, right array<binary>, root binary"


def _climb(segments: DataFrame) -> DataFrame:
    """(g, i, left, right, root) of each leaf of the segments, which hold the path of their own top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("g", pa.int64()), ("i", pa.int64()), ("left", pa.list_(pa.binary())), ("right", pa.list_(pa.binary())), ("root", pa.binary())])
        for batch in batches:
            for s in batch.to_pylist():
                out = []
                for k, path in enumerate(addresses(len(s["ids"]), s["top"])):
                    sides = _siblings(s["log"], path)
                    out.append({"g": s["g"], "i": s["ids"][k], "left": [a for a, _ in sides] + s["left"], "right": [b for _, b in sides] + s["right"], "root": s["root"]})
                yield pa.RecordBatch.from_pylist(out, schema)

    return segments.mapInArrow(run, f"g long, i long, {PATH}")


def _top(log: str = "log") -> Column:
    return F.substring(F.col(log), -WIDTH, WIDTH)


def _paths(segments: DataFrame) -> DataFrame:
    """(g, seg, left, right, root): for the top of each segment, its siblings up to the root of its tree."""
    none = F.array().cast("array<binary>")
    up = segments.select("g", F.col("seg").alias("i"), F.ceil(F.col("m") / SEGMENT).cast("long").alias("m"), _top().alias("digest"), F.col("seg").alias("id"), F.lit(None).cast("binary").alias("other"))
    if (up.agg(F.max("m")).first()[0] or 0) <= 1:
        return up.select("g", F.col("i").alias("seg"), none.alias("left"), none.alias("right"), F.col("digest").alias("root"))
    upper = _segments(up)
    return common.written(_climb(upper.join(_paths(upper), ["g", "seg"])).withColumnRenamed("i", "seg"), "paths")


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = LEAF_FIELDS, changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: key, leaf, subroot, root, proof (hex of all siblings, in order), folded.

    Leaves are the digests of ``fields``; those of a source stand in the order of ``key`` (nulls first), then of the digest;
    sources stand bytewise, null first. ``folded`` is the root that follows from the row's siblings and its leaf, or the leaf of the
    ``changed`` columns where ``where`` holds. Equal rows are leaves of their own. Nulls have a sign of their own, so a
    null and an empty text differ; texts of any length are hashed whole; an empty table gives no rows; other
    columns are not read."""
    common.small_batches(docs.sparkSession)
    plain = [F.col(f"`{c}`") for c in fields]
    other = _digest(*[(changed or {}).get(c, F.col(f"`{c}`")) for c in fields])
    leaves = docs.select(
        F.col(f"`{key}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
        _digest(*plain).alias("digest"),
        (F.when(where, other) if changed and where is not None else F.lit(None).cast("binary")).alias("other"),
    )
    nodes = common.ranked(common.written(leaves, "leaves"), ["source"], ["id", "digest"])
    nodes = nodes.select(F.col("group_no").alias("g"), F.col("rank").alias("i"), F.col("count").alias("m"), "digest", "id", "other")
    log = _segments(nodes)
    paths = _paths(log)
    subroots = common.written(paths.where("seg = 0").select("g", "root"), "subroots")
    count = subroots.count()
    tree = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(count).cast("long").alias("m"), F.col("root").alias("digest"), F.col("g").alias("id"), F.lit(None).cast("binary").alias("other"))
    joint = _segments(tree)
    ends = _climb(joint.join(_paths(joint), ["g", "seg"])).select(F.col("i").alias("g"), F.col("left").alias("left2"), F.col("right").alias("right2"), F.col("root").alias("top_root"))
    above = common.labelled(paths, common.written(ends, "ends"), "g", "seg")
    above = above.select("g", "seg", F.concat("left", "left2").alias("left"), F.concat("right", "right2").alias("right"), F.col("root").alias("subroot"), "top_root")
    kind = docs.schema[key].dataType.simpleString()
    return log.join(above, ["g", "seg"]).mapInArrow(_prove, f"id {kind}, leaf string, subroot string, root string, proof string, folded string").withColumnRenamed("id", key)


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch["ids"]
        for n, s in enumerate(batch.to_pylist()):
            own = ids[n].values
            leaves, proofs, folded = [], [], []
            upper = list(zip(s["left"], s["right"], strict=True))
            for k, path in enumerate(addresses(len(own), s["top"])):
                at = position(0, k, len(own), s["top"]) * WIDTH
                leaf = s["log"][at : at + WIDTH]
                digest, seen = s["others"][k] or leaf, []
                for left, right in _siblings(s["log"], path) + upper:
                    seen += [left, right]
                    digest = _hash(left + digest + right)
                leaves.append(leaf.hex())
                proofs.append(b"".join(seen).hex())
                folded.append(digest.hex())
            same = [pa.array([s[c].hex()] * len(own)) for c in ("subroot", "top_root")]
            yield pa.RecordBatch.from_arrays([own, pa.array(leaves), *same, pa.array(proofs), pa.array(folded)], ["id", "leaf", "subroot", "root", "proof", "folded"])


def op11_postorder_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root, digest of the proof and the root recomputed from possibly tampered text, of every document.

    A row without an id is a leaf (the first of its source) and is never tampered with; nulls, empty and very long texts,
    repeated rows and empty tables as in :func:`manifest`."""
    docs = common.table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = manifest(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, where=even & F.contains("text", F.lit("\n")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _enc(*values: str) -> str:
    return " || ".join(f"COALESCE(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in values)


_LEVELS_SQL = "list_transform(range(0, len(nodes), 3), lambda j: sha256(array_to_string(nodes[j+1:j+3], '')))"
_PATH_SQL = "list([array_to_string(v.nodes[k - k % 3 + 1 : k], ''), array_to_string(v.nodes[k + 2 : k - k % 3 + 3], '')] ORDER BY v.level)"

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS sid,
         sha256({_enc("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 2 = 0 AND contains(text, chr(10))
              THEN sha256({_enc("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')")}) END AS other
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
tree(sid, level, nodes) AS (
  SELECT sid, 0, list(leaf ORDER BY i) FROM placed GROUP BY sid
  UNION ALL SELECT sid, level + 1, {_LEVELS_SQL} FROM tree WHERE len(nodes) > 1),
subroots AS (SELECT sid, nodes[1] AS subroot FROM tree WHERE len(nodes) = 1),
upper(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY sid) FROM subroots
  UNION ALL SELECT level + 1, {_LEVELS_SQL} FROM upper WHERE len(nodes) > 1),
top AS (SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1),
upper_paths AS (
  SELECT sid, {_PATH_SQL} AS path
  FROM (SELECT s.sid, u.level, u.nodes, s.sid // pow(3, u.level)::BIGINT AS k FROM subroots s, upper u WHERE len(u.nodes) > 1) v GROUP BY sid),
paths AS (
  SELECT sid, i, {_PATH_SQL} AS path
  FROM (SELECT p.sid, p.i, t.level, t.nodes, p.i // pow(3, t.level)::BIGINT AS k FROM placed p JOIN tree t ON t.sid = p.sid AND len(t.nodes) > 1) v
  GROUP BY sid, i),
whole AS (
  SELECT l.doc_id, l.leaf, l.other, s.subroot, top.root, list_concat(COALESCE(p.path, []), COALESCE(u.path, [])) AS path
  FROM placed l JOIN subroots s ON s.sid = l.sid CROSS JOIN top
  LEFT JOIN paths p ON p.sid = l.sid AND p.i = l.i LEFT JOIN upper_paths u ON u.sid = l.sid),
folded AS (
  SELECT *, (list_reduce(list_prepend([COALESCE(other, leaf), ''], path), lambda a, b: [sha256(b[1] || a[1] || b[2]), '']))[1] AS folded_root FROM whole)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[1] || x[2]), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded
"""
