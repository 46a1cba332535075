"""SimHash near-duplicate groups with pigeonring candidate filtering.

A fingerprint has 64 bits. Two fingerprints link at a Hamming distance of 2 or less. The bits are
dealt to three segments in a ring. The pigeonring principle: the differences of a linked pair can be
read from some segment on so that the first l segments together differ in at most l * 2 / 3 bits, for
every l. So from that segment: it is equal (0 <= 2/3), it and the next differ in at most one bit
(<= 4/3), all three in at most two. One bit of difference leaves one half of the next segment equal,
so a pair that can link shares a segment and a half of its successor: about 32 bits, the join key.
Pairs that share a key must then pass the chain of budgets and the Hamming check.

A key shared by many fingerprints (a large group of near copies) would emit the square of its size.
Such fingerprints are linked another exact way: two of them are within distance 2 if and only if
their balls of radius 1 meet, so each emits its 65 neighbours, and those that meet at a neighbour
(65 at most) are tied in a star. No pair is lost, and the rows stay linear in the input.

Texts of a given similarity (Jaccard over five-word shingles) differ in too many bits for such keys.
:func:`keep_unlike` finds them, beside those that link by fingerprint where ``linked`` is set, by bands of least hashes instead: a pair at the similarity 0.8 shares
none of the 24 bands of five with a probability of 0.00007, and less above it. Pairs that share a
band are then compared exactly. A band shared by many texts is resolved in rounds against hubs: who
resembles a hub is tied to it and leaves all its bands, and those left over become hubs in the next, all of
them or sixteen times as many. So a large group of near copies costs its size, not the square of it; only texts that share
a band without resembling each other are compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from curatrix.llm import common

SEED = 42
DISTANCE = 2
#: First bit and width of the ring's segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one key that are still compared pairwise.
PAIRWISE = 48
#: Bands of least hashes, and hashes in each.
BANDS, ROWS = 24, 5
#: Rows of a table of keys that may be broadcast.
BROADCAST_KEYS = 500_000
#: Bytes of the hubs' sets that a task holds at once.
HUB_BYTES = 16 << 20
#: Pairs of a band's members and of those left over up to which all of these become hubs, and else how many times as many there are in the next round.
MEETINGS, GROWTH = 1 << 22, 16


def _shingles(text: str | None, width: int) -> list[int]:
    """Hashes of the word shingles of a text, a shorter text being one; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both split and fold bytes as ASCII
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: -width].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of one text: majority bits over its word shingles."""
    hashes = _shingles(text, width)
    if not hashes:
        return 0
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: Column, width: int = 3) -> Column:
    """Column of signed 64-bit fingerprints. Null and wordless texts: 0."""

    @pandas_udf("long")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint_of(t, width)) for t in batch], dtype="int64")

    return run(text)


def _field(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def _keys(fp: Column) -> Column:
    """The six join keys: a segment and one half of the segment after it."""
    out = []
    for i, (at, width) in enumerate(SEGMENTS):
        to, wide = SEGMENTS[(i + 1) % len(SEGMENTS)]
        low = wide // 2
        for half, (start, size) in enumerate(((to, low), (to + low, wide - low))):
            tag = F.lit(((2 * i + half) << 44))
            out.append(tag.bitwiseOR(F.shiftleft(_field(fp, at, width), 22)).bitwiseOR(_field(fp, start, size)))
    return F.array(*out)


def _chained(x: Column, y: Column) -> Column:
    """Some segment starts a ring chain whose prefixes keep within their shares of the distance."""
    diff = x.bitwiseXOR(y)
    bits = [F.bit_count(_field(diff, at, width)) for at, width in SEGMENTS]
    n = len(bits)
    ok = F.lit(False)
    for i in range(n):
        whole = F.lit(True)
        total = F.lit(0)
        for step in range(n):
            total = total + bits[(i + step) % n]
            whole = whole & (total * n <= (step + 1) * DISTANCE)
        ok = ok | whole
    return ok


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) over distinct fingerprints ``fp`` whose components are those of all links. Null fingerprints have none.

    Every linked pair under keys of ordinary size is an edge; pairs under crowded keys are joined
    through stars of the same component."""
    keyed = common.written(fps.select(F.explode(_keys(F.col("fp"))).alias("key"), "fp"), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.written(keyed.join(sizes, "key"), "shared")
    common.forget(keyed)
    few = shared.where(F.col("n") <= PAIRWISE)
    pairs = (
        few.select("key", F.col("fp").alias("a"))
        .join(few.select("key", F.col("fp").alias("b")), "key")
        .where("a < b")
        .where(_chained(F.col("a"), F.col("b")))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
        .select("a", "b")
    )
    crowded = shared.where(F.col("n") > PAIRWISE).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64)])
    stars = (
        crowded.select("fp", F.explode(flips).alias("flip"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
        .groupBy("near")
        .agg(F.sort_array(F.collect_set("fp")).alias("members"))  # 65 at most
        .where(F.size("members") > 1)
        .select(F.col("members")[0].alias("a"), F.explode("members").alias("b"))
        .where("a < b")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: ``doc_id``, ``fp`` (signed long), ``component_id``.

    ``component_id`` is the smallest id among the rows reachable over links; rows with a null id
    belong to their component but never name it (a component of null ids only: null). Empty and null
    texts have fingerprint 0 and are linked like any other; repeated rows stay, each with its
    component; an empty table gives no rows."""
    common.small_batches(docs.sparkSession)
    rows = common.written(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = common.components(links(least.select("fp")), "a", "b")
    grouped = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = common.written(grouped.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the smallest id.

    Among rows of that same id the one with the least text hash stays, and rows that repeat it whole
    count once. Rows with a null id stay only where their group has no other."""
    common.small_batches(docs.sparkSession)
    rank = _rank(docs, doc_id, text)
    per_row = common.written(docs.select(fingerprint(F.col(text), width).alias("fp"), rank.alias("row")), "fingerprints")
    best = per_row.groupBy("fp").agg(F.min("row").alias("row"))
    roots = common.components(links(best.select("fp")), "a", "b")
    grouped = best.join(roots, best.fp == roots.node, "left").select("row", F.coalesce("root", "fp").alias("root"))
    stay = common.written(grouped.groupBy("root").agg(F.min("row").alias("row")).select("row.*"), "stay")
    return _staying(docs, per_row, stay, doc_id, text)


def _rank(docs: DataFrame, doc_id: str, text: str) -> Column:
    k1, k2 = common.text_keys(F.coalesce(F.col(text), F.lit("")))
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), k1.alias("k1"), k2.alias("k2"))


def _staying(docs: DataFrame, per_row: DataFrame, stay: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose rank is in ``stay``; those that repeat a row whole count once."""
    k1, k2 = common.text_keys(F.coalesce(F.col(text), F.lit("")))
    repeated = per_row.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select("row.*").withColumn("again", F.lit(True))
    same = stay.id.eqNullSafe(repeated.id) & (stay.k1 == repeated.k1) & (stay.k2 == repeated.k2)
    d1, d2, sid, s1, s2, again = common.unused(docs, "k1", "k2", "id", "s1", "s2", "again")
    stay = stay.join(repeated, same, "left").select(
        stay.id.alias(sid), stay.k1.alias(s1), stay.k2.alias(s2), F.coalesce("again", F.lit(False)).alias(again)
    )
    keyed = docs.withColumns({d1: k1, d2: k2})
    kept = keyed.join(stay, F.col(doc_id).eqNullSafe(F.col(sid)) & (F.col(d1) == F.col(s1)) & (F.col(d2) == F.col(s2)))
    once = kept.where(~F.col(again)).select(*docs.columns)
    return once.unionByName(kept.where(again).select(*docs.columns).dropDuplicates())


# ---------------------------------------------------------------- texts of a given similarity

_DRAWN = np.random.default_rng(SEED)
_TIMES = _DRAWN.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
_PLUS = _DRAWN.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)


def _set_of(text: str | None, width: int) -> np.ndarray:
    return np.unique(np.array(_shingles(text, width), "<u8"))


def sketch_of(text: str | None, width: int) -> tuple[bytes, np.ndarray]:
    """The 128-bit name of the text's set of shingles, and its band keys (none without words)."""
    hashes = _set_of(text, width)
    name = xxhash.xxh3_128_digest(hashes.tobytes())
    if not len(hashes):
        return name, np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 2048):  # a few MB at once
        least = np.minimum(least, (hashes[None, at : at + 2048] * _TIMES + _PLUS).min(axis=1))
    return name, np.array([_signed(xxhash.xxh64_intdigest(band.tobytes(), i)) for i, band in enumerate(least.reshape(BANDS, ROWS))], np.int64)


def _sketch(text: Column, width: int) -> Column:
    kind = StructType([StructField("node", BinaryType()), StructField("keys", ArrayType(LongType()))])

    @pandas_udf(kind)
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch_of(t, width) for t in batch], columns=["node", "keys"])

    return run(text)


def _set(text: Column, width: int) -> Column:
    @pandas_udf(ArrayType(LongType()))
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([_set_of(t, width).view(np.int64) for t in batch], dtype=object)

    return run(text)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least ``percent`` of their union in common."""
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .where(F.size("x") > 0)
        .join(right, "b")
        .where((F.size("x") * 100 >= F.size("y") * percent) & (F.size("y") * 100 >= F.size("x") * percent))
        .where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent)
        .select("a", "b")
    )


def _index(hubs) -> tuple:
    """Of an Arrow table (b, keys, y) of hubs: the elements of their sets in order, whose each is, sizes of sets, names, keys."""
    y = hubs["y"].combine_chunks()
    sizes = y.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = y.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(values, kind="stable")
    return values[order], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order], sizes, hubs["b"].to_pylist(), [frozenset(k) for k in hubs["keys"].to_pylist()]


def _alike_hubs(x: np.ndarray, keys, index: tuple, percent: int) -> list[int]:
    """The hubs under one of ``keys`` whose sets have at least ``percent`` of their union with ``x`` in common."""
    values, whose, sizes, _, key_sets = index
    low = np.searchsorted(values, x)
    n = np.searchsorted(values, x, "right") - low
    at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
    shared = np.bincount(whose[at], minlength=len(sizes))
    alike = np.flatnonzero((shared > 0) & (shared * 100 >= (len(x) + sizes - shared) * percent))
    return [int(i) for i in alike if not key_sets[i].isdisjoint(keys)]


def _met(rest: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect what the members ``rest`` (key, node) and the hubs ``chosen`` (key, b) of their bands that are alike connect.

    A task holds the hubs' sets and reads each member once, so no row is made of a pair that is not alike; hubs that a task has connected
    are not connected by it again. Hubs of more than HUB_BYTES are held in as many turns as they need, one after the other."""
    spark = rest.sparkSession
    held = chosen.groupBy("b").agg(F.collect_set("key").alias("keys")).join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    held = common.written(held, "hubs")
    turns = max(1, -(-int(held.agg(F.sum(F.size("y") + F.size("keys"))).first()[0] or 0) * 8 // HUB_BYTES))
    members = rest.groupBy("node").agg(F.collect_set("key").alias("keys")).join(sets, "node")
    if turns > 1:
        members = common.written(members, "asked")
    out = None
    for turn in range(turns):
        sent = spark.sparkContext.broadcast(_index(held.where(F.pmod(F.xxhash64("b"), F.lit(turns)) == turn).toArrow()))  # HUB_BYTES or so

        def run(batches, sent=sent):
            index = sent.value
            names, up = index[3], list(range(len(index[3])))

            def top(i):
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            for batch in batches:
                found = []
                for node, keys, shingles in zip(batch["node"], batch["keys"], batch["shingles"], strict=True):
                    node = bytes(node)
                    first = None
                    for i in _alike_hubs(np.asarray(shingles, np.int64), keys, index, percent):
                        if first is None:
                            first = top(i)
                            if names[i] != node:
                                found.append((node, names[i]))
                            own = names[i]
                        elif top(i) != first:
                            up[top(i)] = first
                            found.append((own, names[i]))
                yield pd.DataFrame(found, columns=["a", "b"])

        part = common.written(members.mapInPandas(run, "a binary, b binary"), "alike")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    common.forget(held, *[members] * (turns > 1))
    return out


def _resembling(best: DataFrame, docs: DataFrame, text: str, width: int, percent: int, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of the sets that resemble another one, or that edges ``more`` (a, b) tie to one: the least of all that they are connected with.

    In bands of more than PAIRWISE members, all of them meet the band's hubs. Members become hubs until those that have not been one are all
    connected with the band's first hub; two that resemble each other then have met, or are connected already. First there is one hub a band;
    of what it leaves, all become hubs where they and the band's members make MEETINGS pairs at most, else ever more of them, GROWTH times in each round."""
    keyed = common.written(best.select(F.explode("keys").alias("key"), "node"), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = common.written(keyed.join(sizes, "key"), "shared")
    common.forget(keyed)
    k1, k2 = common.text_keys(F.coalesce(F.col(text), F.lit("")))
    wanted = common.written(best.join(shared.select("node").distinct(), "node", "left_semi").select("node", "row.k1", "row.k2"), "wanted")
    held = docs.select(k1.alias("k1"), k2.alias("k2"), F.col(text).alias("t")).join(_small(wanted, BROADCAST_KEYS), ["k1", "k2"])
    sets = common.written(held.groupBy("node").agg(F.first("t").alias("t")).select("node", _set(F.col("t"), width).alias("shingles")), "sets")
    few = shared.where(F.col("n") <= PAIRWISE)
    pairs = few.select("key", F.col("node").alias("a")).join(few.select("key", F.col("node").alias("b")), "key").where("a < b").select("a", "b").distinct()
    edges = common.written(_alike(pairs, sets, percent).distinct(), "alike")
    if more is not None:
        edges = edges.unionByName(more)
    members = common.written(shared.where(F.col("n") > PAIRWISE).select("key", "node", "n"), "members")
    pool, lead, roots, hubs = members, None, None, 1
    while not pool.isEmpty():
        # the most central members of a band: those whose bands are the largest together
        ranked = pool.join(pool.groupBy("node").agg(F.sum("n").alias("reach")), "node")
        if lead:
            ranked = common.labelled(ranked, pool.groupBy("key").agg(F.count("*").alias("rest")), "key", "node")
        name = F.xxhash64("node")
        slot = F.when(F.col("rest") * F.col("n") <= MEETINGS, name).otherwise(F.pmod(name, F.lit(hubs))) if lead else F.lit(0)
        chosen = ranked.groupBy("key", slot.alias("slot")).agg(F.max_by("node", F.struct("reach", "node")).alias("b"))
        chosen = common.written(chosen.select("key", "b"), "hubs")
        asked = common.labelled(members, chosen.select("key").distinct(), "key", "node") if lead else members
        met = _met(asked, chosen, sets, percent)
        lead = lead or chosen
        roots = _joined(roots, met) if roots else common.written(common.components(edges.unionByName(met), "a", "b"), "roots")
        first = lead.join(roots, lead.b == roots.node, "left").select("key", F.coalesce("root", "b").alias("first"))
        left = pool.join(chosen.withColumnRenamed("b", "node"), ["key", "node"], "left_anti").join(roots, "node", "left")
        left = common.labelled(left, first, "key", "node").where(F.coalesce("root", "node") != F.col("first")).select("key", "node", "n")
        pool = common.written(left, "pool")
        hubs *= GROWTH
    common.forget(shared, wanted, sets)
    return roots or common.written(common.components(edges, "a", "b"), "roots")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) after more ``edges``: only those between different groups are looked at, as edges between their roots."""
    own = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a").distinct()
    known = common.written(ends.join(own, "a", "left").select("a", F.coalesce("ra", "a").alias("ra")), "ends")
    crossing = common.labelled(edges, known, "a", "b").select("b", "ra")
    crossing = common.labelled(crossing, known.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "ra").where("ra <> rb").select("ra", "rb").distinct()
    crossing = common.written(crossing, "crossing")
    if crossing.isEmpty():
        return roots
    merged = common.written(common.components(crossing, "ra", "rb").select(F.col("node").alias("ra"), F.col("root").alias("to")), "merged")
    every = roots.unionByName(known.join(own.select("a"), "a", "left_anti").select(F.col("a").alias("node"), F.col("ra").alias("root")))
    every = every.withColumn("ra", F.col("root"))
    met = common.labelled(every, merged, "ra", "node").select("node", F.col("to").alias("root"))
    return common.written(met.unionByName(every.join(merged, "ra", "left_anti").select("node", "root")), "roots")


def _fingerprint_edges(per_row: DataFrame) -> DataFrame:
    """Edges (a, b) between sets, whose components are those of their linked fingerprints: the sets of a fingerprint are tied to the
    least of them, and these least ones as their fingerprints are."""
    known = common.written(per_row.select("fp", "node").distinct(), "fingerprints")
    least = common.written(known.groupBy("fp").agg(F.min("node").alias("b"), F.count("*").alias("n")), "least")
    own = common.labelled(known, least.where("n > 1"), "fp", "node").select(F.col("node").alias("a"), "b")
    between = links(least.select("fp"))  # a fingerprint has few
    between = between.join(least.select(F.col("fp").alias("a"), F.col("b").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("b").alias("y")), "b")
    return own.unionByName(between.select(F.col("x").alias("a"), F.col("y").alias("b"))).where("a <> b")


def keep_unlike(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, linked: bool = False) -> DataFrame:
    """``docs`` with one row of each group of similar texts, chosen as in :func:`keep_one`.

    Texts are linked where the Jaccard similarity of their shingles is ``percent`` or more, and texts linked through others are of
    one group; with ``linked``, so are those of one component of :func:`near_duplicates`. Null and empty texts and those of fewer words than a shingle are sets of their own kind: equal ones are one group. Texts of
    any length count whole; repeated rows are one; ties go to the least id, null last; an empty table stays empty; other columns stay."""
    common.small_batches(docs.sparkSession)
    fp = [fingerprint(F.col(text)).alias("fp")] if linked else []
    per_row = common.written(docs.select(_sketch(F.col(text), width).alias("s"), _rank(docs, doc_id, text).alias("row"), *fp).select("s.*", "row", *["fp"][: len(fp)]), "sketches")
    best = common.written(per_row.groupBy("node").agg(F.min("row").alias("row"), F.first("keys").alias("keys")), "best")
    roots = _resembling(best, docs, text, width, percent, common.written(_fingerprint_edges(per_row), "linked") if linked else None)
    roots = roots.withColumnRenamed("node", "of")
    grouped = best.join(roots, best.node == F.col("of"), "left").select(F.coalesce("root", "node").alias("root"), "row")
    stay = common.written(grouped.groupBy("root").agg(F.min("row").alias("row")).select("row.*"), "stay")
    return _staying(docs, per_row, stay, doc_id, text)


def op10_simhash_pigeonring(spark, sf_dir: str) -> DataFrame:
    """SimHash near-duplicate components over all documents."""
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
