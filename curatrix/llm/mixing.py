"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end; its tokens are cut into blocks of
nearly equal length. The schedule is a van der Corput sequence: point t of 2**k is t with its k bits
reversed, and the points are mapped through the cumulated slot counts of the sources, so each prefix
of the schedule holds every source close to its share. The slots of a source are ranked; slot r reads
block r modulo the number of its blocks, so the second pass begins when every block has been read
once. A source stops at its target: its last slot reads only the first words of its block, so a source of a few
words meets its target as closely as a large one.

All prefix sums and ranks have two levels (sums of buckets, then rows inside a bucket), so a source
that holds a third of all rows is spread over thousands of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm import common

#: Words in a block.
BLOCK = 128
#: A source is read this often at most.
REPEATS = 3
#: Slots ranked together.
CHUNK_BITS = 16
#: Hex digits of the shuffle key that make a bucket.
BUCKET_DIGITS = 3


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, key): the size in words and the shuffle key of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.regexp_count(body, F.lit(r"[^ \t-\r]+")).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), body)).alias("key"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target and the layout of its blocks and slots. The ranking of
    the sources runs in one task: some millions of them at most, one row each.

    Sources by code point, null last, weigh 1, 2, 3 and so on again; all sizes together are shared by
    weight. No target exceeds REPEATS times its source: with a common rate per weight, the sources of
    the smallest size per weight are filled first, and the rate is that of the first one which the
    rest can fill. The windows run over one row per source."""
    by_name, by_fill = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("fill", "sid")
    everything = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(by_name)).withColumn("weight", (F.col("sid") - 1) % 3 + 1)
    s = s.withColumn("fill", F.col("source_size").cast("double") * REPEATS / F.col("weight"))
    s = s.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "full": F.coalesce(F.sum(F.col("source_size") * REPEATS).over(before), F.lit(0)),
            "open": F.sum("weight").over(after),
        }
    ).withColumn("rate", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
    s = s.withColumn("rate", F.min(F.when(F.col("fill") >= F.col("rate"), F.struct("fill", "sid", "rate"))).over(everything)["rate"])
    s = s.withColumn("target", F.least(F.col("source_size").cast("double") * REPEATS, F.col("rate") * F.col("weight")))
    size = F.col("source_size")
    s = s.withColumn("blocks", F.ceil(size / BLOCK).cast("long"))
    short = F.when(F.col("blocks") > 0, F.floor(size / F.col("blocks"))).cast("long")
    s = s.withColumn("short", short).withColumn("longer", size - F.col("short") * F.col("blocks"))  # so many blocks have a word more
    # whole words to take: full passes, then the slots of the last pass, of which the last ends part-way
    s = s.withColumn("words", F.floor(F.col("target") + 0.5).cast("long")).withColumn("over", F.when(size > 0, F.pmod("words", size)).otherwise(0).cast("long"))
    s = s.withColumn("last", F.when(F.col("over") > 0, _block(F.col("over") - 1)))
    s = s.withColumn("cut", F.when(F.col("over") > 0, F.col("over") - _bound(F.col("last"))).cast("long"))
    slots = F.floor((F.col("words") - F.col("over")) / size) * F.col("blocks") + F.coalesce(F.col("last") + 1, F.lit(0))
    s = s.withColumn("slots", F.when(size > 0, slots).otherwise(0).cast("long"))
    up_to = by_name.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"upto": F.sum("slots").over(up_to), "all_slots": F.sum("slots").over(everything)})
    # 2**bits is at least twice the slots, so that every source finds its slots among the points
    s = s.withColumn("bits", F.when(F.col("all_slots") > 0, F.ceil(F.log2(F.col("all_slots") * 2.0))).otherwise(0).cast("int"))
    scale = F.pow(F.lit(2.0), F.col("bits")) / F.nullif(F.col("all_slots"), F.lit(0))
    s = s.withColumns(
        {
            "low": F.ceil((F.col("upto") - F.col("slots")) * scale).cast("long"),
            "high": F.ceil(F.col("upto") * scale).cast("long"),
        }
    )
    return s.select("sid", "source", "source_size", "target", "blocks", "slots", "bits", "low", "high", "short", "longer", "cut")


def _reversed(x: Column, bits: Column) -> Column:
    """The low bits of ``x`` (62 at most) in reverse order."""
    pairs = ((1, 0x5555555555555555), (2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF))
    for by, mask in pairs:
        x = F.shiftrightunsigned(x, by).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(mask)), by))
    x = F.shiftrightunsigned(x, 32).bitwiseOR(F.shiftleft(x, 32))
    return F.call_function("shiftrightunsigned", x, F.lit(64) - bits)


def schedule(sources: DataFrame) -> DataFrame:
    """Slots (sid, t, rank, block, cut): in the order of ``t``, block ``block`` of source ``sid`` is read; where
    ``cut`` is not null, only so many words of it."""
    step = 1 << CHUNK_BITS
    spans = (
        sources.where("slots > 0")
        .select("sid", "slots", "blocks", "bits", "cut", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(step))).alias("from"))
        .repartition("sid", "from")
    )
    points = spans.select(
        "sid", "slots", "blocks", "bits", "cut", F.explode(F.sequence("from", F.least(F.col("from") + step, F.col("high")) - 1)).alias("x")
    ).select("sid", "slots", "blocks", "cut", _reversed(F.col("x"), F.col("bits")).alias("t"))
    points = points.withColumn("chunk", F.shiftright("t", CHUNK_BITS))
    counts = points.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("sid", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("t")
    return (
        points.join(counts.hint("merge"), ["sid", "chunk"])
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .where("rank < slots")
        .select("sid", "t", "rank", (F.col("rank") % F.col("blocks")).alias("block"), F.when(F.col("rank") == F.col("slots") - 1, F.col("cut")).alias("cut"))
    )


def _bound(b: Column) -> Column:
    return b * F.col("short") + F.least(b, F.col("longer"))


def _block(at: Column) -> Column:
    edge = F.col("longer") * (F.col("short") + 1)
    return F.when(at < edge, F.floor(at / (F.col("short") + 1))).otherwise(F.col("longer") + F.floor((at - edge) / F.col("short"))).cast("long")


def placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the layout of their source and ``start``, the place of their first word in it."""
    r = rows.join(F.broadcast(sources) if sources.count() <= 100_000 else sources, rows.source.eqNullSafe(sources.source)).drop(sources.source)
    r = r.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = r.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return r.join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + F.sum("size").over(inside) - F.col("size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken.

    ``taken`` counts the words that the schedule reads from the row, repeats included; it is REPEATS
    times the size at most. Null texts have size 0 and nothing is taken from them; null sources are a
    source, the last one; repeated rows are rows like others, each with its own place; an empty table,
    or one without words, gives targets of 0."""
    rows = common.written(sized(docs, doc_id, text, source), "sized")
    sources = common.written(targets(rows), "sources")
    uses = schedule(sources).groupBy("sid", "block").agg(F.count_if(F.col("cut").isNull()).alias("uses"), F.max("cut").alias("cut"))
    at = common.written(placed(rows, sources).select("doc_id", "source", "size", "source_size", "target", "sid", "start", "short", "longer"), "placed")
    common.forget(rows)
    end = F.col("start") + F.col("size")
    parts = (
        at.where("size > 0")
        .select("sid", "start", "size", "short", "longer", F.explode(F.sequence(_block(F.col("start")), _block(end - 1))).alias("block"))
        .withColumn("words", F.least(end, _bound(F.col("block") + 1)) - F.greatest(F.col("start"), _bound(F.col("block"))))
        .withColumn("before", F.greatest(F.col("start"), _bound(F.col("block"))) - _bound(F.col("block")))
        .select("sid", "start", "block", "words", "before")
    )
    # of the slot that ends part-way, what of it lies in the row
    partly = F.when(F.col("cut").isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.col("words"), F.col("cut") - F.col("before"))))
    # slots come from exploded ranges, whose number Spark can't estimate: it must not broadcast them
    taken = parts.join(uses.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(F.col("words") * F.col("uses") + partly).alias("taken"))
    # rows without words share their start with the next row and take nothing
    return (
        at.withColumn("place", F.when(F.col("size") > 0, F.col("start")).otherwise(-1 - F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))))
        .join(taken.withColumnRenamed("start", "place").hint("merge"), ["sid", "place"], "left")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def op1_low_discrepancy_mix(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(common.table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents
), a AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "BINARY" ASC NULLS LAST) AS sid
  FROM rows GROUP BY source
), b AS (
  SELECT *, (sid - 1) % 3 + 1 AS weight, source_size::DOUBLE * 3 / ((sid - 1) % 3 + 1) AS fill FROM a
), c AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY fill, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY fill, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS part
  FROM b
), d AS (
  SELECT *, least(source_size::DOUBLE * 3, weight * (SELECT part FROM c WHERE fill >= part ORDER BY fill, sid LIMIT 1)) AS target,
         ceil(source_size / 128.0)::BIGINT AS blocks
  FROM c
), g AS (
  SELECT *, source_size // blocks AS short, source_size % blocks AS longer, floor(target + 0.5)::BIGINT AS words FROM d
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN words % source_size ELSE 0 END AS over FROM g
), i AS (
  SELECT *, CASE WHEN over = 0 THEN NULL WHEN over - 1 < longer * (short + 1) THEN (over - 1) // (short + 1) ELSE longer + (over - 1 - longer * (short + 1)) // short END::BIGINT AS last FROM h
), e AS (
  SELECT *, over - last * short - least(last, longer) AS cut, CASE WHEN source_size > 0 THEN (words - over) // source_size * blocks + coalesce(last + 1, 0) ELSE 0 END AS slots FROM i
), f AS (
  SELECT *, sum(slots) OVER (ORDER BY sid) AS upto, ceil(log2(sum(slots) OVER () * 2.0))::INT AS bits, sum(slots) OVER () AS all_slots FROM e
), s AS (
  SELECT *, ceil((upto - slots) * ((1::BIGINT << bits)::DOUBLE / all_slots))::BIGINT AS low, ceil(upto * ((1::BIGINT << bits)::DOUBLE / all_slots))::BIGINT AS high
  FROM f WHERE source_size > 0
), points AS (
  SELECT sid, slots, blocks, cut, list_sum(list_transform(range(0, bits), lambda i: ((x >> i) & 1) << (bits - 1 - i))) AS t
  FROM (SELECT sid, slots, blocks, cut, bits, unnest(range(low, high)) AS x FROM s)
), uses AS (
  SELECT sid, block, count(*) FILTER (part IS NULL) AS uses, max(part) AS cut FROM (
    SELECT sid, slots, r % blocks AS block, r, CASE WHEN r = slots - 1 THEN cut END AS part FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY t) - 1 AS r FROM points))
  WHERE r < slots GROUP BY ALL
), placed AS (
  SELECT row_number() OVER () AS rid, r.*, s.sid, s.short, s.longer,
         sum(size) OVER (PARTITION BY s.sid ORDER BY key ROWS UNBOUNDED PRECEDING) - size AS start
  FROM rows r JOIN s ON r.source IS NOT DISTINCT FROM s.source
), parts AS (
  SELECT rid, sid, block, least(start + size, (block + 1) * short + least(block + 1, longer)) - greatest(start, block * short + least(block, longer)) AS words,
         greatest(0, start - block * short - least(block, longer)) AS before
  FROM (SELECT *, unnest(range(
          (CASE WHEN start < longer * (short + 1) THEN start // (short + 1) ELSE longer + (start - longer * (short + 1)) // short END)::BIGINT,
          (CASE WHEN start + size - 1 < longer * (short + 1) THEN (start + size - 1) // (short + 1)
                ELSE longer + (start + size - 1 - longer * (short + 1)) // short END)::BIGINT + 1)) AS block
        FROM placed WHERE size > 0)
), taken AS (
  SELECT rid, sum(words * uses + CASE WHEN cut IS NULL THEN 0 ELSE greatest(0, least(words, cut - before)) END) AS taken FROM parts JOIN uses USING (sid, block) GROUP BY rid
)
SELECT p.doc_id, p.source, p.size, e.source_size, e.target, coalesce(taken, 0)::BIGINT AS taken
FROM placed p JOIN e ON p.source IS NOT DISTINCT FROM e.source LEFT JOIN taken USING (rid)
UNION ALL
SELECT r.doc_id, r.source, r.size, e.source_size, e.target, 0 FROM rows r JOIN e ON r.source IS NOT DISTINCT FROM e.source WHERE e.source_size = 0
"""
