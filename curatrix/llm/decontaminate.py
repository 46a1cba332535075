"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: numbers, units after numbers and names (words that begin with one capital, also
at the start of a sentence) turn into typed placeholders, all else is folded to lower case without
punctuation. Windows of eight template words are hashed and joined to the windows of the benchmark; windows
of hardly anything but placeholders are hashed with their own words, so they match verbatim only. Matches
must line up on one diagonal (document position minus item position) in a run of at least six windows, so
thirteen words, which holds seven literal words or is the item's own text.

The slots of a run must be consistent: all along, one value of the item stands for the one document value
that it met first. A slot that breaks this cuts the run there; what lies before and after is judged by
itself. So an item with other numbers or names in it is caught, while texts that merely share phrases of
placeholders are not.

An item of five to twelve words is one window: a document must hold all of it, with consistent slots and
five literal words, or verbatim. Its first five words are the join key. Items of fewer than five words are
ordinary phrases and match nothing.

All is done for two templates: with names typed, and with names folded like other words. A copy in
small letters or capitals shows no names and matches by the second one.

Documents are probed at every sixth window only: any run of six holds one of them, so nothing is
lost; where the benchmark has short items, at every word for these. The few documents with a match are then
looked at in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm import common

WIDTH = 8
RUN = 6
#: Words from which an item is matched by runs of windows; shorter ones whole.
LONG = WIDTH + RUN - 1
#: Words of the shortest item that is looked for, and of the key of short items.
SHORT = 5
#: Placeholders in a window up to which it is joined by its template; beyond, by its own words too.
SLOTS = 6
#: The same of the key of a short item.
SHORT_SLOTS = 3
#: Literal words of a run, and of a short item, that is not verbatim.
LITERALS, SHORT_LITERALS = 7, 5

#: Units of measure recognised after a number. Fixed values.
UNITS = (
    "kg", "g", "mg", "t", "km", "m", "cm", "mm", "mi", "ft", "l", "ml", "s", "ms", "min", "h", "hr", "hrs",
    "hours", "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "week", "months", "month",
    "years", "year", "kmh", "mph", "meters", "metres", "miles", "feet", "inches", "dollars", "euros", "cents",
    "usd", "eur", "percent", "degrees", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "ghz", "w", "kw", "v",
)


def _plain(text: Column) -> Column:
    """Words parted by one space. Signs of arithmetic that stand alone are words; all symbols but sentence ends are gone."""
    # each pattern begins with what few characters are, so that most are passed over at once
    x = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), r"[\t-\r][ \t-\r]*+| [ \t-\r]++", " ")
    x = F.regexp_replace(x, r"(?=[^\p{L}\p{Nd} .!?:])(?:(?<= )([+*/=<>^-]++)(?= |$)|[^\p{L}\p{Nd} .!?:]++)", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r" [.!?:]++(?= |$)", ""), "  +", " "))


def _template(plain: Column, names: bool = True) -> Column:
    """The same words with placeholders: # a number, @ a name (unless they are folded), ~ a unit."""
    x = F.regexp_replace(plain, r"(?<![^ ])[^ \p{Nd}]*+\p{Nd}[^ ]*+", "#")
    if names:
        x = F.regexp_replace(x, r"\p{Lu}(?<![^ ].)\p{Ll}[^ ]*+", "@")
    return F.regexp_replace(_folded(x), r"# (?:" + "|".join(UNITS) + r")(?![^ ])", "# ~")


def _folded(plain: Column) -> Column:
    return F.lower(F.regexp_replace(plain, r"[.!?:]+", ""))


def _value(word: Column) -> Column:
    """What stands in a slot: the word without closing punctuation."""
    return F.regexp_replace(word, r"[.!?:]+$", "")


def _literal(word: Column) -> Column:
    return ~word.isin("#", "@", "~", "")


def _columns(text: Column) -> list[Column]:
    """Arrays of the same length: the words, the folded words, and the two templates."""
    plain = _plain(text)
    named = {"raw": plain, "bare": _folded(plain), "tpl": _template(plain), "low": _template(plain, names=False)}
    return [F.split(x, " ").alias(n) for n, x in named.items()]


def _windows(words: Column, bare: Column, step: int, width: int = WIDTH, slots: int = SLOTS) -> Column:
    """Structs (at, h) of the windows at every step-th word."""
    last = F.size(words) - width
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))

    def named(i: Column) -> Column:
        part = F.slice(words, i + 1, width)
        dense = F.size(F.filter(part, _literal)) < width - slots
        return F.when(dense, F.xxhash64(part, F.slice(bare, i + 1, width))).otherwise(F.xxhash64(part))

    return F.transform(at, lambda i: F.struct(i.alias("at"), named(i).alias("h")))


def _short_windows(words: Column, bare: Column) -> Column:
    return _windows(words, bare, 1, SHORT, SHORT_SLOTS)


def _both(rows: DataFrame, windows, width: int, *keep: str) -> DataFrame:
    """One row for each window of both templates: ``keep``, folded, at, h, and ``width`` words and template words from there."""
    parts = [
        rows.select(*keep, "raw", F.col(c).alias("typed"), F.lit(c == "low").alias("folded"), F.explode(windows(F.col(c), F.col("bare"))).alias("w"))
        for c in ("tpl", "low")
    ]
    return parts[0].unionByName(parts[1]).select(
        *keep, "folded", "w.at", "w.h", F.slice("raw", F.col("w.at") + 1, width).alias("words"), F.slice("typed", F.col("w.at") + 1, width).alias("template")
    )


def _all_windows(words: Column, bare: Column) -> Column:
    return _windows(words, bare, 1)


def benchmark_words(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, item_key, raw, bare, tpl, low): each different item once; ``item_key`` names it, also without an id."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = benchmark.select(F.col(item_id).alias("item_id"), body.alias("body")).distinct()
    return rows.select("item_id", F.xxhash64("item_id", "body").alias("item_key"), *_columns(F.col("body")))


def _long_runs(held: DataFrame, bench: DataFrame) -> DataFrame:
    """(k1, k2, item_id, item_key, folded, n, run) of the consistent runs of items of LONG words or more."""
    items = _both(bench, _all_windows, WIDTH, "item_id", "item_key").withColumnsRenamed({"at": "item_at", "words": "item_words", "template": "item_template"})
    pairs = (
        _both(held, _all_windows, WIDTH, "k1", "k2").drop("template")
        .join(common.small(items), ["folded", "h"])
        .withColumn("diagonal", F.col("at") - F.col("item_at"))
        .select("k1", "k2", "item_id", "item_key", "folded", "diagonal", "item_at", "words", "item_words", "item_template")
    )
    line = ["k1", "k2", "item_key", "folded", "diagonal"]  # ids may be null
    # consecutive item positions share position minus rank; a line is no longer than its item
    island = F.col("item_at") - F.row_number().over(Window.partitionBy(*line).orderBy("item_at"))
    pairs = common.written(pairs.withColumn("island", island), "pairs")
    slots = (
        pairs.select(*line, "island", "item_at", F.posexplode(F.arrays_zip("item_template", "item_words", "words")).alias("i", "s"))
        .where(F.col("s.item_template").isin("#", "@", "~"))
        .select(*line, "island", (F.col("item_at") + F.col("i")).alias("place"), _value(F.col("s.item_words")).alias("value"), _value(F.col("s.words")).alias("stands"))
        .distinct()
    )
    first = F.first("stands").over(Window.partitionBy(*line, "island", "value").orderBy("place"))
    torn = slots.withColumn("first", first).where("stands != first").select(*line, F.explode(F.sequence(F.col("place") - WIDTH + 1, "place")).alias("item_at")).distinct()
    whole = pairs.join(torn, line + ["item_at"], "left_anti").withColumn("island", island)
    fold = lambda w: _folded(w)
    whole = whole.select(
        *line,
        "item_id",
        "island",
        "item_at",
        F.size(F.filter("item_template", _literal)).alias("literals"),
        _literal(F.col("item_template")[WIDTH - 1]).cast("int").alias("last"),
        (F.transform("words", fold) == F.transform("item_words", fold)).alias("same"),
    )
    verbatim = whole.where("same").withColumn("island", island)
    runs = (
        whole.withColumn("only", F.lit(False)).unionByName(verbatim.withColumn("only", F.lit(True)))
        .groupBy(*line, "only", "island")
        # the literal words of the first window and the last word of each further one
        .agg(F.first("item_id").alias("item_id"), F.count("*").alias("n"), (F.min_by(F.col("literals") - F.col("last"), "item_at") + F.sum("last")).alias("literals"))
    )
    # a verbatim run lies inside a run of the template, which then counts as a whole
    found = runs.groupBy(*line).agg(
        F.first("item_id").alias("item_id"),
        F.max(F.when(~F.col("only"), F.col("n"))).alias("run"),
        F.sum(F.when(~F.col("only"), F.col("n"))).alias("n"),
        F.max((F.col("n") >= RUN) & (F.col("only") | (F.col("literals") >= LITERALS))).alias("enough"),
    )
    return found.where("enough").groupBy("k1", "k2", "item_id", "item_key", "folded").agg(F.sum("n").alias("n"), F.max("run").alias("run"))


def _short_matches(held: DataFrame, bench: DataFrame) -> DataFrame:
    """(k1, k2, item_id, item_key, folded, n, run): n places that hold all of an item of fewer than LONG words; run is 1."""
    items = [
        bench.select("item_id", "item_key", F.col(c).alias("item_template"), F.col("raw").alias("item_words"), F.lit(c == "low").alias("folded"), F.explode(_short_windows(F.col(c), F.col("bare"))).alias("w"))
        for c in ("tpl", "low")
    ]
    items = items[0].unionByName(items[1]).where("w.at = 0").select("item_id", "item_key", "folded", "item_template", "item_words", "w.h")
    size = F.size("item_template")
    met = (
        _both(held, _short_windows, LONG - 1, "k1", "k2")
        .join(common.small(items), ["folded", "h"])
        .where(F.slice("template", 1, size) == F.col("item_template"))
        .withColumn("words", F.slice("words", 1, size))
    )
    zipped = F.filter(F.arrays_zip("item_template", "item_words", "words"), lambda s: ~_literal(s["item_template"]))
    slots = F.array_distinct(F.transform(zipped, lambda s: F.struct(_value(s["item_words"]).alias("v"), _value(s["words"]).alias("w"))))
    fold = lambda w: _folded(w)
    literals = F.size(F.filter("item_template", _literal))
    same = F.transform("words", fold) == F.transform("item_words", fold)
    met = met.withColumn("slots", slots).where(F.size(F.array_distinct(F.transform("slots", lambda s: s["v"]))) == F.size("slots"))
    return met.where(same | (literals >= SHORT_LITERALS)).groupBy("k1", "k2", "item_id", "item_key", "folded").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("run"))


def leaks(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows (k1, k2, item_id, n_windows, run): texts that hold thirteen words of an item, or all of a shorter one.

    ``k1, k2`` name a text (:func:`curatrix.llm.common.text_keys`); ``n_windows`` counts the windows of
    the item found on consistent runs, ``run`` is the longest of these; both are those of the typed
    template where it matches, else of the folded one. For a short item they are the places and 1. Null or
    empty texts and items, and items of fewer than five words, match nothing; repeated items each match,
    different texts of one id are one item of that id (the most of each figure counts); empty tables give no
    rows; very long texts and items are read whole; other columns are not read."""
    body = F.coalesce(F.col(text), F.lit(""))
    k1, k2 = common.text_keys(body)
    bench = common.written(benchmark_words(benchmark, item_id, item_text).where(F.size("raw") >= SHORT), "benchmark")
    short, long = bench.where(F.size("raw") < LONG), bench.where(F.size("raw") >= LONG)
    brief = not short.isEmpty()
    # columns of their own: inside a lambda an expression would be worked out for every window
    words = docs.select(k1.alias("k1"), k2.alias("k2"), *_columns(body))

    def probes(windows) -> DataFrame:
        hashes = [F.transform(windows(F.col(c), F.col("bare")), lambda w: w["h"]) for c in ("tpl", "low")]
        # most texts have few names, so that their two templates share most windows
        return words.select("k1", "k2", F.explode(F.array_union(*hashes)).alias("h"))

    def keys(items: DataFrame, windows, first: bool) -> DataFrame:
        all_ = [items.select(F.explode(windows(F.col(c), F.col("bare"))).alias("w")) for c in ("tpl", "low")]
        found = all_[0].unionByName(all_[1])
        return common.small((found.where("w.at = 0") if first else found).select("w.h").distinct())

    hits = probes(lambda w, b: _windows(w, b, RUN)).join(keys(long, _all_windows, False), "h", "left_semi")
    if brief:
        hits = hits.unionByName(probes(_short_windows).join(keys(short, _short_windows, True), "h", "left_semi"))
    hits = common.written(hits.select("k1", "k2").distinct(), "hits")
    held = docs.select(k1.alias("k1"), k2.alias("k2"), body.alias("body")).join(common.small(hits), ["k1", "k2"], "left_semi")
    held = common.written(held.dropDuplicates(["k1", "k2"]).select("k1", "k2", *_columns(F.col("body"))), "held")
    found = _long_runs(held, long)
    if brief:
        found = found.unionByName(_short_matches(held, short))
    out = (
        found.groupBy("k1", "k2", "item_id", "item_key")
        .agg(F.min_by(F.struct("n", "run"), "folded").alias("r"))
        .groupBy("k1", "k2", "item_id")
        .agg(F.max("r.n").alias("n_windows"), F.max("r.run").alias("run"))
    )
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds benchmark material; null texts and repeated clean rows stay."""
    found = common.small(common.written(leaks(docs, benchmark, text).select("k1", "k2").distinct(), "leaks"))
    k1, k2 = common.text_keys(F.coalesce(F.col(text), F.lit("")))
    n1, n2 = common.unused(docs, "k1", "k2")
    marked = docs.withColumns({n1: k1, n2: k2})
    return marked.join(found.withColumnsRenamed({"k1": n1, "k2": n2}), [n1, n2], "left_anti").select(*docs.columns)


def op2_template_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, verbatim or with other numbers and names: one row per
    document and item (doc_id, item_id, n_windows, run); clean documents give none."""
    docs = common.table(spark, sf_dir, "documents")
    found = common.written(leaks(docs, common.table(spark, sf_dir, "benchmark")), "leaks")
    k1, k2 = common.text_keys(F.coalesce(F.col("text"), F.lit("")))
    return (
        docs.select("doc_id", k1.alias("k1"), k2.alias("k2"))
        .join(common.small(found), ["k1", "k2"])
        .select("doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.col("run").cast("long").alias("run"))
    )


OP2_SQL = r"""
WITH src AS (
  SELECT 'd' AS kind, row_number() OVER () AS rid, doc_id AS id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)
), plain AS (
  SELECT kind, rid, id,
         list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g'), ' '), lambda w:
           CASE WHEN regexp_full_match(w, '[+*/=<>^-]+') THEN w ELSE regexp_replace(w, '[^\p{L}\p{Nd}.!?:]+', '', 'g') END),
           lambda w: NOT regexp_full_match(w, '[.!?:]*')) AS raw
  FROM src
), bare AS (
  SELECT *, list_transform(raw, lambda w: lower(regexp_replace(w, '[.!?:]+', '', 'g'))) AS bare FROM plain WHERE kind = 'd' OR len(raw) >= 5
), half AS (
  SELECT kind, rid, id, raw, bare, false AS folded,
         list_transform(raw, lambda w, i: CASE WHEN regexp_matches(w, '\p{Nd}') THEN '#' WHEN regexp_matches(w, '^\p{Lu}\p{Ll}') THEN '@' ELSE bare[i] END) AS half
  FROM bare
  UNION ALL SELECT kind, rid, id, raw, bare, true, list_transform(raw, lambda w, i: CASE WHEN regexp_matches(w, '\p{Nd}') THEN '#' ELSE bare[i] END) FROM bare
), tpl AS (
  SELECT kind, rid, id, raw, bare, folded,
         list_transform(half, lambda w, i: CASE WHEN i > 1 AND half[i - 1] = '#'
           AND regexp_full_match(w, '(__UNITS__)') THEN '~' ELSE w END) AS tpl
  FROM half
), win AS (
  SELECT kind, rid, id, folded, raw[i:i + 7] AS words, bare[i:i + 7] AS bare, tpl[i:i + 7] AS tpl, i,
         len(list_filter(tpl[i:i + 7], lambda w: w NOT IN ('#', '@', '~', ''))) AS literals
  FROM (SELECT *, unnest(range(1, len(tpl) - 6)) AS i FROM tpl WHERE len(tpl) >= CASE kind WHEN 'd' THEN 8 ELSE 13 END)
), pairs AS (
  SELECT d.rid, b.rid AS bid, d.id AS doc_id, b.id AS item_id, d.folded, d.i - b.i AS diagonal, b.i AS pos, d.words, b.words AS item_words, b.tpl, b.literals, d.bare = b.bare AS same
  FROM win d JOIN win b ON d.kind = 'd' AND b.kind = 'b' AND d.folded = b.folded AND d.tpl = b.tpl WHERE d.literals >= 2 OR d.bare = b.bare
), lined AS (
  SELECT *, pos - row_number() OVER (PARTITION BY rid, bid, folded, diagonal ORDER BY pos) AS island FROM pairs
), slot AS (
  SELECT DISTINCT rid, bid, folded, diagonal, island, pos + j - 1 AS place, regexp_replace(item_words[j], '[.!?:]+$', '') AS v, regexp_replace(words[j], '[.!?:]+$', '') AS w
  FROM (SELECT *, unnest(range(1, 9)) AS j FROM lined) WHERE tpl[j] IN ('#', '@', '~')
), torn AS (
  SELECT DISTINCT rid, bid, folded, diagonal, unnest(range(place - 7, place + 1)) AS pos FROM (
    SELECT *, first_value(w) OVER (PARTITION BY rid, bid, folded, diagonal, island, v ORDER BY place) AS f FROM slot) WHERE w <> f
), whole AS (
  SELECT * FROM pairs ANTI JOIN torn USING (rid, bid, folded, diagonal, pos)
), runs AS (
  SELECT rid, bid, doc_id, item_id, folded, diagonal, verb, count(*) AS n,
         arg_min(literals - (tpl[8] NOT IN ('#', '@', '~', ''))::INT, pos) + sum((tpl[8] NOT IN ('#', '@', '~', ''))::INT) AS literals
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY rid, bid, folded, diagonal, verb ORDER BY pos) AS island
        FROM (SELECT *, false AS verb FROM whole UNION ALL SELECT *, true FROM whole WHERE same))
  GROUP BY rid, bid, doc_id, item_id, folded, diagonal, verb, island
), lines AS (
  SELECT rid, bid, doc_id, item_id, folded, max(n) FILTER (NOT verb) AS run, sum(n) FILTER (NOT verb) AS n
  FROM runs GROUP BY rid, bid, doc_id, item_id, folded, diagonal HAVING bool_or(n >= 6 AND (verb OR literals >= 7))
), short AS (
  SELECT d.rid, b.rid AS bid, d.id AS doc_id, b.id AS item_id, d.folded, d.raw[d.i:d.i + len(b.tpl) - 1] AS words, b.raw AS item_words, b.tpl,
         d.bare[d.i:d.i + len(b.tpl) - 1] = b.bare AS same, d.bare[d.i:d.i + 4] = b.bare[1:5] AS same_head
  FROM (SELECT *, unnest(range(1, len(tpl) - 3)) AS i FROM tpl WHERE kind = 'd' AND len(tpl) >= 5 AND EXISTS (SELECT 1 FROM plain WHERE kind = 'b' AND len(raw) BETWEEN 5 AND 12)) d
  JOIN tpl b ON b.kind = 'b' AND len(b.tpl) < 13 AND d.folded = b.folded AND d.tpl[d.i] = b.tpl[1] AND d.tpl[d.i:d.i + len(b.tpl) - 1] = b.tpl
), brief AS (
  SELECT rid, bid, doc_id, item_id, folded, 1 AS run, count(*) AS n FROM (
    SELECT *, list_distinct(list_transform(list_filter(range(1, len(tpl) + 1), lambda j: tpl[j] IN ('#', '@', '~', '')),
             lambda j: {'v': regexp_replace(item_words[j], '[.!?:]+$', ''), 'w': regexp_replace(words[j], '[.!?:]+$', '')})) AS slots FROM short)
  WHERE len(slots) = len(list_distinct(list_transform(slots, lambda s: s.v)))
    AND (same OR (len(list_filter(tpl, lambda w: w NOT IN ('#', '@', '~', ''))) >= 5 AND (same_head OR len(list_filter(tpl[1:5], lambda w: w NOT IN ('#', '@', '~', ''))) >= 2)))
  GROUP BY ALL
), items AS (
  SELECT rid, bid, doc_id, item_id, folded, sum(n) AS n, max(run) AS run FROM (SELECT rid, bid, doc_id, item_id, folded, run, n FROM lines UNION ALL SELECT rid, bid, doc_id, item_id, folded, run, n FROM brief)
  GROUP BY ALL
), best AS (
  SELECT rid, doc_id, item_id, arg_min(n, folded) AS n, arg_min(run, folded) AS run FROM items GROUP BY rid, bid, doc_id, item_id
)
SELECT doc_id, item_id, max(n)::BIGINT AS n_windows, max(run)::BIGINT AS run FROM best GROUP BY rid, doc_id, item_id
""".replace("__UNITS__", "|".join(UNITS))
