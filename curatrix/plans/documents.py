"""Queries over documents and conversations: text rules, vocabularies, enrichment, scores, keys, ranking.

The first line of a document plays the title, the whole text the description, the source the
repository."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions import vocab as V
from curatrix.operators import enrich as E
from curatrix.operators import quality as Q
from curatrix.sources.connectors import query_terms
from curatrix.sources.tables import table

#: Vocabularies over the words of this corpus, in the form of the real ones.
TOPICS = {"reaction": ["anon", "ention", "anat"], "motion": ["thon", "the on", "inges"], "german": ["und", "der"], "french": ["les", "des"]}
TOOLS = ("on", "of", "le", "que")
LETTERS = "[^a-z0-9_]"


def documents(spark, d):
    return table(spark, d, "documents").withColumn("title", F.substring_index("text", "\n", 1))


def q_title_norm(spark, d):
    return documents(spark, d).select("doc_id", T.title_norm(F.col("title")).alias("title_norm"))


def q_license(spark, d):
    line = F.lower(F.regexp_extract("text", r"(?i)(licensed under[^\n]*|public license[^\n]*)", 1))
    return documents(spark, d).select("doc_id", T.license_label(F.when(line != "", line), ascii_only=True).alias("license"))


def q_vocab_context(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(V.acquisition_labels(F.col("text"), TOPICS, TOOLS), ",").alias("labels"))


def _tiers():
    def found(c):
        return V.let(F.lower(c), lambda t: V.labels(t, TOPICS))

    declared = F.when(F.col("source").isin("src1", "src2"), F.array(F.lit("declared"))).otherwise(F.array().cast("array<string>"))
    return V.tiers(("structured", declared), ("title", found(F.col("title"))), ("description", found(F.col("text"))))


def q_evidence_tier(spark, d):
    return documents(spark, d).withColumn("e", _tiers()).select("doc_id", F.array_join("e.labels", ",").alias("labels"), "e.tier")


def q_enrich(spark, d):
    """Fills only what is empty, and says what was filled."""
    x = documents(spark, d).withColumns({"e": _tiers(), "declared_lang": F.when(F.col("doc_id") % 3 == 0, F.col("lang"))})
    trail = F.array_compact(
        F.array(
            F.when(F.col("e.tier") != "structured", F.concat(F.lit("topic:"), F.col("e.tier"))),
            F.when(F.col("declared_lang").isNull() & F.col("lang").isNotNull(), F.lit("lang:metadata")),
        )
    )
    return x.select("doc_id", F.coalesce(F.element_at("e.labels", 1), F.lit("")).alias("topic"), F.coalesce("declared_lang", "lang").alias("lang"), F.array_join(trail, ",").alias("trail"))


#: The real vocabularies, each with a label over the words of this corpus.
FIELDS = {field: vocabulary | {f"corpus {field}": tokens} for (field, vocabulary), tokens in zip(E.VOCABULARIES.items(), (["anon"], ["thon"], ["inges"], ["ention"], ["anat"], ["les", "und"]), strict=True)}


def q_enrich_fields(spark, d):
    """All eight fields of every document, some of them declared."""
    k, none = F.col("doc_id"), F.array().cast("array<string>")
    x = documents(spark, d).select(
        k,
        F.when(k % 2 == 0, "ebrains").otherwise(F.col("source")).alias("source"),
        "title",
        F.col("text").alias("description"),
        F.when(k % 5 == 0, F.array(F.lit("Anxiety"), F.lit("adult Rats"))).alias("keywords"),
        F.when(k % 3 == 0, F.array(F.col("n_chars"), F.lit(None).cast("bigint"))).alias("sizes"),
        F.when(k % 7 == 0, F.array(F.lit("Resting State"), F.lit("motor"))).otherwise(none).alias("meta_task"),
        F.when(k % 11 == 0, F.array(F.lit("fMRI"), F.lit("MEG"))).alias("meta_modality"),
        F.when(k % 4 == 0, "declared").otherwise("").alias("disease"),
    )
    trail = F.transform("enrichment", lambda e: F.concat_ws(":", e["field"], e["source"], e["confidence"]))
    out = E.enrich(x, FIELDS)
    return out.select("doc_id", "access_tier", "size_label", "region", "age_group", "disease", "task", *[F.array_join(c, ",").alias(c) for c in E.LISTS], F.array_join(trail, ",").alias("trail"))


def _scored(spark, d):
    x = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    trust = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "stale").otherwise("unverified")
    s = Q.score(F.col("title"), F.col("text"), F.col("lang") == "en", F.col("lang").isin("de", "fr"), F.col("toxic").isNotNull(), F.col("n_chars") - 100, trust, F.col("source").endswith("1"))
    b = Q.bonus(F.col("lang").isNotNull(), F.col("n_chars") > 500, F.col("n_chars") > 1000, F.col("quality").isNotNull(), F.col("toxic") == 1, F.col("source") == "src1", F.col("n_chars") > 2000)
    return x.withColumns({"score": s, "bonus": b})


def q_score(spark, d):
    return _scored(spark, d).select("doc_id", "score")


def q_score_ext(spark, d):
    return _scored(spark, d).select("doc_id", F.round(F.least(F.lit(1.0), F.col("score") + F.col("bonus")), 4).alias("score"))


def q_score_stats(spark, d):
    return _scored(spark, d).groupBy("source").agg(F.round(F.avg("score"), 4).alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n"))


def q_size_label(spark, d):
    return documents(spark, d).select("doc_id", T.size_label(F.col("n_chars") * 1037 + F.col("doc_id")).alias("label"))


def q_coverage(spark, d):
    """How many rows have each field: a pass over the table, then one row per field."""
    x = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    fields = ("text", "lang", "source", "n_chars", "quality", "toxic")
    one = x.agg(F.count("*").alias("total"), *[F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f) for f in fields])
    long = one.unpivot("total", list(fields), "field", "non_null")
    return long.select("field", "total", "non_null", (F.col("total") - F.col("non_null")).alias("missing"), F.coalesce(F.round(F.try_divide(F.col("non_null") * 100.0, F.col("total")), 1), F.lit(0.0)).alias("pct"))


def q_value_counts(spark, d):
    x = documents(spark, d)
    parts = [x.groupBy(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen")) for c in ("lang", "source")]
    return parts[0].unionByName(parts[1])


def q_repo_counts(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"))


def q_post_filter(spark, d):
    """Documents whose declared language is in the family of the wanted one, or undeclared but with evidence."""
    x = documents(spark, d).withColumn("modality", F.when(F.col("doc_id") % 4 != 0, F.array(F.when(F.col("lang") == "en", "functional mri").when(F.col("lang") == "de", "mri").otherwise("eeg"))))
    ok = Q.post_filter(F.col("modality"), F.array("source"), ("fMRI",), ("src1", "SRC2", "src3"), Q.evidence_gate(F.col("modality"), F.col("text")))
    return x.where(ok).select("doc_id")


def q_evidence_gate(spark, d):
    return documents(spark, d).select("doc_id", Q.evidence_gate(F.array().cast("array<string>"), F.col("title"), F.col("text")).alias("evidence"))


MODALITY_PROBES = ("the", "eeg", "th", "on", "pet", "er")
REGION_PROBES = ("inea", "thea", "hand", "stand")


def _users(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def q_query_terms(spark, d):
    """A structured value, then the free words of a query, without repeats and typing errors, 500 characters."""
    words = F.filter(F.split(F.col("text"), "[ \\t\\n\\r]+"), lambda w: w != "")
    return _users(spark, d).select("conv_id", "turn", query_terms([F.array(F.lit("dataset"))], words).alias("terms"))


def q_heuristic_parse(spark, d):
    t = F.lower(F.col("text"))
    out = _users(spark, d).select(
        "conv_id",
        "turn",
        F.array_join(F.array_compact(F.array(*[F.when(t.contains(p), F.lit(p)) for p in MODALITY_PROBES])), ",").alias("modality"),
        F.coalesce(*[F.when(t.contains(p), F.lit(p)) for p in REGION_PROBES]).alias("region"),
        F.when(t.contains("child") | t.contains("kid"), "child").when(t.contains("adult"), "adult").alias("age_range"),
    )
    return out.withColumn("in_domain", (F.col("modality") != "") | F.col("region").isNotNull() | F.col("age_range").isNotNull())


def q_pool_summary(spark, d):
    """Pools of all sources put together, with what each gave and what failed."""
    x = documents(spark, d)
    pools = x.select("source", F.lit(False).alias("failed")).unionByName(x.where("n_chars < 50").select("source", F.lit(True).alias("failed")))
    return pools.groupBy("source").agg(F.count_if(~F.col("failed")).alias("n_found"), F.count_if(F.col("failed")).alias("n_failed"))


def q_dedup_keys(spark, d):
    """Exact copies: one row per text with its winner and losers."""
    return documents(spark, d).groupBy(F.md5("text").alias("key")).agg(F.min("doc_id").alias("winner"), (F.count("*") - 1).alias("losers")).where("losers > 0")


def q_winner(spark, d):
    """The winner of each key: best score, then lowest id."""
    x = _scored(spark, d).withColumn("key", F.md5("text"))
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), "doc_id")
    return x.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("key", "doc_id", "score")


def q_facet_filter(spark, d):
    """Extension: documents by facets, counted by language and length class."""
    x = documents(spark, d).where(F.col("lang").isin("en", "de") & (F.col("n_chars") >= 100))
    return x.groupBy("lang", F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("length")).agg(F.count("*").alias("n"))


def q_text_rank(spark, d):
    """Extension: weighted term frequency, title ten times the text; a top-20 report."""
    def times(c, term):
        return F.size(F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b{term}\b"), F.lit(0)))

    score = sum((times(F.col("title"), t) * 10 + times(F.col("text"), t) for t in ("the", "thea")), F.lit(0))
    return documents(spark, d).select("doc_id", score.cast("long").alias("rank_score")).orderBy(F.col("rank_score").desc(), "doc_id").limit(20)


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q_")}

D = r"""WITH d AS (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)"""


def _has(text, tokens):
    """A whole word, letters and digits of all scripts being parts of words."""
    edge = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
    return f"regexp_matches({text}, '(^|{edge})({'|'.join(tokens)})($|{edge})')"


def _labels(text):
    cases = ", ".join(f"CASE WHEN {_has(text, t)} THEN '{label}' END" for label, t in TOPICS.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_TIER = f"""{D}, t AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN ['declared'] ELSE [] END AS a, {_labels('lower(title)')} AS b, {_labels('lower(text)')} AS c FROM d),
 e AS (SELECT *, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b WHEN len(c) > 0 THEN c END AS found,
              CASE WHEN len(a) > 0 THEN 'structured' WHEN len(b) > 0 THEN 'title' WHEN len(c) > 0 THEN 'description' END AS tier FROM t)"""


def _word(text, tokens):
    """A whole word, letters and digits of all scripts being parts of words."""
    some = "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-").replace("'", "''") for t in tokens)
    edge = r"[^\p{L}\p{M}\p{N}\p{Pc}]"
    return f"regexp_matches({text}, '(^|{edge})({some})($|{edge})')"


def _found(field, text):
    cases = ", ".join(f"CASE WHEN {_word(text, ts)} THEN '{label}' END" for label, ts in FIELDS[field].items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_CLEAN = r"""array_to_string(list_filter(string_split(regexp_replace({c}, '([.!?;])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s) <> '' AND NOT %s), ' ' || chr(10) || ' ')""" % _word("s", V.TOOL_WORDS)


def _enriched():
    texts = {"title": "t", "keywords": "w", "description": "x"}
    json = {"task": "CASE WHEN doc_id % 7 = 0 THEN ['resting-state', 'motor'] END", "modality": "CASE WHEN doc_id % 11 = 0 THEN ['meg', 'fmri'] END"}
    columns, fields, trail = [], [], []
    for f in FIELDS:
        found = {"json": json[f]} if f in json else {}
        found |= {name: _found(f, _CLEAN.replace("{c}", c) if f == "modality" else c) for name, c in texts.items()}
        declared = "doc_id % 4 = 0" if f == "disease" else "false"
        columns.append(f"CASE WHEN {declared} THEN NULL " + " ".join(f"WHEN len({e}) > 0 THEN ({{'v': {e}, 's': '{f}:{n}:{E.CONFIDENCE[n]}'}})" for n, e in found.items()) + f" END AS {f}")
        value = f"array_to_string({f}.v, ',')" if f in E.LISTS else f"{f}.v[1]"
        fields.append(f"coalesce({value}, CASE WHEN {declared} THEN 'declared' ELSE '' END) AS {f}" if f == "disease" else f"{value} AS {f}")
        trail.append(f"{f}.s")
    return f"""{D}, d2 AS (SELECT *, lower(coalesce(title, '')) AS t, CASE WHEN doc_id % 5 = 0 THEN 'anxiety adult rats' ELSE '' END AS w, lower(coalesce(text, '')) AS x,
        CASE WHEN doc_id % 2 = 0 THEN 'registered' END AS access_tier, CASE WHEN doc_id % 3 = 0 AND n_chars > 0 THEN n_chars END AS n FROM d),
      f AS (SELECT *, {", ".join(columns)} FROM d2),
      g AS (SELECT *, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN replace(printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB', '.0 ', ' ') END AS size_label FROM f)
      SELECT doc_id, access_tier, size_label, {", ".join(fields)},
        array_to_string(list_filter([CASE WHEN access_tier IS NOT NULL THEN 'access_tier:source' END, CASE WHEN size_label IS NOT NULL THEN 'size_label:files' END, {", ".join(trail)}], lambda s: s IS NOT NULL), ',') AS trail FROM g"""


_SCORE = f"""{D}, s AS (SELECT d.*, quality, toxic,
  round(least((CASE WHEN length(title) > 5 THEN 0.15::DOUBLE ELSE 0 END) + (CASE WHEN length(text) > 20 THEN 0.10::DOUBLE ELSE 0 END)
   + least((CASE WHEN lang = 'en' THEN 0.07::DOUBLE ELSE 0 END) + (CASE WHEN lang IN ('de', 'fr') THEN 0.06::DOUBLE ELSE 0 END) + (CASE WHEN toxic IS NOT NULL THEN 0.06::DOUBLE ELSE 0 END) + (CASE WHEN n_chars > 100 THEN 0.06::DOUBLE ELSE 0 END), 0.25::DOUBLE)
   + (CASE WHEN quality = 1 THEN 0.25::DOUBLE WHEN quality = 0 THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END) + (CASE WHEN ends_with(source, '1') THEN 0.25::DOUBLE ELSE 0 END), 1.0::DOUBLE), 4) AS score,
  round(least(0.15::DOUBLE, 0.04::DOUBLE * ((lang IS NOT NULL)::INT + (n_chars > 500)::INT + (n_chars > 1000)::INT + (quality IS NOT NULL)::INT + coalesce(toxic = 1, false)::INT + (source = 'src1')::INT + (n_chars > 2000)::INT)), 4) AS bonus
  FROM d LEFT JOIN labels USING (doc_id))"""
_LINE = r"lower(regexp_extract(text, '(?i)(licensed under[^\n]*|public license[^\n]*)', 1))"
_TERMS = "(" + " OR ".join(f"contains(x, '{t}')" for t in Q.EVIDENCE_TERMS) + ")"

SQL = {
    # the titles hold no compatibility forms, so that the canonical form is theirs as well
    "q_title_norm": D + r""" SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(nfc_normalize(title)), '\s+', ' ', 'g')), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '\s+', ' ', 'g')), '') AS title_norm FROM d""",
    "q_license": f"{D}, l AS (SELECT doc_id, trim(regexp_replace({_LINE}, '\\s+', ' ', 'g')) AS x FROM d) SELECT doc_id, CASE WHEN x = '' THEN NULL WHEN regexp_matches(x, '{T.NO_LICENSE}') AND length(x) < 40 THEN NULL "
    + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{label}'" for label, p in T.LICENSES)
    + " END AS license FROM l",
    "q_vocab_context": rf"""{D}, s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: lower(s)), lambda s: trim(s) <> '' AND NOT {_has('s', TOOLS)}) AS ss FROM d)
      SELECT doc_id, array_to_string({_labels("array_to_string(ss, ' ' || chr(10) || ' ')")}, ',') AS labels FROM s""",
    "q_evidence_tier": _TIER + " SELECT doc_id, array_to_string(found, ',') AS labels, tier FROM e",
    "q_enrich": _TIER + """ SELECT doc_id, coalesce(found[1], '') AS topic, lang, array_to_string(list_filter([CASE WHEN tier <> 'structured' THEN 'topic:' || tier END, CASE WHEN doc_id % 3 <> 0 AND lang IS NOT NULL THEN 'lang:metadata' END], lambda x: x IS NOT NULL), ',') AS trail FROM e""",
    "q_enrich_fields": _enriched(),
    "q_score": _SCORE + " SELECT doc_id, score FROM s",
    "q_score_ext": _SCORE + " SELECT doc_id, round(least(1.0::DOUBLE, score + bonus), 4) AS score FROM s",
    "q_score_stats": _SCORE + " SELECT source, round(avg(score), 4) AS mean, min(score) AS least, max(score) AS most, count(*) AS n FROM s GROUP BY source",
    "q_size_label": D + r""", n AS (SELECT doc_id, n_chars * 1037 + doc_id AS n FROM d) SELECT doc_id, CASE WHEN n <= 0 THEN NULL WHEN n < 1024 THEN n || ' B'
      WHEN n < 1048576 THEN replace(printf('%.1f', round(n / 1024.0::DOUBLE, 1)) || ' KB', '.0 ', ' ') WHEN n < 1073741824 THEN replace(printf('%.1f', round(n / 1048576.0::DOUBLE, 1)) || ' MB', '.0 ', ' ') END AS label FROM n""",
    "q_coverage": D + ", x AS (SELECT d.*, quality, toxic FROM d LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, count(*) AS total, count(*) FILTER (trim({f}::VARCHAR) <> '') AS non_null, count(*) - count(*) FILTER (trim({f}::VARCHAR) <> '') AS missing, round(count(*) FILTER (trim({f}::VARCHAR) <> '') * 100.0::DOUBLE / count(*), 1) AS pct FROM x"
        for f in ("text", "lang", "source", "n_chars", "quality", "toxic")
    ),
    "q_value_counts": "SELECT 'lang' AS field, lang AS value, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents GROUP BY ALL",
    "q_repo_counts": "SELECT source, count(*) AS n_docs, count(DISTINCT lang) AS n_langs FROM documents GROUP BY source",
    "q_post_filter": f"SELECT doc_id FROM (SELECT *, lower(text) AS x FROM documents) WHERE (CASE WHEN doc_id % 4 <> 0 THEN lang IN ('en', 'de') ELSE {_TERMS} END) AND source IN ('src1', 'src2', 'src3')",
    "q_evidence_gate": f"{D}, x AS (SELECT doc_id, lower(title || ' ' || text) AS x FROM d) SELECT doc_id, {_TERMS} AS evidence FROM x",
    "q_query_terms": r"""SELECT conv_id, turn, substr('dataset' || coalesce(' ' || (SELECT string_agg(w, ' ' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) WHERE w <> '' AND lower(w) <> 'dataset'
      AND NOT list_bool_or(list_transform(range(1, greatest(length(w) - 1, 2)), lambda k: length(w) > 2 AND substr(lower(w), k, 1) = substr(lower(w), k + 1, 1) AND substr(lower(w), k, 1) = substr(lower(w), k + 2, 1))) GROUP BY w)), ''), 1, 500) AS terms
      FROM (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', ' ', 'g'), ' ') AS ws FROM conversations WHERE role = 'user')""",
    "q_heuristic_parse": "SELECT *, modality <> '' OR region IS NOT NULL OR age_range IS NOT NULL AS in_domain FROM (SELECT conv_id, turn, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{p}' END" for p in MODALITY_PROBES)
    + "], lambda x: x IS NOT NULL), ',') AS modality, CASE "
    + " ".join(f"WHEN contains(t, '{p}') THEN '{p}'" for p in REGION_PROBES)
    + " END AS region, CASE WHEN contains(t, 'child') OR contains(t, 'kid') THEN 'child' WHEN contains(t, 'adult') THEN 'adult' END AS age_range FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations WHERE role = 'user'))",
    "q_pool_summary": "SELECT source, count(*) AS n_found, count(*) FILTER (n_chars < 50) AS n_failed FROM documents GROUP BY source",
    "q_dedup_keys": "SELECT md5(text) AS key, min(doc_id) AS winner, count(*) - 1 AS losers FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q_winner": _SCORE + ", r AS (SELECT *, md5(text) AS key, row_number() OVER (PARTITION BY md5(text) ORDER BY score DESC, doc_id) AS r FROM s) SELECT key, doc_id, score FROM r WHERE r = 1",
    "q_facet_filter": "SELECT lang, CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS length, count(*) AS n FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 100 GROUP BY ALL",
    "q_text_rank": D + r""", x AS (SELECT doc_id, regexp_extract_all(lower(title), '[\p{L}\p{M}\p{N}\p{Pc}]+') AS a, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}\p{Pc}]+') AS b FROM d)
      SELECT doc_id, 10 * len(list_filter(a, lambda w: w IN ('the', 'thea'))) + len(list_filter(b, lambda w: w IN ('the', 'thea'))) AS rank_score FROM x ORDER BY rank_score DESC, doc_id LIMIT 20""",
}
