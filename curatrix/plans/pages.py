"""Queries over pages: addresses, filters, classification, extraction."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from curatrix.functions import identity as I
from curatrix.functions import text as T
from curatrix.operators import quality as Q
from curatrix.sources.tables import table

ALLOWED = ("example.com", "example.org")
BLOCKED = ("spam-farm.example.org", "cheap-pills.example.com")
ENDINGS = (".html", ".pdf")
#: An address of this corpus: language and number, as the record patterns of the catalogs are.
RECORDS = tuple((lang, rf"^https?://[^/?#]+/{lang}/([0-9]+)", "PAGE:%06d" if lang == "en" else None) for lang in ("en", "de", "fr", "es"))
TITLE = r"(?is)<title[^>]*>(.*?)</title>"


def pages(spark, d):
    return table(spark, d, "pages")


def q_url_key(spark, d):
    return pages(spark, d).select("page_id", I.url_key(F.col("url")).alias("url_key"))


def q_host_counts(spark, d):
    return pages(spark, d).groupBy(I.host_of(F.col("url")).alias("host"), I.domain_family(F.col("url")).alias("family")).agg(F.count("*").alias("n"))


def q_url_flags(spark, d):
    u = F.col("url")
    return pages(spark, d).select(
        "page_id", Q.is_direct(u, ENDINGS).alias("direct"), Q.is_landing(u, ("example.com", "example.net"), ("/en/",), ENDINGS).alias("landing"), Q.is_document(F.lit(""), u).alias("document")
    )


def q_url_identity(spark, d):
    return pages(spark, d).select("page_id", I.record_identity(F.col("url"), RECORDS).alias("r")).select("page_id", "r.source", "r.source_id")


def q_canonical_id(spark, d):
    return pages(spark, d).select("page_id", I.canonical_id(F.concat(F.lit("url:"), I.url_key(F.col("url")))).alias("canonical_id"))


def q_url_dedup(spark, d):
    return pages(spark, d).groupBy(I.url_key(F.col("url")).alias("url_key")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def q_stage_filter(spark, d):
    p = pages(spark, d).withColumn("source", F.concat(F.lit("src"), F.col("page_id") % 4)).withColumn("title", F.regexp_extract("html", TITLE, 1))
    reason = Q.filter_reason(F.col("source"), F.col("url"), F.col("page_id"), F.when(F.col("page_id") % 11 != 0, F.col("title")), ("src0", "src1", "src2"), ALLOWED, BLOCKED)
    return Q.stage_report(p.withColumn("reason", reason), "filter", "reason")


def _labelled(spark, d):
    p = pages(spark, d).withColumn("title", F.regexp_extract("html", TITLE, 1))
    return p.withColumn("label", Q.content_class(F.col("url"), F.col("title"), known=("example.com", "example.net")))


def q_classify(spark, d):
    return _labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def _verified(spark, d):
    u = F.col("url")
    p = _labelled(spark, d).withColumn("status", F.when(F.col("page_id") % 7 == 0, 404).when(F.col("page_id") % 13 == 0, F.lit(None)).otherwise(200))
    direct = Q.is_direct(u, ENDINGS)
    return p.withColumn("reason", Q.verify_reason(F.col("status"), u, direct, I.host_of(u).startswith("th"), F.col("label"), Q.is_landing(u, ("example.org",), ("/en/",), ENDINGS)))


def q_stage_verify(spark, d):
    return _verified(spark, d).select("page_id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


def q_stage_stats(spark, d):
    classified = _labelled(spark, d).withColumn("reason", F.when(F.col("label").isin(*Q.DROPPED), F.col("label")))
    return Q.stage_report(classified, "classify", "reason").unionByName(Q.stage_report(_verified(spark, d), "verify", "reason"))


def q_html_extract(spark, d):
    h = F.col("html")
    return pages(spark, d).select(
        "page_id",
        T.html_text(F.regexp_extract(h, TITLE, 1)).alias("title"),
        T.html_text(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("h1"),
        F.regexp_extract(h, r'(?i)<html lang="([a-z]+)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(h, F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("n_links"),
        F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(h, F.lit(r'<a href="/([^"]*)"'), F.lit(1)))), "|").alias("slugs"),
    )


def q_html_text(spark, d):
    x = T.html_text(F.col("html"))
    return pages(spark, d).select("page_id", F.length(x).alias("n_chars"), F.md5(x).alias("digest"))


def q_cross_refs(spark, d):
    refs = (("org", ".example.org/"), ("net", ".example.net/"), ("com", ".example.com/"))
    p = pages(spark, d).select("page_id", F.explode(I.cross_references(F.array("url"), refs)).alias("r"))
    return p.select("page_id", "r.repository", "r.id")


def q_shared_urls(spark, d):
    return pages(spark, d).groupBy(I.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n")).where("n > 1")


def q_canonical_target(spark, d):
    """Even pages are stored, odd ones come in: each finds its record by address first, then by host and number."""
    p = pages(spark, d).select("page_id", I.url_key(F.col("url")).alias("url_key"), F.regexp_extract("url", r"/([0-9]+)(?:[/.?#]|$)", 1).alias("number"))
    old, new = p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1")
    by_url = old.groupBy("url_key").agg(F.min("page_id").alias("by_url"))
    by_number = old.groupBy("number").agg(F.min("page_id").alias("by_number"))
    out = new.join(by_url, "url_key", "left").join(by_number, "number", "left")
    return out.select(
        "page_id",
        F.coalesce("by_url", "by_number").alias("target"),
        F.when(F.col("by_url").isNotNull(), "url").when(F.col("by_number").isNotNull(), "number").otherwise("new").alias("via"),
    )


def q_entry(spark, d):
    p = _labelled(spark, d).withColumn("url_key", I.url_key(F.col("url")))
    best = p.withColumn("rank", F.row_number().over(Window.partitionBy("url_key").orderBy("page_id"))).where("rank = 1")
    reason = F.when(F.col("label").isin(*Q.DROPPED), "dropped").otherwise("kept")
    return best.groupBy("label", reason.alias("outcome")).agg(F.count("*").alias("n"))


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q_")}


def _in(xs):
    return "(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _any(text, xs):
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in xs) + ")"


def _under(xs):
    return "(" + " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in xs) + ")"


def _direct():
    ends = "|".join(e.replace(".", r"\.") for e in ENDINGS)
    return rf"(contains(lower(url), 'dataset_description.json') OR regexp_matches(lower(url), '(?:{ends})(?:$|[?#])'))"


def _landing(hosts, markers, direct):
    return f"(CASE WHEN host = '' OR NOT {_under(hosts)} THEN false WHEN {direct} OR {_any('lower(path)', markers)} THEN false ELSE true END)"


BASE = r"""WITH p AS (
  SELECT *, regexp_replace(full_host, '^www\.', '') AS host,
         'http://' || regexp_replace(full_host, '^www\.', '') || regexp_replace(path, '/+$', '') AS url_key
  FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS full_host,
               regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
               regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title
        FROM pages)
)"""

_PDF = "ends_with(split_part(split_part(lower(url), '?', 1), '#', 1), '.pdf')"
_LABEL = f"""CASE
  WHEN {_any("lower(title || ' ' || url)", Q.DOCUMENT_TERMS)} OR {_PDF} THEN 'documentation'
  WHEN host IN {_in(Q.PAPER_HOSTS)} THEN 'paper'
  WHEN host IN {_in(Q.BLOG_HOSTS)} OR contains(lower(path), '/blog') OR contains(host, 'blog.') OR host = 'blog' THEN 'blog'
  WHEN host IN {_in(Q.FORUM_HOSTS)} OR {_any('lower(title)', Q.FORUM_TERMS)} THEN CASE WHEN host IN {_in(Q.SOFTWARE_HOSTS)} THEN 'software' ELSE 'forum' END
  WHEN host IN {_in(Q.DOCUMENT_HOSTS)} THEN 'documentation'
  WHEN host IN {_in(Q.SOFTWARE_HOSTS)} OR {_any('lower(title)', Q.SOFTWARE_TERMS)} THEN 'software'
  WHEN {_landing(('example.com', 'example.net'), Q.DATASET_PATHS, r"(contains(lower(url), 'dataset_description.json') OR regexp_matches(lower(url), '(?:" + "|".join(e.replace(".", chr(92) + ".") for e in Q.DATA_ENDINGS) + ")(?:$|[?#])'))")} THEN 'documentation'
  WHEN {_under(('example.com', 'example.net'))} AND {_any('lower(path)', Q.DATASET_PATHS)} THEN CASE WHEN {_any('lower(path)', Q.COLLECTION_PATHS)} THEN 'dataset_collection' ELSE 'dataset' END
  ELSE 'unknown' END"""
_LABELLED = f"{BASE}, l AS (SELECT *, {_LABEL} AS label FROM p)"
_VERIFIED = f"""{_LABELLED}, v AS (SELECT *, CASE
  WHEN page_id % 7 = 0 OR page_id % 13 = 0 THEN 'dead_link'
  WHEN {_landing(('example.org',), ('/en/',), _direct())} THEN 'repo_landing_page'
  WHEN NOT {_direct()} AND NOT starts_with(host, 'th') THEN 'unverifiable'
  WHEN label = 'unknown' AND NOT {_direct()} THEN 'unclassifiable' ELSE 'accepted' END AS reason FROM l)"""
_CLEAN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ')"""

SQL = {
    "q_url_key": BASE + " SELECT page_id, url_key FROM p",
    "q_host_counts": BASE + r" SELECT host, CASE WHEN full_host LIKE '%.%' THEN array_to_string(list_slice(string_split(full_host, '.'), -2, -1), '.') ELSE full_host END AS family, count(*) AS n FROM p GROUP BY ALL",
    "q_url_flags": f"{BASE} SELECT page_id, {_direct()} AS direct, {_landing(('example.com', 'example.net'), ('/en/',), _direct())} AS landing, ({_any('lower(url)', Q.DOCUMENT_TERMS)} OR {_PDF}) AS document FROM p",
    "q_url_identity": r"""SELECT page_id, CASE WHEN m THEN lang END AS source, CASE WHEN m THEN CASE WHEN lang = 'en' THEN 'PAGE:' || lpad(n, greatest(6, length(n))::INT, '0') ELSE n END END AS source_id
      FROM (SELECT page_id, regexp_matches(url, '^https?://[^/?#]+/(en|de|fr|es)/([0-9]+)') AS m, regexp_extract(url, '^https?://[^/?#]+/(en|de|fr|es)/([0-9]+)', 1) AS lang,
                   regexp_extract(url, '^https?://[^/?#]+/(en|de|fr|es)/([0-9]+)', 2) AS n FROM pages)""",
    "q_canonical_id": BASE + " SELECT page_id, 'ns-' || substr(sha1('url:' || url_key), 1, 16) AS canonical_id FROM p",
    "q_url_dedup": BASE + " SELECT url_key, min(page_id) AS page_id, count(*) AS n FROM p GROUP BY url_key",
    "q_stage_filter": f"""{BASE} SELECT 'filter' AS stage, CASE
      WHEN page_id % 4 = 3 THEN 'source_disabled' WHEN host = '' OR NOT {_under(ALLOWED)} THEN 'domain_not_allowlisted'
      WHEN host IN {_in(BLOCKED)} THEN 'blocklisted' WHEN page_id % 11 = 0 OR title = '' THEN 'missing_required' ELSE 'accepted' END AS reason, count(*) AS n FROM p GROUP BY ALL""",
    "q_classify": _LABELLED + " SELECT label, count(*) AS n, min(page_id) AS first_page FROM l GROUP BY label",
    "q_stage_verify": _VERIFIED + " SELECT page_id, reason FROM v",
    "q_stage_stats": f"{_VERIFIED} SELECT 'classify' AS stage, CASE WHEN label IN {_in(Q.DROPPED)} THEN label ELSE 'accepted' END AS reason, count(*) AS n FROM v GROUP BY ALL UNION ALL SELECT 'verify', reason, count(*) FROM v GROUP BY ALL",
    "q_html_extract": rf"""SELECT page_id, {_CLEAN.replace('{x}', "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
      {_CLEAN.replace('{x}', "regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")} AS h1, regexp_extract(html, '(?i)<html lang="([a-z]+)"', 1) AS lang,
      len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS n_links,
      array_to_string(list_sort(list_distinct(regexp_extract_all(html, '<a href="/([^"]*)"', 1))), '|') AS slugs FROM pages""",
    "q_html_text": f"SELECT page_id, length(x)::INT AS n_chars, md5(x) AS digest FROM (SELECT page_id, {_CLEAN.replace('{x}', 'html')} AS x FROM pages)",
    "q_cross_refs": r"""SELECT page_id, repository, id FROM (
      SELECT page_id, repository, trim(split_part(split_part(trim(substr(lower(url), strpos(lower(url), prefix) + length(prefix))), '/', 1), '?', 1)) AS id
      FROM pages, (VALUES ('org', '.example.org/'), ('net', '.example.net/'), ('com', '.example.com/')) r(repository, prefix) WHERE contains(lower(url), prefix)) WHERE id <> ''""",
    "q_shared_urls": BASE + " SELECT host, count(*) AS n FROM p GROUP BY host HAVING count(*) > 1",
    "q_canonical_target": BASE + r""", k AS (SELECT page_id, url_key, regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) AS number FROM p),
      u AS (SELECT url_key, min(page_id) AS by_url FROM k WHERE page_id % 2 = 0 GROUP BY 1), n AS (SELECT number, min(page_id) AS by_number FROM k WHERE page_id % 2 = 0 GROUP BY 1)
      SELECT page_id, coalesce(by_url, by_number) AS target, CASE WHEN by_url IS NOT NULL THEN 'url' WHEN by_number IS NOT NULL THEN 'number' ELSE 'new' END AS via
      FROM k LEFT JOIN u USING (url_key) LEFT JOIN n USING (number) WHERE page_id % 2 = 1""",
    "q_entry": f"{_LABELLED}, b AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS r FROM l) SELECT label, CASE WHEN label IN {_in(Q.DROPPED)} THEN 'dropped' ELSE 'kept' END AS outcome, count(*) AS n FROM b WHERE r = 1 GROUP BY ALL",
}
