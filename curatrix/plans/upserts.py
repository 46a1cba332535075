"""Queries that write to the catalog: the canonical upsert, the records it leaves, provenance as state.

documents plays records and the sources that come in, pages the discovered records, events the discoveries of customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.functions import identity as I
from curatrix.operators import catalog, fold, provenance
from curatrix.sources.tables import table

NOW = "2024-06-01 00:00:00"


# ---------------------------------------------------------------- canonical upsert


def _sides(spark, d):
    """Every fifth document is a record of the catalog, the others come in as sources, in the order of their ids."""
    k = F.col("doc_id")
    x = table(spark, d, "documents").select(
        k.alias("seq"),
        F.format_string("ns-%012d", k).alias("id"),
        F.col("source").alias("repository"),
        F.concat("source", F.lit(":"), F.floor(k / 40)).alias("source_key"),
        F.when(F.col("lang") == "en", F.md5("text")).alias("doi"),
        F.when(k % 4 == 1, F.nullif(F.substring("text", 1, 40), F.lit(""))).alias("url"),
        F.when(k % 9 == 2, F.array(F.concat("source", F.lit(":"), F.floor(k / 40) + 1), F.concat(F.lit("src"), k % 7, F.lit(":"), F.floor(k / 80)))).alias("refs"),
        F.nullif(F.split_part("text", F.lit(" "), F.lit(1)), F.lit("")).alias("title"),
        F.when(k % 3 != 0, F.array(F.split_part("text", F.lit(" "), F.lit(2)), F.split_part("text", F.lit(" "), F.lit(3)))).alias("authors"),
        (F.col("n_chars") % 20).alias("participants"),
        F.array("lang").alias("modality"),
        (2000 + k % 3).cast("int").alias("year"),
        (F.col("n_chars") >= 20).alias("valid"),
        F.col("n_chars"),
    )
    return x.where("seq % 5 = 0"), x.where("seq % 5 <> 0")


def _decisions(spark, d):
    stored, incoming = _sides(spark, d)
    first = stored.groupBy("doi").agg(F.min("id").alias("id"))  # a DOI names one record
    stored = stored.join(first.where("doi is not null").select("id", F.lit(True).alias("_doi")), "id", "left")
    records = stored.select(
        "id", F.when(F.col("_doi"), F.col("doi")).alias("doi"), "url", "title", F.array("source_key").alias("source_keys"), F.array("repository").alias("repositories"), "authors", "participants", "modality", "year", "seq", "n_chars"
    )
    return records, incoming, fold.fold(records, incoming)


def q_canonical_upsert(spark, d):
    """Each source's fate: merged (and how), inserted, or invalid."""
    return _decisions(spark, d)[2]


def q_canonical_records(spark, d):
    """The records after the upsert, each with all its sources."""
    records, incoming, fate = _decisions(spark, d)
    none = F.array().cast("array<int>")
    groups = F.array().cast("array<string>")

    def fields(x):
        return x.withColumns({"ages": F.array((F.col("n_chars") % 90).cast("int")), "age_groups": groups, "disease": F.when(F.col("year") == 2001, F.array("title")).otherwise(groups), "raw": F.col("seq").cast("string")})

    sources = fields(incoming).join(fate.where("target is not null").select("seq", "target", "via"), "seq")
    made = sources.where("via = 'new'")
    base = fields(records).select("id", "title", "doi", "participants", "year", "authors", "modality", "ages", "age_groups", "disease")
    new = made.select("id", *[F.lit(None).cast(base.schema[c].dataType).alias(c) for c in ("title", "doi", "participants", "year")], *[groups.alias(c) for c in ("authors", "modality")], none.alias("ages"), groups.alias("age_groups"), groups.alias("disease"))
    x = sources.drop("id").select(
        F.col("target").alias("id"), "seq", "repository", F.substring_index("source_key", ":", -1).alias("source_id"), "raw", "via", "title", "doi", "participants", "year", "authors", "modality", "ages", "age_groups", "disease",
        F.when(F.col("seq") % 7 != 0, F.col("seq")).alias("at"),
    )
    held = base.unionByName(new).join(records.select("id", "source_keys"), "id", "left")
    out = catalog.absorb(held, x, "id", "seq", ["title", "doi", "participants", "year"], ["authors", "modality"], fill=["disease"], entry="raw", retrieved="at")
    joined = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("authors", "modality", "ages", "age_groups", "disease", "source_keys")]
    return out.select("id", "title", "doi", "participants", "year", *joined, F.array_join(F.transform("sources", lambda s: F.concat(s["key"], F.lit("="), s["entry"])), ",").alias("sources"), "matched_via", "updated_at")


# ---------------------------------------------------------------- provenance


def _events(spark, d):
    k = F.col("event_id")
    none = F.lit(None).cast("string")
    pair = F.array(*[F.struct(F.lit(s).alias("source"), *[none.alias(c) for c in provenance.EVENT_FIELDS[1:4]], F.concat(F.lit(h), k).alias("harvested_at"), none.alias("pipeline_version")) for s, h in (("a", "h"), ("b", "i"))])
    return table(spark, d, "events").select(
        "user_id",
        "event_id",
        F.when(k % 7 != 0, F.col("event_type")).alias("source_repository"),
        F.when(k % 2 == 0, "scan").alias("discovery_method"),
        none.alias("source_api"),
        F.col("props").alias("harvest_query"),
        F.when(k % 5 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("harvested_at"),
        F.lit("v1").alias("pipeline_version"),
        none.alias("dedup_key"),
        F.when(k % 11 == 0, pair).alias("discovery_history"),
        F.lit(None).cast("long").alias("discovery_count"),
        none.alias("first_seen_at"),
        F.when(k % 7 == 0, F.concat(F.lit("l"), k)).alias("last_seen_at"),
    )


def q_provenance_state(spark, d):
    """Customers' stored snapshots with the events of the users of the same number merged in."""
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    past = table(spark, d, "orders").where("o_custkey % 4 = 0")
    event = F.struct(F.col("o_orderpriority").alias("source"), *[none.alias(c) for c in provenance.EVENT_FIELDS[1:4]], F.date_format("o_orderdate", "yyyy-MM-dd").alias("harvested_at"), none.alias("pipeline_version"))
    history = past.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", event.alias("e")))), lambda x: x["e"]).alias("discovery_history"), F.count("*").alias("discovery_count"))
    stored = table(spark, d, "customer").join(history, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        k.alias("user_id"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("source_repository"), none.alias("discovery_method"), none.alias("source_api"), none.alias("harvest_query"), F.concat(F.lit("c"), k).alias("harvested_at"),
        none.alias("pipeline_version"), F.col("c_name").alias("dedup_key"), "discovery_history", "discovery_count", none.alias("first_seen_at"), none.alias("last_seen_at"),
    )
    out = provenance.merge(stored, _events(spark, d), ["user_id"], "event_id", NOW)
    shown = F.array_join(F.transform("discovery_history", lambda e: F.concat_ws("@", e["source"], e["harvested_at"])), ",")
    return out.select("user_id", "source_repository", "discovery_method", "harvest_query", "harvested_at", "dedup_key", "discovery_count", "first_seen_at", "last_seen_at", shown.alias("history"))


def q_upsert_discoveries(spark, d):
    """Every third page is stored, the others are discovered: refreshed by address, by number where they have one, or new."""
    k = F.col("page_id")
    none = F.lit(None).cast("string")
    snapshot = [F.when(k % 4 != 0, F.concat(F.lit("repo"), k % 4)).alias("source_repository"), *[none.alias(c) for c in ("discovery_method", "source_api", "harvest_query")], F.concat(F.lit("t"), k).alias("harvested_at"), none.alias("pipeline_version"), none.alias("dedup_key")]
    state = [F.lit(None).cast(f"array<{provenance.EVENT}>").alias("discovery_history"), F.lit(None).cast("long").alias("discovery_count"), none.alias("first_seen_at"), none.alias("last_seen_at")]
    number = F.regexp_extract("url", r"/([0-9]+)(?:[/.?#]|$)", 1)
    x = table(spark, d, "pages").select(
        k.alias("seq"), I.host_of(F.col("url")).alias("source"), k.cast("string").alias("source_id"), I.url_key(F.col("url")).alias("url_key"), F.when(k % 2 == 0, number).alias("doi"), F.length("html").alias("size"), *snapshot, *state
    )
    stored = x.where("seq % 3 = 0").withColumns({"ingested_at": F.lit("before"), "updated_at": F.lit("before")})
    out = provenance.upsert_discoveries(stored, x.where("seq % 3 <> 0"), "seq", ["size"], NOW)
    shown = F.array_join(F.transform("discovery_history", lambda e: F.concat_ws("@", e["source"], e["harvested_at"])), ",")
    return out.select("source", "source_id", "url_key", "doi", "size", "ingested_at", "updated_at", "outcome", "source_repository", "dedup_key", "discovery_count", "first_seen_at", "last_seen_at", shown.alias("history"))


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q_")}

_FOLD = """WITH RECURSIVE x AS (
  SELECT doc_id AS seq, printf('ns-%012d', doc_id) AS id, source AS repository, source || ':' || doc_id // 40 AS source_key, CASE WHEN lang = 'en' THEN md5(text) END AS doi,
    CASE WHEN doc_id % 4 = 1 THEN nullif(substr(text, 1, 40), '') END AS url, CASE WHEN doc_id % 9 = 2 THEN [source || ':' || (doc_id // 40 + 1), 'src' || doc_id % 7 || ':' || doc_id // 80] ELSE [] END AS refs,
    nullif(split_part(text, ' ', 1), '') AS title, CASE WHEN doc_id % 3 <> 0 THEN [split_part(text, ' ', 2), split_part(text, ' ', 3)] ELSE []::VARCHAR[] END AS authors, n_chars % 20 AS participants, [lang] AS modality,
    (2000 + doc_id % 3)::INT AS year, n_chars >= 20 AS valid, n_chars FROM documents),
stored AS (SELECT * REPLACE (CASE WHEN row_number() OVER (PARTITION BY doi ORDER BY id) = 1 THEN doi END AS doi) FROM x WHERE seq % 5 = 0),
src AS (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM x WHERE seq % 5 <> 0),
f(i, state, done) AS (
  SELECT 0, (SELECT list({'id': id, 'doi': doi, 'url': url, 'title': title, 'keys': [source_key], 'repos': [repository], 'authors': authors, 'participants': participants, 'modality': modality, 'year': year} ORDER BY id) FROM stored),
    {'seq': NULL::BIGINT, 'id': NULL::VARCHAR, 'target': NULL::VARCHAR, 'via': NULL::VARCHAR, 'ambiguous': false}
  UNION ALL
  SELECT i, CASE WHEN via = 'invalid' THEN state
      WHEN via = 'new' THEN list_append(state, {'id': id, 'doi': doi, 'url': url, 'title': title, 'keys': [source_key], 'repos': [repository], 'authors': authors, 'participants': participants, 'modality': modality, 'year': year})
      ELSE list_transform(state, lambda r: CASE WHEN r.id <> target THEN r ELSE {'id': r.id, 'doi': coalesce(r.doi, doi), 'url': r.url, 'title': r.title, 'keys': list_distinct(list_append(r.keys, source_key)), 'repos': list_distinct(list_append(r.repos, repository)),
        'authors': list_distinct(list_concat(r.authors, authors)), 'participants': coalesce(r.participants, participants), 'modality': list_distinct(list_concat(r.modality, modality)), 'year': coalesce(r.year, year)} END) END,
    {'seq': seq, 'id': id, 'target': CASE WHEN via = 'new' THEN id WHEN via <> 'invalid' THEN target END, 'via': via, 'ambiguous': coalesce(len(list_filter(state, lambda r: r.title = title AND r.id IS DISTINCT FROM target)) > 0, false)}
  FROM (SELECT *, coalesce(a, b, c, e, g) AS target, CASE WHEN a IS NOT NULL THEN 'doi' WHEN b IS NOT NULL THEN 'cross_reference' WHEN c IS NOT NULL THEN 'source_url' WHEN e IS NOT NULL THEN 'source_key' WHEN g IS NOT NULL THEN 'multi_field' WHEN valid THEN 'new' ELSE 'invalid' END AS via
    FROM (SELECT s.*, f.state, list_filter(state, lambda r: r.doi = s.doi)[1].id AS a,
      coalesce(list_filter([list_filter(state, lambda r: list_contains(r.keys, s.refs[1]))[1]], lambda r: r.doi IS NULL OR s.doi IS NULL OR r.doi = s.doi)[1].id,
               list_filter([list_filter(state, lambda r: list_contains(r.keys, s.refs[2]))[1]], lambda r: r.doi IS NULL OR s.doi IS NULL OR r.doi = s.doi)[1].id) AS b,
      list_filter([list_filter(state, lambda r: r.url = s.url)[1]], lambda r: r.doi IS NULL OR s.doi IS NULL OR r.doi = s.doi)[1].id AS c,
      list_filter([list_filter(state, lambda r: list_contains(r.keys, s.source_key))[1]], lambda r: r.doi IS NULL OR s.doi IS NULL OR r.doi = s.doi)[1].id AS e,
      list_filter(state, lambda r: r.title = s.title AND NOT list_contains(r.repos, s.repository) AND (r.doi IS NULL OR s.doi IS NULL OR r.doi = s.doi)
        AND list_has_any(r.authors, s.authors)::INT + list_has_any(r.modality, s.modality)::INT + coalesce(r.participants = s.participants, false)::INT + coalesce(r.year = s.year, false)::INT >= 2)[1].id AS g
      FROM f JOIN src s ON s.i = f.i + 1))),
fate AS (SELECT done.seq AS seq, done.id AS id, CASE WHEN done.via = 'new' THEN 'inserted' WHEN done.via = 'invalid' THEN 'invalid' ELSE 'merged' END AS action, done.target AS target, nullif(done.via, 'invalid') AS via, done.ambiguous AS ambiguous FROM f WHERE i > 0)"""
_SHOWN = "array_to_string(list_transform({}, lambda y: y.s || coalesce('@' || y.h, '')), ',')"

SQL = {
    "q_canonical_upsert": _FOLD + " SELECT seq, id, action, target, via, ambiguous FROM fate",
    "q_canonical_records": _FOLD + """, m AS (
      SELECT id, -1 AS o, source_key AS key, NULL::VARCHAR AS raw, NULL::VARCHAR AS via, NULL::BIGINT AS seen, title, doi, participants, year, authors, modality, n_chars % 90 AS age FROM stored
      UNION ALL SELECT t.target, x.seq, x.source_key, x.seq::VARCHAR, t.via, CASE WHEN x.seq % 7 <> 0 THEN x.seq END, x.title, x.doi, x.participants, x.year, x.authors, x.modality, x.n_chars % 90 FROM fate t JOIN x USING (seq) WHERE t.target IS NOT NULL),
    p AS (SELECT id, 'authors' AS f, unnest(authors) AS v, o, generate_subscripts(authors, 1) AS i FROM m UNION ALL SELECT id, 'modality', unnest(modality), o, 1 FROM m UNION ALL SELECT id, 'ages', age::VARCHAR, o, 1 FROM m
      UNION ALL SELECT id, 'groups', CASE WHEN age <= 12 THEN 'Children' WHEN age <= 17 THEN 'Adolescents' WHEN age <= 64 THEN 'Adults' ELSE 'Older Adults' END, o, 1 FROM m UNION ALL SELECT id, 'keys', key, o, 1 FROM m),
    q AS (SELECT id, f, string_agg(v, ',' ORDER BY s) AS v FROM (SELECT id, f, v, min((o, i)) AS s FROM p WHERE v IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    e AS (SELECT id, string_agg(key || '=' || raw, ',' ORDER BY o) AS sources FROM (SELECT id, key, min(o) AS o, arg_max(raw, o) AS raw FROM m WHERE o >= 0 GROUP BY ALL) GROUP BY id)
    SELECT m.id, arg_min(title, o) FILTER (title IS NOT NULL) AS title, arg_min(doi, o) FILTER (doi IS NOT NULL) AS doi, arg_min(participants, o) AS participants, arg_min(year, o) AS year,
      coalesce(any_value(a.v), '') AS authors, coalesce(any_value(b.v), '') AS modality, any_value(c.v) AS ages, any_value(d.v) AS age_groups, coalesce(arg_min(title, o) FILTER (year = 2001 AND title IS NOT NULL), '') AS disease,
      any_value(k.v) AS source_keys, any_value(e.sources) AS sources, arg_max(via, o) FILTER (o >= 0) AS matched_via, arg_max_null(seen, o) AS updated_at
    FROM m LEFT JOIN q a ON a.id = m.id AND a.f = 'authors' LEFT JOIN q b ON b.id = m.id AND b.f = 'modality' LEFT JOIN q c ON c.id = m.id AND c.f = 'ages' LEFT JOIN q d ON d.id = m.id AND d.f = 'groups' LEFT JOIN q k ON k.id = m.id AND k.f = 'keys' LEFT JOIN e ON e.id = m.id GROUP BY m.id""",
    "q_provenance_state": f"""WITH ev AS (SELECT *, CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS h, CASE WHEN event_id % 7 <> 0 THEN event_type END AS repo FROM events),
      le AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN [{{'s': 'a', 'h': 'h' || event_id}}, {{'s': 'b', 'h': 'i' || event_id}}] WHEN repo IS NOT NULL THEN [{{'s': repo, 'h': coalesce(h, '{NOW}')}}] ELSE [] END AS e FROM ev),
      n AS (SELECT user_id, sum(len(e))::BIGINT AS n, arg_min(coalesce(e[1].h, NULL), event_id) FILTER (len(e) > 0) AS first, arg_max(coalesce(e[-1].h, 'l' || event_id), event_id) FILTER (len(e) > 0 OR event_id % 7 = 0) AS last,
        arg_max(repo, event_id) FILTER (repo IS NOT NULL) AS repo, arg_max(h, event_id) FILTER (h IS NOT NULL) AS h, arg_max('scan', event_id) FILTER (event_id % 2 = 0) AS method, arg_max(props, event_id) AS q, flatten(list(e ORDER BY event_id)) AS e FROM le GROUP BY user_id),
      oh AS (SELECT o_custkey, list({{'s': o_orderpriority, 'h': strftime(o_orderdate, '%Y-%m-%d')}} ORDER BY o_orderdate, o_orderkey) AS e, count(*) AS n FROM orders WHERE o_custkey % 4 = 0 GROUP BY 1),
      s AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS repo, 'c' || c_custkey AS h, c_name AS key, oh.n AS n, oh.e AS own, CASE WHEN oh.e IS NOT NULL THEN oh.e WHEN c_custkey % 3 <> 0 THEN [{{'s': c_mktsegment, 'h': 'c' || c_custkey}}] ELSE [] END AS e
        FROM customer LEFT JOIN oh ON o_custkey = c_custkey)
      SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(n.repo, s.repo) AS source_repository, n.method AS discovery_method, n.q AS harvest_query, coalesce(n.h, s.h) AS harvested_at, s.key AS dedup_key,
        CASE WHEN n.n IS NULL THEN s.n ELSE coalesce(s.n, len(s.e), 0) + n.n END AS discovery_count, CASE WHEN n.n IS NOT NULL THEN coalesce(s.e[1].h, n.first) END AS first_seen_at, CASE WHEN n.n IS NOT NULL THEN coalesce(n.last, n.h, s.h) END AS last_seen_at,
        CASE WHEN n.n IS NULL THEN {_SHOWN.format("s.own")} ELSE {_SHOWN.format("list_concat(coalesce(s.e, []), n.e)[-20:]")} END AS history
      FROM s FULL JOIN n ON s.user_id = n.user_id""",
    "q_upsert_discoveries": r"""WITH p AS (
      SELECT *, regexp_replace(full_host, '^www\.', '') AS host, 'http://' || regexp_replace(full_host, '^www\.', '') || regexp_replace(path, '/+$', '') AS url_key FROM (SELECT *, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS full_host,
        regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
      x AS (SELECT page_id AS seq, host AS source, page_id::VARCHAR AS source_id, url_key, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '/([0-9]+)(?:[/.?#]|$)', 1) END AS doi, length(html)::INT AS size, CASE WHEN page_id % 4 <> 0 THEN 'repo' || page_id % 4 END AS repo, 't' || page_id AS h FROM p),
      old AS (SELECT * FROM x WHERE seq % 3 = 0), inc AS (SELECT * FROM x WHERE seq % 3 <> 0),
      t AS (SELECT inc.*, coalesce((SELECT min((o.source, o.source_id)) FROM old o WHERE o.url_key = inc.url_key), (SELECT min((o.source, o.source_id)) FROM old o WHERE o.doi = inc.doi AND inc.doi <> '')) AS goal FROM inc),
      r AS (SELECT *, coalesce(goal[1], source) AS ks, coalesce(goal[2], source_id) AS ki, CASE WHEN repo IS NOT NULL THEN repo || '@' || h END AS e FROM t),
      n AS (SELECT ks, ki, arg_max({'url_key': url_key, 'doi': doi, 'size': size}, seq) AS l, arg_max(CASE WHEN goal IS NOT NULL THEN ks ELSE repo END, seq) FILTER (goal IS NOT NULL OR repo IS NOT NULL) AS repo, max(CASE WHEN goal IS NOT NULL THEN ks || ':' || ki END) AS key,
        list(e ORDER BY seq) FILTER (e IS NOT NULL) AS e, arg_min(h, seq) FILTER (repo IS NOT NULL) AS first, arg_max(h, seq) FILTER (repo IS NOT NULL) AS last, arg_max(h, seq) AS h FROM r GROUP BY ALL)
      SELECT coalesce(o.source, n.ks) AS source, coalesce(o.source_id, n.ki) AS source_id, CASE WHEN n.ks IS NULL THEN o.url_key ELSE n.l.url_key END AS url_key, CASE WHEN n.ks IS NULL THEN o.doi ELSE n.l.doi END AS doi, CASE WHEN n.ks IS NULL THEN o.size ELSE n.l.size END AS size,
        CASE WHEN o.seq IS NULL THEN '""" + NOW + "' ELSE 'before' END AS ingested_at, CASE WHEN n.ks IS NULL THEN 'before' ELSE '" + NOW + """' END AS updated_at, CASE WHEN o.seq IS NULL THEN 'insert' WHEN n.ks IS NULL THEN 'keep' ELSE 'update' END AS outcome,
        coalesce(n.repo, o.repo) AS source_repository, n.key AS dedup_key, CASE WHEN n.ks IS NOT NULL THEN (o.repo IS NOT NULL)::BIGINT + coalesce(len(n.e), 0) END AS discovery_count,
        CASE WHEN n.ks IS NOT NULL THEN coalesce(CASE WHEN o.repo IS NOT NULL THEN o.h END, n.first) END AS first_seen_at, CASE WHEN n.ks IS NOT NULL THEN coalesce(n.last, n.h, o.h) END AS last_seen_at,
        CASE WHEN n.ks IS NOT NULL THEN array_to_string(list_concat(CASE WHEN o.repo IS NOT NULL THEN [o.repo || '@' || o.h] ELSE [] END, coalesce(n.e, []))[-20:], ',') END AS history
      FROM old o FULL JOIN n ON o.source = n.ks AND o.source_id = n.ki""",
}
