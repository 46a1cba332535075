"""The report on records with nested sources: parts are the records, the lines that name them their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from curatrix.operators import report
from curatrix.sources.tables import table


def _records(spark, d):
    """A supplier's lines of a part are one source, the least of them; so a part has few sources however often it is ordered."""
    k, s = F.col("l_partkey"), F.col("l_suppkey")
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")).alias("f")
    lines = table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(first)
    source = F.struct(
        s.alias("supplier"),
        F.when(s % 9 != 0, F.concat(F.lit("http://x.org/"), s)).alias("sourceUrl"),
        F.array(F.concat(F.lit("m"), s % 5), F.concat(F.lit("M"), k % 3)).alias("modalityRaw"),
        F.array_compact(F.array(F.when(s % 4 != 0, F.concat(F.lit("m"), s % 5)))).alias("modality"),
        F.when(F.col("f.l_returnflag") != "N", F.col("f.l_returnflag")).otherwise("").alias("license"),
        F.when(F.col("f.l_returnflag") == "A", "CC0").alias("licenseNormalized"),
        F.col("f.l_linestatus").alias("studyType"),
        F.when(F.col("f.l_quantity") > 25, F.array(F.lit("Human"), F.lit("Mouse"))).alias("species"),
    )
    grouped = lines.groupBy("l_partkey").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    p, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").join(grouped, p == k, "left").select(
        p.alias("id"), F.when(p % 7 != 0, F.col("p_name")).alias("title"), F.when(p % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("description"), F.when(p % 4 == 0, F.concat(F.lit("10.1/"), size, F.col("p_brand"))).alias("doi"),
        F.when(p % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("modality"), F.array(F.concat(F.lit("g"), size % 4), F.when(size > 40, "old")).alias("ageGroup"), size.alias("participantCount"),
        F.struct(F.when(size % 2 == 0, F.col("p_brand")).alias("latestTag")).alias("snapshot"), "sources", F.transform("sources", lambda x: F.concat(F.lit("s:"), x["supplier"] * 100 + p % 90)).alias("sourceKeys"),
        F.when(p % 11 != 0, F.create_map(F.lit("r"), F.col("p_name"))).alias("rawMetadata"), F.struct(F.when(p % 13 != 0, F.struct(p.alias("key"))).alias("identity")).alias("provenance"),
    )


def q_report_coverage(spark, d):
    return report.coverage(_records(spark, d))


def q_report_normalization(spark, d):
    """Values by count, those of one count as they first appear."""
    x = report.value_counts(_records(spark, d), "id")
    return x.select("counter", "value", "n", F.col("first_seen.order").alias("first_record"), F.col("first_seen.source").alias("first_source"), F.col("first_seen.place").alias("first_place"))


def q_report_integrity(spark, d):
    x = report.integrity(_records(spark, d))
    return x.select(*[F.array_join(c, ",").alias(c) if c in ("duplicate_source_keys", "duplicate_dois") else c for c in x.columns])


QUERIES = {n: f for n, f in dict(globals()).items() if n.startswith("q_")}

_BASE = """WITH l AS (SELECT l_partkey AS k, l_suppkey AS s, min((l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity)) AS f FROM lineitem GROUP BY ALL),
  o AS (SELECT *, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INT AS i, f[3] AS flag, f[4] AS status, f[5] AS quantity FROM l WHERE k IN (SELECT p_partkey FROM part))"""
_FIELDS = {
    "title": "p_partkey % 7 <> 0", "description": "p_partkey % 3 <> 0", "doi": "p_partkey % 4 = 0", "modality": "p_partkey % 2 = 0", "age_group": "true", "participant_count": "true", "snapshot_version": "p_size % 2 = 0"
}

SQL = {
    "q_report_coverage": " UNION ALL ".join(
        f"SELECT '{name}' AS field, count(*) AS total, count(*) FILTER ({_FIELDS.get(name, 'false')}) AS non_null, count(*) FILTER (NOT ({_FIELDS.get(name, 'false')})) AS missing, "
        f"coalesce(round(count(*) FILTER ({_FIELDS.get(name, 'false')}) * 100.0 / nullif(count(*), 0), 1), 0)::DOUBLE AS coverage_pct FROM part" for name, _ in report.COVERAGE
    ),
    "q_report_normalization": _BASE + """, v AS (
      SELECT 'unique_raw_modalities' AS counter, unnest(['m' || s % 5, 'M' || k % 3]) AS value, k, i, unnest([0, 1]) AS j FROM o
      UNION ALL SELECT 'unique_normalized_modalities', 'm' || s % 5, k, i, 0 FROM o WHERE s % 4 <> 0 UNION ALL SELECT 'unique_raw_licenses', flag, k, i, 0 FROM o WHERE flag <> 'N' UNION ALL SELECT 'unique_normalized_licenses', 'CC0', k, i, 0 FROM o WHERE flag = 'A'
      UNION ALL SELECT 'unique_study_types', status, k, i, 0 FROM o UNION ALL SELECT 'unique_species', unnest(['Human', 'Mouse']), k, i, unnest([0, 1]) FROM o WHERE quantity > 25
      UNION ALL SELECT 'unique_age_groups', 'g' || p_size % 4, p_partkey, 0, 0 FROM part UNION ALL SELECT 'unique_age_groups', 'old', p_partkey, 0, 1 FROM part WHERE p_size > 40)
      SELECT counter, value, count(*) AS n, min((k, i, j))[1] AS first_record, min((k, i, j))[2]::INT AS first_source, min((k, i, j))[3]::INT AS first_place FROM v GROUP BY ALL""",
    "q_report_integrity": _BASE + """, a AS (SELECT 's:' || (s * 100 + k % 90) AS v, count(*) AS n FROM o GROUP BY 1 HAVING n > 1), b AS (SELECT '10.1/' || p_size || p_brand AS v, count(*) AS n FROM part WHERE p_partkey % 4 = 0 GROUP BY 1 HAVING n > 1)
      SELECT (SELECT count(*) FROM part) AS records, (SELECT count(*) FROM o) AS sources, (SELECT count(*) FROM o WHERE s % 9 = 0) AS missing_urls, (SELECT count(*) FROM part WHERE p_partkey % 11 = 0) AS missing_raw, (SELECT count(*) FROM part WHERE p_partkey % 13 = 0) AS missing_identity,
        coalesce((SELECT sum(n - 1) FROM a), 0)::BIGINT AS duplicate_source_key_count, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM a ORDER BY v LIMIT 20)), '') AS duplicate_source_keys,
        coalesce((SELECT sum(n - 1) FROM b), 0)::BIGINT AS duplicate_doi_count, coalesce((SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM b ORDER BY v LIMIT 20)), '') AS duplicate_dois""",
}
