"""Study pages of a project site: index cards, study text, release notes and publications, by patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions.text import html_text


def slugs(html: Column, prefix: str = "/study/") -> Column:
    """Distinct slugs of the study links of an index page, in the order of the page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(rf'href="(?:https?://[^/"]+)?{prefix}([a-z0-9][a-z0-9-]*)'), F.lit(1)))


def discovery_gate(index_pages: DataFrame, expected: int, html: str = "html") -> DataFrame:
    """One row: how many slugs the index pages hold, and whether that is what was expected."""
    found = index_pages.select(F.explode(slugs(F.col(html))).alias("slug"))
    return found.agg(F.count_distinct("slug").alias("n_slugs")).withColumn("verdict", F.when(F.col("n_slugs") == expected, "pass").otherwise("count"))


def study(html: Column) -> Column:
    """Struct of a study page: title, overview, meta description, investigators."""
    def section(pattern: str) -> Column:
        return F.nullif(html_text(F.regexp_extract(html, pattern, 1)), F.lit(""))

    return F.struct(
        section(r"(?is)<h1[^>]*>(.*?)</h1>").alias("title"),
        section(r"(?is)<h2[^>]*>\s*overview\s*</h2>(.*?)(?:<h2|</section|\z)").alias("overview"),
        F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1), F.lit("")).alias("description"),
        F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<[a-z]+[^>]*class="[^"]*\bpi\b[^"]*"[^>]*>(.*?)</'), F.lit(1)), html_text).alias("investigators"),
    )


def releases(html: Column) -> Column:
    """Entries of a release page: structs (name, date)."""
    items = F.regexp_extract_all(html, F.lit(r"(?is)<h3[^>]*>(.*?)</h3>"), F.lit(1))
    return F.transform(items, lambda x: F.struct(html_text(x).alias("name"), F.regexp_extract(x, r"((?:19|20)[0-9]{2}(?:-[0-9]{2}){0,2})", 1).alias("date")))


def dois(html: Column) -> Column:
    """Distinct DOIs on a page, in lower case, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(r"(10\.[0-9]{4,9}/[^\s\"'<>&]+)"), F.lit(1)), lambda x: F.lower(F.regexp_replace(x, r"[.,;)]+$", ""))))
