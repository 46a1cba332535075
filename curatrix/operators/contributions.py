"""Groups of single reconstructions by archive and publication, the unit of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import identity as I


def _set(value: Column) -> Column:
    return F.array_sort(F.collect_set(F.nullif(F.trim(value), F.lit(""))))


def _sets(values: str) -> Column:
    """Distinct trimmed members of an array column, over a group."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.flatten(F.collect_set(values)), lambda v: F.trim(v)), lambda v: v != "")))


def groups(rows: DataFrame, order: str) -> DataFrame:
    """One row per archive and publication of ``rows`` (archive, pmids, dois, species, brain_region, cell_type,
    gender, min_age, max_age, strain; the arrays pmids, dois, brain_region, cell_type).

    The publication is the first number among ``pmids``, else the first real DOI; rows without either, or
    without an archive, belong to no group. A group of a number has the DOI of its first row by ``order``. A DOI that several
    numbers of one archive share names none of them: it moves to ``doi_artifact``; groups by DOI keep theirs.
    Sets are sorted, empty where no row has a value; ages that are no numbers do not count. Null members are no
    members; repeated rows count each; an empty table gives no groups. Aggregates combine before the
    shuffle, so an archive or publication with most of the rows reaches one task only as partial sums."""
    archive = F.trim("archive")
    pmid = F.try_element_at(F.filter(F.array_compact(F.col("pmids").cast("array<string>")), lambda p: p.rlike("^[0-9]+$")), F.lit(1))
    doi = F.try_element_at(F.array_compact(F.transform(F.array_compact("dois"), I.doi_strict)), F.lit(1))
    gender = F.trim("gender")
    x = rows.withColumns({"_archive": archive, "_pmid": pmid, "_doi": doi}).where("_archive != '' and (_pmid is not null or _doi is not null)")
    x = x.withColumn("_by_doi", F.when(F.col("_pmid").isNull(), F.col("_doi")))
    out = x.groupBy(F.col("_archive").alias("archive"), F.col("_pmid").alias("pmid"), "_by_doi").agg(
        F.min_by("_doi", order).alias("doi"),
        F.count("*").alias("n"),
        _set(F.lower("species")).alias("species"),
        _sets("brain_region").alias("brain_regions"),
        _sets("cell_type").alias("cell_types"),
        _set(F.when(F.lower(gender) != "not reported", gender)).alias("genders"),
        F.min(F.col("min_age").try_cast("double")).alias("age_min"),
        F.max(F.col("max_age").try_cast("double")).alias("age_max"),
        _set(F.col("strain")).alias("strains"),
    )
    shared = out.where("pmid is not null and doi is not null").groupBy("archive", "doi").agg(F.count("*").alias("_n")).where("_n > 1")
    artifact = F.col("pmid").isNotNull() & F.col("_n").isNotNull()
    out = out.join(shared, ["archive", "doi"], "left")
    return out.select(
        "archive", "pmid", F.when(~artifact, F.col("doi")).alias("doi"), F.when(artifact, F.col("doi")).alias("doi_artifact"),
        "n", "species", "brain_regions", "cell_types", "genders", "age_min", "age_max", "strains",
    )
