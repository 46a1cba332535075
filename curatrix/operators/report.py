"""The report on a catalog of records with nested sources: coverage of fields, counts of values, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: Fields of the coverage report and where they stand in a record. Fixed values.
COVERAGE = (
    ("title", "title"), ("description", "description"), ("readme", "readme"), ("doi", "doi"), ("license", "license"),
    ("modality", "modality"), ("species", "species"), ("disease_condition", "disease"), ("ages", "ages"), ("age_group", "ageGroup"),
    ("participant_count", "participantCount"), ("dataset_size", "datasetSizeBytes"), ("publication_year", "publicationYear"),
    ("study_type", "studyType"), ("study_design", "studyDesign"), ("study_domain", "studyDomain"), ("tasks", "tasks"),
    ("sessions", "sessions"), ("brain_regions", "brainRegions"), ("keywords", "keywords"), ("dataset_type", "datasetType"),
    ("availability", "availability"), ("authors", "authors"), ("contributors", "contributors"), ("last_updated", "lastUpdated"),
    ("snapshot_version", "snapshot.latestTag"),
)
#: Counters of values: name, whether of each source or of the record, field. Fixed values.
COUNTERS = (
    ("unique_raw_modalities", "source", "modalityRaw"), ("unique_normalized_modalities", "source", "modality"),
    ("unique_raw_licenses", "source", "license"), ("unique_normalized_licenses", "source", "licenseNormalized"),
    ("unique_study_types", "source", "studyType"), ("unique_study_designs", "source", "studyDesign"),
    ("unique_species", "source", "species"), ("unique_age_groups", "record", "ageGroup"),
)
SAMPLE = 20


def _kind(schema: DataType, path: str) -> DataType | None:
    """The type at a dotted path of a struct; null where there is no such field."""
    for part in path.split("."):
        if not isinstance(schema, StructType) or part not in schema.names:
            return None
        schema = schema[part].dataType
    return schema


def present(value: Column, kind: DataType) -> Column:
    """Whether a value says something: no null, no empty text, list or map."""
    if isinstance(kind, ArrayType | MapType):
        return F.coalesce(F.size(value) > 0, F.lit(False))
    return value.isNotNull() if isinstance(kind, StructType) else F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def coverage(records: DataFrame, fields=COVERAGE) -> DataFrame:
    """(field, total, non_null, missing, coverage_pct) in one pass; a field that no record can have is missing in all."""
    kinds = {name: (path, _kind(records.schema, path)) for name, path in fields}
    counts = [F.count_if(present(F.col(path), kind)).alias(name) if kind is not None else F.lit(0).cast("long").alias(name) for name, (path, kind) in kinds.items()]
    long = records.agg(F.count("*").alias("total"), *counts).unpivot("total", list(kinds), "field", "non_null")
    pct = F.coalesce(F.round(F.try_divide(F.col("non_null") * 100.0, F.col("total")), 1), F.lit(0.0))
    return long.select("field", "total", "non_null", (F.col("total") - F.col("non_null")).alias("missing"), pct.alias("coverage_pct"))


def value_counts(records: DataFrame, order: str, sources: str = "sources", counters=COUNTERS) -> DataFrame:
    """(counter, value, n, first_seen), one row per different value; first_seen is a struct that orders values of one count as
    they appear: (``order`` of the record, source, place).

    All counters are filled in one pass: each record gives its values once, and counts are combined before the shuffle. Empty texts
    and nulls are no values."""
    nested = _kind(records.schema, sources)
    inner = nested.elementType if isinstance(nested, ArrayType) else None

    def values(name: str, owner: Column, kind: DataType | None, at: Column) -> Column | None:
        if kind is None:
            return None
        listed = F.coalesce(owner, F.array().cast(kind)) if isinstance(kind, ArrayType) else F.array(owner)
        return F.transform(listed.cast("array<string>"), lambda v, i: F.struct(F.lit(name).alias("counter"), v.alias("value"), at.cast("int").alias("source"), i.cast("int").alias("place")))

    def of_source(s: Column, i: Column) -> Column:
        found = [values(name, s[field], _kind(inner, field), i) for name, level, field in counters if level == "source"]
        return F.flatten(F.array(*[f for f in found if f is not None]))

    parts = [values(name, F.col(field), _kind(records.schema, field), F.lit(0)) for name, level, field in counters if level == "record"]
    parts = [p for p in parts if p is not None]
    if inner is not None and any(level == "source" and _kind(inner, field) is not None for _, level, field in counters):
        empty = F.array().cast(nested)
        parts.append(F.flatten(F.transform(F.coalesce(F.col(sources), empty), of_source)))
    x = records.select(F.col(order).alias("_order"), F.explode(F.concat(*parts)).alias("v")).select("_order", "v.*").where("value is not null and value <> ''")
    return x.groupBy("counter", "value").agg(F.count("*").alias("n"), F.min(F.struct(F.col("_order").alias("order"), "source", "place")).alias("first_seen"))


def integrity(records: DataFrame, source_keys: str = "sourceKeys", doi: str = "doi", sources: str = "sources", url: str = "sourceUrl", raw: str = "rawMetadata", identity: str = "provenance.identity") -> DataFrame:
    """One row: how often a source key or DOI comes again (with the first SAMPLE by value), sources without address, records
    without raw metadata, without identity. Keys are counted before they meet; nothing else is shuffled."""

    def again(values: DataFrame, name: str) -> DataFrame:
        n = values.where("v is not null and v <> ''").groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
        total = n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias(f"duplicate_{name}_count"))
        sample = n.orderBy("v").limit(SAMPLE).agg(F.array_sort(F.collect_list("v")).alias(f"duplicate_{name}s"))
        return total.crossJoin(sample)  # one row each

    kind = {c: _kind(records.schema, c) for c in (raw, identity)}
    lacks = F.size(F.filter(F.coalesce(F.col(sources), F.array().cast(_kind(records.schema, sources))), lambda s: F.coalesce(s[url], F.lit("")) == ""))
    one = records.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.size(F.coalesce(F.col(sources), F.array().cast(_kind(records.schema, sources))))), F.lit(0)).alias("sources"), F.coalesce(F.sum(lacks), F.lit(0)).alias("missing_urls"),
        *[(F.count_if(~present(F.col(c), kind[c])) if kind[c] is not None else F.count("*")).alias(n) for c, n in ((raw, "missing_raw"), (identity, "missing_identity"))],
    )
    keys = again(records.select(F.explode(source_keys).alias("v")), "source_key")
    return one.crossJoin(keys).crossJoin(again(records.select(F.col(doi).alias("v")), "doi"))
