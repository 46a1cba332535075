"""Records of the catalog from raw payloads of one source, over VARIANT: what is text, list or number is told by the value itself.

A member of the wrong type is left out, as is a blank one; nothing is made up for what a payload lacks. The payload itself stays
in ``raw``. All of it is a projection: payloads are parsed once, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import identity as I
from curatrix.functions import text as T
from curatrix.functions import vocab as V


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v) == kind, F.lit(False))


def first_text(v: Column, *paths: str) -> Column:
    """The first text that is not blank, trimmed."""
    found = []
    for p in paths:
        x = F.try_variant_get(v, p, "variant")
        found.append(F.when(_is(x, "STRING"), I.empty_to_null(F.trim(F.try_variant_get(v, p, "string")))))
    return F.coalesce(*found)


def members(v: Column, path: str) -> Column:
    """The members of a list, as VARIANT; none where there is no list."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def texts(v: Column, *paths: str) -> Column:
    """The texts of the first list that holds any that is not blank, as written."""
    lists = []
    for p in paths:
        own = F.filter(members(v, p), lambda x: _is(x, "STRING"))
        lists.append(F.filter(F.transform(own, lambda x: F.try_variant_get(x, "$", "string")), lambda s: F.trim(s) != ""))
    out = lists[-1]
    for one in reversed(lists[:-1]):
        out = F.when(F.size(one) > 0, one).otherwise(out)
    return out


def text_or_texts(v: Column, path: str) -> Column:
    """One text as a list of one, a list as its texts."""
    one = first_text(v, path)
    return F.when(one.isNotNull(), F.array(one)).otherwise(texts(v, path))


def whole(v: Column, *paths: str) -> Column:
    """The first value that is there, as a whole number; null where it is none."""
    x = F.coalesce(*[F.try_variant_get(v, p, "string") for p in paths])
    return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))


def numbers(v: Column, path: str) -> Column:
    """The members of a list that are numbers, or texts of numbers; null for none."""
    found = F.array_compact(F.transform(members(v, path), lambda x: F.try_variant_get(x, "$", "string").try_cast("double")))
    return F.when(F.size(found) > 0, found)


def snapshots(payloads: DataFrame, raw: str = "raw", source: str = "openneuro", address: str = "https://openneuro.org/datasets/", availability: str = "open") -> DataFrame:
    """Records of nodes with a latest snapshot: id, metadata, latestSnapshot (description, summary), snapshots.

    Participants are counted from the subjects, ages are those of subjects, and age groups follow from them; modalities come from the
    metadata, else the summary; the size is the snapshot's, else the summary's; the last update is that of the latest snapshot, else
    of the node. Only public nodes have an availability. A payload without an id, or that is no JSON, gives no record."""
    x = payloads.select(F.col(raw).alias("raw"), F.try_parse_json(raw).alias("v"))
    v = F.col("v")
    d, m, s, u = "$.latestSnapshot.description.", "$.metadata.", "$.latestSnapshot.", "$.latestSnapshot.summary."
    own = F.try_variant_get(v, "$.id", "string")
    subjects, modality = texts(v, u + "subjects"), texts(v, m + "modalities", u + "modalities")
    species = V.normalise(text_or_texts(v, m + "species"), V.SPECIES)
    size, published, created = whole(v, s + "size", u + "size"), F.try_variant_get(v, "$.publishDate", "string"), F.try_variant_get(v, "$.created", "string")
    license = first_text(v, d + "License")
    named = F.filter(members(v, s + "contributors"), lambda c: first_text(c, "$.name").isNotNull())
    people = F.transform(named, lambda c: F.struct(first_text(c, "$.name").alias("name"), first_text(c, "$.contributorType").alias("type"), first_text(c, "$.orcid").alias("orcid")))
    tags = F.transform(members(v, "$.snapshots"), lambda t: F.try_variant_get(t, "$.tag", "string"))
    out = x.select(
        F.lit(source).alias("repository"), F.trim(own).alias("source_id"), F.concat(F.lit(address), F.trim(own)).alias("url"), I.doi_strict(first_text(v, d + "DatasetDOI")).alias("doi"),
        first_text(v, d + "Name", m + "datasetName", "$.name").alias("title"), F.try_variant_get(v, s + "readme", "string").alias("readme"), license.alias("license"), T.license_label(license).alias("license_label"),
        first_text(v, d + "DatasetType").alias("dataset_type"), F.when(F.try_variant_get(v, "$.public", "boolean"), availability).alias("availability"),
        F.try_to_timestamp(F.coalesce(*[F.try_variant_get(v, p, "string") for p in (m + "latestSnapshotCreatedAt", s + "created", "$.created")])).alias("last_updated"),
        created.alias("created_at"), published.alias("published"), T.publication_year(published, created).alias("publication_year"), texts(v, d + "Authors").alias("authors"), people.alias("contributors"),
        modality.alias("modality_raw"), V.normalise(modality, V.MODALITIES).alias("modality"), F.when(F.size(species) > 0, species).alias("species"),
        numbers(v, m + "ages").alias("ages"), subjects.alias("subjects"), F.when(F.size(subjects) > 0, F.size(subjects)).alias("participants"),
        first_text(v, m + "studyDesign").alias("study_design"), first_text(v, m + "studyDomain").alias("study_domain"), texts(v, m + "tasksCompleted", u + "tasks").alias("tasks"), texts(v, u + "sessions").alias("sessions"),
        F.struct(
            F.try_variant_get(v, s + "tag", "string").alias("tag"), F.try_variant_get(v, s + "id", "string").alias("id"), F.try_variant_get(v, s + "hexsha", "string").alias("hexsha"),
            whole(v, u + "totalFiles").alias("files"), F.size(tags).alias("versions"), tags.alias("tags"),
        ).alias("snapshot"),
        size.alias("size_bytes"), T.size_label(size).alias("size_label"),
        F.struct(
            F.try_variant_get(v, m + "associatedPaperDOI", "string").alias("paper_doi"), texts(v, d + "Funding").alias("funding"), texts(v, d + "EthicsApprovals").alias("ethics"),
            texts(v, d + "ReferencesAndLinks").alias("references"), first_text(v, d + "BIDSVersion").alias("bids_version"),
        ).alias("publication"),
        "raw",
    )
    return out.withColumn("age_groups", T.age_groups(F.col("ages"))).where(F.coalesce("source_id", F.lit("")) != "")
