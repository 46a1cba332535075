"""Filling the empty fields of records from their own evidence, with a trail of what was filled from where.

A declared value is never touched. An empty field takes the first evidence that has a label, in the order
of confidence: declared metadata, title, keywords, description; weaker evidence is not read then. All of it
is a projection: no shuffle, and each text is searched only for the fields that its record lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import text as T
from curatrix.functions import vocab as V

#: Confidence of the evidence, and the access of whole catalogs. Fixed values.
CONFIDENCE = {"structured": 100, "json": 95, "title": 90, "keywords": 85, "description": 40}
ACCESS = {
    "openneuro": "open", "dandi": "open", "neurovault": "open", "ebrains": "registered", "zenodo": "open",
    "figshare": "open", "dryad": "open", "osf": "open", "nitrc": "open",
}
VOCABULARIES = {"region": V.REGIONS, "age_group": V.AGES, "disease": V.DISEASES, "task": V.TASKS, "modality": V.MODALITIES, "species": V.SPECIES}
#: Fields that hold all labels found; the others hold the first.
LISTS = ("modality", "species")
STRINGS, NUMBERS = "array<string>", "array<bigint>"
#: Columns that are read, with the type of one that is absent.
INPUTS = {
    "source": "string", "title": "string", "description": "string", "keywords": STRINGS, "sizes": NUMBERS,
    "meta_task": STRINGS, "meta_modality": STRINGS, "meta_species": STRINGS, "access_tier": "string",
    "size_label": "string", "region": "string", "age_group": "string", "disease": "string", "task": "string",
    "modality": STRINGS, "species": STRINGS,
}


def _found(field: str, text: Column, vocabulary: dict[str, list[str]], tools) -> Column:
    """Labels of the field in a lower-case text, as an array."""
    if field == "modality":
        some = V.holds(text, [t for ts in vocabulary.values() for t in ts])
        return F.when(some, V.acquisition_labels(text, vocabulary, tools))
    if field in ("task", "species"):
        return V.labels(text, vocabulary)
    return F.array_compact(F.array(V.first_label(text, vocabulary)))


def _evidence(field: str, vocabulary: dict[str, list[str]], tools) -> Column:
    """Struct (labels, source) of the best evidence, null where there is none."""

    def tier(name: str, labels: Column) -> Column:
        return V.let(labels, lambda x: F.when(F.size(x) > 0, F.struct(x.alias("labels"), F.lit(name).alias("source"))))

    out = []
    if field == "task":
        named = F.transform(F.array_compact("meta_task"), lambda v: V.task_label(v, vocabulary))
        out.append(tier("json", F.array_distinct(F.array_compact(named))))
    elif field in LISTS:
        out.append(tier("json", V.let(F.lower(F.array_join(f"meta_{field}", " ")), lambda t: V.labels(t, vocabulary))))
    texts = {"title": F.col("title"), "keywords": F.array_join("keywords", " "), "description": F.col("description")}
    for name, raw in texts.items():
        out.append(tier(name, V.let(F.lower(F.coalesce(raw, F.lit(""))), lambda t: _found(field, t, vocabulary, tools))))
    return F.coalesce(*out)


def _empty(field: str) -> Column:
    c = F.col(field)
    return c.isNull() | ((F.size(c) == 0) if field in LISTS else (c == ""))


def enrich(records: DataFrame, vocabularies: dict[str, dict[str, list[str]]] = VOCABULARIES, tools=V.TOOL_WORDS, access: dict[str, str] = ACCESS) -> DataFrame:
    """``records`` with eight fields filled where they are null or empty: ``access_tier`` by source, ``size_label`` by the
    sum of ``sizes``, and the fields of ``vocabularies``; and ``enrichment``, an array of (field, source, confidence)
    in the order of filling, empty where nothing was filled.

    Columns of INPUTS that are absent count as null; other columns stay. Null and empty texts give no
    evidence; repeated rows are filled alike; an empty table gives no rows."""
    absent = {c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in records.columns}
    rows = records.withColumns(absent)
    total = F.aggregate(F.array_compact(F.coalesce("sizes", F.array().cast(NUMBERS))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    tiers = F.create_map(*[F.lit(x) for kv in access.items() for x in kv])

    def filled(values: Column, source: str) -> Column:
        return F.when(F.size(values) > 0, F.struct(values.alias("labels"), F.lit(source).alias("source")))

    found = {
        "access_tier": F.when(_empty("access_tier"), filled(F.array_compact(F.array(F.try_element_at(tiers, F.col("source")))), "source")),
        # the sizes of the files tell more than a declared label
        "size_label": F.when(total > 0, filled(F.array_compact(F.array(T.size_label(total))), "files")),
    }
    for field, vocabulary in vocabularies.items():
        found[field] = F.when(_empty(field), _evidence(field, vocabulary, tools))
    # a column each: the optimizer would work out the parts of one struct anew at every use
    rows = rows.withColumns({f"_{f}": c for f, c in found.items()})
    confidence = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])

    def event(field: str) -> Column:
        source = F.col(f"_{field}.source")
        return F.when(source.isNotNull(), F.struct(F.lit(field).alias("field"), source.alias("source"), F.try_element_at(confidence, source).alias("confidence")))

    def value(field: str) -> Column:
        labels = F.col(f"_{field}.labels")
        return F.coalesce(labels if field in LISTS else F.try_element_at(labels, F.lit(1)), F.col(field))

    unread = [c for c in absent if c not in found]
    return rows.withColumns({f: value(f) for f in found} | {"enrichment": F.array_compact(F.array(*[event(f) for f in found]))}).drop(*[f"_{f}" for f in found], *unread)
