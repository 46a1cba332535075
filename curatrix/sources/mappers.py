"""Raw JSON payloads of the catalogs projected onto the common record, by declared paths.

A mapper is data: for each column the places where a payload may hold it, first filled wins. All of it
is native JSON extraction, so a landing zone of any mix of sources is one scan and one projection. Keys
are matched as written. A payload without its id gives no record."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import identity as I

_IRI = "https://openminds.ebrains.eu/vocab/"


@dataclass(frozen=True)
class Mapper:
    """``id`` and the other tuples are JSON paths; ``url`` and ``default_title`` take the id in place of {}."""

    id: tuple[str, ...]
    url: str
    title: tuple[str, ...]
    default_title: str
    url_paths: tuple[str, ...] = ()
    texts: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lists: dict[str, tuple[str, ...]] = field(default_factory=dict)
    numbers: dict[str, tuple[str, ...]] = field(default_factory=dict)
    times: dict[str, tuple[str, ...]] = field(default_factory=dict)
    files: tuple[str, str, str, str] | None = None  # array, name, size, address
    id_tail: bool = False  # the id is what follows the last slash
    url_id: str = "{}"
    html: bool = False  # title and description carry markup
    tiers: dict[str, str] = field(default_factory=dict)


def _version(*keys: str) -> tuple[str, ...]:
    """Paths in the version's metadata, then the version, then the payload itself."""
    return tuple(f"$.{v}.{m}{k}" for k in keys for v in ("draft_version", "most_recent_published_version") for m in ("metadata.", "")) + tuple(f"$.{k}" for k in keys)


def _iri(*keys: str) -> tuple[str, ...]:
    return tuple(p for k in keys for p in (f"$.{k}", f"$['{_IRI}{k}']"))


MAPPERS: dict[str, Mapper] = {
    "openneuro": Mapper(
        ("$.id",), "https://openneuro.org/datasets/{}", ("$.latestSnapshot.description.Name", "$.description.Name", "$.name"), "OpenNeuro Dataset {}",
        texts={"license": ("$.latestSnapshot.description.License", "$.description.License"), "doi": ("$.latestSnapshot.description.DatasetDOI", "$.description.DatasetDOI"), "version": ("$.version",)},
        lists={"modality": ("$.metadata.modalities",), "species": ("$.metadata.species",), "authors": ("$.latestSnapshot.description.Authors", "$.description.Authors")},
        numbers={"subject_count": ("$.metadata.subjectCount",)},
        times={"published_at": ("$.publishDate", "$.created"), "updated_at": ("$.created",)},
    ),
    "dandi": Mapper(
        ("$.identifier", "$.draft_version.metadata.identifier"), "https://dandiarchive.org/dandiset/{}", _version("name"), "DANDI Dataset {}",
        texts={"description": _version("description"), "license": (*_version("license[0].identifier", "license[0].name"), *_version("license.identifier")), "version": ("$.version", *_version("version"))},
        lists={"modality": _version("measurementTechnique"), "species": _version("species")},
        numbers={"subject_count": _version("numberOfSubjects", "number_of_subjects")},
        times={"updated_at": ("$.modified", *_version("modified"), "$.created"), "published_at": (*_version("created"),)},
        url_id="DANDI:",
    ),
    "neurovault": Mapper(
        ("$.id",), "https://neurovault.org/collections/{}/", ("$.name",), "NeuroVault Collection {}",
        texts={"description": ("$.description",), "doi": ("$.DOI",)}, lists={"authors": ("$.authors",)},
        numbers={"subject_count": ("$.number_of_images",)},  # the source of this count is the number of images
        times={"updated_at": ("$.modify_date", "$.modified"), "published_at": ("$.create_date", "$.created")},
    ),
    "ebrains": Mapper(
        ("$['@id']", "$.id"), "https://search.kg.ebrains.eu/instances/{}", (*_iri("fullName", "name"), "$.displayName", "$.title"), "EBRAINS Dataset {}",
        texts={"description": _iri("description")}, lists={"authors": _iri("custodian", "authors"), "licenses": _iri("license")},
        times={"updated_at": _iri("lastReleasedAt", "modified"), "published_at": _iri("firstReleasedAt", "created")}, id_tail=True,
    ),
    "zenodo": Mapper(
        ("$.id",), "https://zenodo.org/records/{}", ("$.metadata.title",), "Zenodo Record {}", url_paths=("$.links.html",),
        texts={"description": ("$.metadata.description",), "license": ("$.metadata.license.id",), "doi": ("$.doi", "$.metadata.doi"), "version": ("$.metadata.version",), "access_tier": ("$.metadata.access_right",)},
        lists={"keywords": ("$.metadata.keywords",), "authors": ("$.metadata.creators",)},
        times={"published_at": ("$.created", "$.published"), "updated_at": ("$.updated",)}, files=("$.files", "key", "size", "links.self"),
        tiers={"open": "open", "restricted": "registered", "closed": "restricted", "embargoed": "registered"},
    ),
    "figshare": Mapper(
        ("$.id",), "https://figshare.com/articles/dataset/{}", ("$.title",), "Figshare Article {}", url_paths=("$.url_public_html",),
        texts={"description": ("$.description",), "license": ("$.license.name",), "doi": ("$.doi",)}, lists={"keywords": ("$.tags",), "authors": ("$.authors",)},
        times={"published_at": ("$.published_date", "$.published_at"), "updated_at": ("$.modified_date", "$.modified_at")}, files=("$.files", "name", "size", "download_url"), html=True,
    ),
    "dryad": Mapper(
        ("$.identifier",), "https://datadryad.org/stash/dataset/{}", ("$.title",), "Dryad Dataset {}",
        texts={"description": ("$.abstract",), "license": ("$.license",), "doi": ("$.identifier",)}, lists={"authors": ("$.authors",), "keywords": ("$.keywords",)},
        times={"published_at": ("$.publicationDate", "$.created"), "updated_at": ("$.lastModificationDate", "$.modified")}, id_tail=True, url_id="whole",
    ),
    "osf": Mapper(
        ("$.id",), "https://osf.io/{}/", ("$.attributes.title",), "OSF Project {}", url_paths=("$.links.html",),
        texts={"description": ("$.attributes.description",)}, lists={"keywords": ("$.attributes.tags",), "authors": ("$.attributes.contributors",)},
        times={"updated_at": ("$.attributes.date_modified", "$.attributes.modified"), "published_at": ("$.attributes.date_created", "$.attributes.created")},
    ),
    "nitrc": Mapper(
        ("$.secondary_ID", "$.id", "$.slug"), "https://www.nitrc.org/projects/{}", ("$.name", "$.title"), "NITRC Project {}",
        texts={"description": ("$.description",), "license": ("$.license",)}, lists={"keywords": ("$.keywords", "$.tags")},
        times={"updated_at": ("$.modified",), "published_at": ("$.created",)}, url_id="lower",
    ),
    "nemar": Mapper(
        ("$.dataset_id",), "https://nemar.org/dataexplorer/detail?dataset_id={}", ("$.name",), "NEMAR Dataset {}",
        texts={"description": ("$.description", "$.readme"), "license": ("$.license",), "doi": ("$.concept_doi", "$.latest_version_doi"), "version": ("$.latest_version",)},
        lists={"modality": ("$.modalities",), "authors": ("$.authors",), "tasks": ("$.tasks",)}, numbers={"subject_count": ("$.subject_count", "$.participants"), "size_bytes": ("$.file_size",)},
        times={"published_at": ("$.publish_date", "$.created_at"), "updated_at": ("$.updated_at",)},
    ),
    "adni": Mapper(
        ("$.stable_identifier",), "https://adni.loni.usc.edu/{}", ("$.dataset_name",), "ADNI Dataset {}", url_paths=("$.source_url",),
        texts={"description": ("$.description",)}, lists={"modality": ("$.modality",), "keywords": ("$.metadata_fields_available",)}, times={"published_at": ("$.first_announced",), "updated_at": ("$.last_update",)},
    ),
    "ukbiobank": Mapper(
        ("$.stable_identifier",), "https://biobank.ndph.ox.ac.uk/showcase/{}", ("$.name",), "UK Biobank Category {}", url_paths=("$.source_url",),
        texts={"description": ("$.description",), "doi": ("$.doi",)}, lists={"modality": ("$.modality",)}, numbers={"subject_count": ("$.participant_count",)},
    ),
}

#: Sources whose addresses are shared documentation pages and identify nothing. Fixed values.
SHARED_ADDRESSES = ("adni", "ukbiobank")
LISTS, TEXTS = ("modality", "species", "keywords", "authors", "tasks"), ("description", "license", "doi", "version", "access_tier")


def enabled(names, known=tuple(MAPPERS)) -> list[str]:
    """Known sources among ``names``, in their order; others are passed over."""
    return [n for n in dict.fromkeys(x.strip().lower() for x in names) if n in known]


def _text(raw: Column, paths: tuple[str, ...]) -> Column:
    if not paths:
        return F.lit(None).cast("string")
    return F.coalesce(*[I.empty_to_null(F.trim(F.get_json_object(raw, p))) for p in paths])


def _strings(raw: Column, paths: tuple[str, ...]) -> Column:
    """A list from a JSON array of strings or named objects, or from one string."""
    none = F.array().cast("array<string>")
    if not paths:
        return none
    value = _text(raw, paths)

    def name(v: Column) -> Column:
        parts = F.concat_ws(" ", *[F.coalesce(*[I.empty_to_null(F.get_json_object(v, f"$.{k}")) for k in ks]) for ks in (("firstName", "givenName"), ("lastName", "familyName"))])
        own = [F.get_json_object(v, p) for p in ("$.name", "$.fullName", f"$['{_IRI}fullName']", "$.title")]
        named = F.coalesce(*[I.empty_to_null(F.trim(x)) for x in own], I.empty_to_null(parts), F.get_json_object(v, "$['@id']"))
        return I.empty_to_null(F.trim(F.when(v.startswith("{"), named).otherwise(v)))

    return F.when(value.startswith("["), F.array_compact(F.transform(F.from_json(value, "array<string>"), name))).when(value.isNotNull(), F.array_compact(F.array(name(value)))).otherwise(none)


def clean_markup(c: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"&nbsp;|&amp;|&lt;|&gt;|&quot;", " ")
    return I.empty_to_null(F.trim(F.regexp_replace(x, r"\s+", " ")))


def _files(raw: Column, m: Mapper) -> Column:
    kind = "array<struct<name:string,size_bytes:bigint,download_url:string>>"
    if not m.files:
        return F.array().cast(kind)
    array, name, size, address = m.files
    items = F.coalesce(F.from_json(F.get_json_object(raw, array), "array<string>"), F.array().cast("array<string>"))
    made = F.transform(
        items,
        lambda v: F.struct(
            F.get_json_object(v, f"$.{name}").alias("name"), F.get_json_object(v, f"$.{size}").try_cast("bigint").alias("size_bytes"), F.get_json_object(v, f"$.{address}").alias("download_url")
        ),
    )
    return F.filter(made, lambda f: F.coalesce(f["name"], F.lit("")) != "")


def project(payloads: DataFrame, source: str, raw: str = "raw") -> DataFrame:
    """Records of one source: source, source_id, url, title, TEXTS, LISTS, subject_count, size_bytes,
    published_at, updated_at, files, raw. Timestamps without zone are read as session time (UTC)."""
    m, r = MAPPERS[source], F.col(raw)
    whole = F.regexp_replace(_text(r, m.id), "/+$", "")
    own = F.element_at(F.split(whole, "/"), -1) if m.id_tail else whole
    in_url = {"whole": whole, "lower": F.lower(own), "DANDI:": F.regexp_replace(own, "^DANDI:", "")}.get(m.url_id, own)
    head, tail = m.url.split("{}")
    built = F.concat(F.lit(head), in_url, F.lit(tail))
    title_head, title_tail = m.default_title.split("{}")

    def shown(c: Column) -> Column:
        return clean_markup(c) if m.html else c

    texts = {t: _text(r, m.texts.get(t, ())) for t in TEXTS}
    texts["description"] = shown(texts["description"])
    if "licenses" in m.lists:
        texts["license"] = F.try_element_at(_strings(r, m.lists["licenses"]), F.lit(1))
    if m.tiers:
        tier = F.lit(None).cast("string")
        for k, v in m.tiers.items():
            tier = F.when(F.lower(texts["access_tier"]) == k, v).otherwise(tier)
        texts["access_tier"] = tier
    out = payloads.select(
        F.lit(source).alias("source"),
        own.alias("source_id"),
        F.coalesce(_text(r, m.url_paths), built).alias("url"),
        F.coalesce(shown(_text(r, m.title)), F.concat(F.lit(title_head), own, F.lit(title_tail))).alias("title"),
        *[c.alias(t) for t, c in texts.items()],
        *[_strings(r, m.lists.get(x, ())).alias(x) for x in LISTS],
        *[_text(r, m.numbers.get(n, ())).try_cast("double").try_cast("bigint").alias(n) for n in ("subject_count", "size_bytes")],
        *[F.try_to_timestamp(_text(r, m.times.get(t, ()))).alias(t) for t in ("published_at", "updated_at")],
        _files(r, m).alias("files"),
        r.alias("raw"),
    )
    return out.where(F.coalesce(F.col("source_id"), F.lit("")) != "")


def project_all(payloads: DataFrame, source: str = "source", raw: str = "raw", names=tuple(MAPPERS)) -> DataFrame:
    """Records of a landing zone of mixed sources; payloads of unknown sources give none."""
    out = None
    for n in enabled(names):
        part = project(payloads.where(F.col(source) == n), n, raw)
        out = part if out is None else out.unionByName(part)
    return out


def canonical(records: DataFrame) -> DataFrame:
    """With canonical_id and its key: DOI before address before source and id; shared addresses do not count."""
    doi, address = I.doi_strict(F.col("doi")), F.when(~F.col("source").isin(*SHARED_ADDRESSES), I.url_key(F.col("url")))
    own = F.concat_ws(":", "source", "source_id")
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("url:"), address), own)
    return records.withColumns({"identity_key": key, "canonical_id": I.canonical_id(key), "source_key": own})


def web_candidates(found: DataFrame, url: str = "url", title: str = "title") -> DataFrame:
    """Search hits as records of the web: the id is a hash of the address, nothing else is taken over."""
    return found.select(F.lit("web_search").alias("source"), F.substring(F.sha1(F.col(url)), 1, 16).alias("source_id"), F.col(url).alias("url"), F.col(title).alias("title"))
