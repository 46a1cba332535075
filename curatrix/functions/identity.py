"""Identity keys as native column expressions: URLs, hosts, DOIs, ids, references between catalogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def full_host(url: Column) -> Column:
    """The host in lower case; empty where there is none. Malformed URLs never fail."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def host_of(url: Column) -> Column:
    """The host without a leading ``www.``."""
    return F.regexp_replace(full_host(url), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)


def url_key(url: Column) -> Column:
    """``http://`` + host + path without closing slashes: scheme, port, user, query and fragment do not
    count, the path's case does. Null for null and empty URLs."""
    return F.when(empty_to_null(url).isNotNull(), F.concat(F.lit("http://"), host_of(url), F.regexp_replace(path_of(url), "/+$", "")))


def domain_family(url: Column) -> Column:
    """The last two labels of the host."""
    labels = F.filter(F.split(full_host(url), r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(full_host(url))


def under(host: Column, hosts) -> Column:
    """Whether ``host`` is one of ``hosts`` or below one that has a dot."""
    out = host.isin(*hosts)
    for h in hosts:
        if "." in h:
            out = out | host.endswith("." + h)
    return out


#: Forms in which a DOI is written before its prefix. Fixed values.
DOI_FORMS = r"^(?:https://doi\.org/|http://doi\.org/|https://dx\.doi\.org/|http://dx\.doi\.org/|doi:)"


def doi_loose(doi: Column) -> Column:
    """Lower case without its form; any text passes. Null for empty."""
    return empty_to_null(F.regexp_replace(F.lower(F.trim(doi)), DOI_FORMS, ""))


def doi_strict(doi: Column) -> Column:
    """As :func:`doi_loose`, but null unless a registry prefix stands in front: placeholders identify nothing."""
    d = F.trim(doi_loose(doi))
    return F.when(d.rlike(r"^10\.[0-9]{4,9}/"), d)


def canonical_id(key: Column) -> Column:
    return F.concat(F.lit("ns-"), F.substring(F.sha1(key), 1, 16))


#: Catalogs with the path prefixes of their records. Fixed values.
REFERENCES = (
    ("dandi", "dandiarchive.org/dandiset/"), ("openneuro", "openneuro.org/datasets/"), ("nemar", "nemar.org/"),
    ("nitrc", "nitrc.org/projects/"), ("brainlife", "brainlife.io/datasets/"), ("ebrains", "ebrains.eu/"),
    ("dryad", "datadryad.org/dataset/"),
)


def cross_references(texts: Column, references=REFERENCES) -> Column:
    """Distinct structs (repository, id) of known record addresses in an array of texts, first seen first."""

    def one(text: Column) -> Column:
        low = F.lower(text)
        found = []
        for repo, prefix in references:
            rest = F.trim(F.substring_index(F.substring_index(F.trim(F.regexp_replace(F.substring(low, F.instr(low, prefix) + len(prefix), F.length(low)), r"^\s+", "")), "/", 1), "?", 1))
            found.append(F.when((F.instr(low, prefix) > 0) & (rest != ""), F.struct(F.lit(repo).alias("repository"), rest.alias("id"))))
        return F.array_compact(F.array(*found))

    return F.array_distinct(F.flatten(F.transform(F.array_compact(texts), one)))


#: Record addresses of the supported catalogs: source, pattern, how the id is written. Fixed values.
RECORD_URLS = (
    ("openneuro", r"^https?://(?:www\.)?openneuro\.org/datasets/([^/?#]+)", None),
    ("dandi", r"^https?://(?:www\.)?dandiarchive\.org/dandiset/([0-9]+)", "DANDI:%06d"),
    ("neurovault", r"^https?://(?:www\.)?neurovault\.org/collections/([0-9]+)", None),
    ("ebrains", r"^https?://search\.kg\.ebrains\.eu/instances/([^/?#]+)", None),
    ("zenodo", r"^https?://(?:www\.)?zenodo\.org/records/([0-9]+)", None),
    ("figshare", r"^https?://(?:www\.)?figshare\.com/articles/(?:dataset/)?(?:[^/?#]+/)?([^/?#]+)/?$", None),
    ("dryad", r"^https?://(?:www\.)?datadryad\.org/stash/dataset/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)", None),
    ("osf", r"^https?://osf\.io/([^/?#]+)", None),
    ("nitrc", r"^https?://(?:www\.)?nitrc\.org/projects/([^/?#]+)", None),
)


def record_identity(url: Column, patterns=RECORD_URLS) -> Column:
    """Struct (source, source_id) of the first pattern that fits; null where none does."""
    out = []
    for source, pattern, form in patterns:
        raw = F.regexp_extract(url, pattern, 1)
        own = F.format_string(form, raw.try_cast("bigint")) if form else raw
        out.append(F.when(url.rlike(pattern), F.struct(F.lit(source).alias("source"), own.alias("source_id"))))
    return F.coalesce(*out)
