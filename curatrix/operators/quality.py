"""The quality stages as columns: filter, classify, verify, score. Each gives one label per row; a stage
is a filter on that label, and its report a count by it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.functions import identity as I
from curatrix.functions import vocab

#: Hosts and terms of the classifier. Fixed values.
SOURCE_HOSTS = {
    "openneuro": "openneuro.org", "dandi": "dandiarchive.org", "neurovault": "neurovault.org", "ebrains": "ebrains.eu",
    "zenodo": "zenodo.org", "figshare": "figshare.com", "dryad": "datadryad.org", "osf": "osf.io", "nitrc": "nitrc.org",
}
KNOWN_HOSTS = ("openneuro.org", "dandiarchive.org", "nitrc.org", "humanconnectome.org", "adni.loni.usc.edu", "ebrains.eu")
DATA_ENDINGS = (".dcm", ".nii", ".nii.gz", ".mnc", ".edf", ".bdf", ".vhdr", ".vmrk", ".eeg", ".fif", ".nwb", ".h5", ".hdf5")
DATA_TYPES = ("application/octet-stream", "application/zip", "application/gzip", "application/x-gzip", "application/x-tar")
DOCUMENT_TERMS = ("specification", "spec.pdf", "documentation", "changelog", "manual", "readme.pdf", "white paper", "user guide")
SOFTWARE_TERMS = ("tool", "application", "source code", "software", "workflow", "toolbox", "library", "pipeline", "app")
FORUM_TERMS = (" forum", "forum ", "-forum", "discussion", "thread", "question", "answers", "issue ", "issues ", "board", "conversation", "community ")
PAPER_HOSTS = (
    "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "arxiv.org", "biorxiv.org", "medrxiv.org",
    "psyarxiv.com", "semanticscholar.org", "connectedpapers.com", "sciencedirect.com", "nature.com", "springer.com",
    "wiley.com", "frontiersin.org", "plos.org", "academic.oup.com", "jneurosci.org", "cell.com", "ieee.org",
    "elsevier.com", "thelancet.com", "nejm.org", "researchgate.net", "academia.edu", "mdpi.com", "sagepub.com",
    "tandfonline.com", "jamanetwork.com", "bmj.com", "science.org", "pnas.org", "elifesciences.org", "peerj.com",
    "f1000research.com",
)
BLOG_HOSTS = ("medium.com", "wordpress.com", "blogger.com", "substack.com", "tumblr.com", "hashnode.com", "dev.to", "ghost.io", "wixsite.com", "squarespace.com")
FORUM_HOSTS = ("stackexchange.com", "stackoverflow.com", "neurostars.org", "discourse.org", "reddit.com", "quora.com", "github.com", "gitlab.com")
DOCUMENT_HOSTS = ("readthedocs.io", "gitbook.io", "gitbook.com", "wikipedia.org", "wiktionary.org", "docs.github.com", "developer.mozilla.org", "learn.microsoft.com")
SOFTWARE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "sourceforge.net", "pypi.org", "npmjs.com", "crates.io", "docker.com", "hub.docker.com", "anaconda.org")
DATASET_PATHS = ("/dataset/", "/datasets/", "/dandiset/", "/records/", "/collections/", "/projects/", "/instances/")
COLLECTION_PATHS = ("/collections/", "/projects/")
EVIDENCE_TERMS = (
    "meg", "magnetoencephalography", "magnetoencephalogram", "eeg", "electroencephalography", "electroencephalogram",
    "ieeg", "ecog", "electrocorticography", "electrophysiology", "electrophysiological", "spikes", "spiking", "spike",
    "mri", "fmri", "smri", "magnetic resonance", "neuroimaging", "pet", "positron emission tomography", "dti", "nirs",
    "fnirs", "diffusion tensor", "connectome", "functional connectivity", "brain", "cerebral", "cerebellar",
    "cerebellum", "cortex", "cortical", "hippocampus", "hippocampal", "amygdala", "thalamus", "striatum", "neural",
    "neuronal", "neuron", "neurons", "neuroscience", "neurological", "neurodegenerative", "neuropsychiatric",
    "neurodevelopmental", "neuromodulation", "parkinson", "alzheimer", "dementia", "epilepsy", "seizure",
    "schizophrenia", "stroke", "resting-state", "task-fmri",
)


def holds_any(text: Column, terms) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def filter_reason(source: Column, url: Column, source_id: Column, title: Column, enabled, allowed, blocked=(), web: str = "web_search") -> Column:
    """The first reason against a record, null for none. Records found on the web pass the first two tests."""
    host, is_web = I.host_of(url), source == web
    missing = reduce(lambda a, b: a | b, [I.empty_to_null(c.cast("string")).isNull() for c in (source_id, url, title)])
    return (
        F.when(~is_web & ~source.isin(*enabled), "source_disabled")
        .when(~is_web & ((host == "") | ~I.under(host, allowed)), "domain_not_allowlisted")
        .when(host.isin(*blocked) if blocked else F.lit(False), "blocklisted")
        .when(missing, "missing_required")
    )


def is_document(title: Column, url: Column) -> Column:
    both = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(url, F.lit(""))))
    return holds_any(both, DOCUMENT_TERMS) | F.substring_index(F.substring_index(F.lower(F.coalesce(url, F.lit(""))), "?", 1), "#", 1).endswith(".pdf")


def is_direct(url: Column, endings=DATA_ENDINGS) -> Column:
    """The address itself is a data file: by its ending, also before a query or fragment."""
    x = F.lower(url)
    ends = "|".join(e.replace(".", r"\.") for e in endings)
    return x.contains("dataset_description.json") | x.rlike(rf"(?:{ends})(?:$|[?#])")


def is_direct_by_headers(content_type: Column, disposition: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return kind.isin(*DATA_TYPES) | F.lower(F.coalesce(disposition, F.lit(""))).contains("attachment")


def is_landing(url: Column, hosts=(*KNOWN_HOSTS, *SOURCE_HOSTS.values()), markers=DATASET_PATHS, endings=DATA_ENDINGS) -> Column:
    """A page of a known catalog that is no record: its home, search, help pages."""
    host, path = I.host_of(url), F.lower(I.path_of(url))
    bare = F.regexp_replace(path, "/+$", "")
    return (
        F.when((host == "") | ~I.under(host, sorted(set(hosts))), False)
        .when(is_direct(url, endings) | holds_any(path, markers), False)
        .when(bare == "", True)
        .when(I.under(host, ("osf.io",)), ~bare.rlike("^/[^/]+$"))
        .when(I.under(host, ("figshare.com",)), ~path.startswith("/articles/"))
        .otherwise(True)
    )


def native_class(types: Column) -> Column:
    """The class that the first telling entry of an array of declared types gives."""

    def one(t: Column) -> Column:
        n = F.lower(t)
        return (
            F.when(n.contains("dataset collection") | n.contains("data collection") | (n.contains("collection") & n.contains("dataset")), "dataset_collection")
            .when(n.contains("category:data"), "dataset_collection")
            .when(n.contains("dataset"), "dataset")
            .when(holds_any(n, ("paper", "article", "preprint", "publication", "thesis", "journal")), "paper")
            .when(holds_any(n, ("software", "code", "tool", "workflow", "app", "library")), "software")
        )

    return F.try_element_at(F.array_compact(F.transform(types, one)), F.lit(1))


def content_class(url: Column, title: Column, native: Column | None = None, file_signal: Column | None = None, known=(*KNOWN_HOSTS, *SOURCE_HOSTS.values())) -> Column:
    """One of documentation, paper, blog, forum, software, dataset, dataset_collection, unknown; the order decides."""
    host, path, name = I.host_of(url), F.lower(I.path_of(url)), F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(is_document(title, url), "documentation")
        .when(host.isin(*PAPER_HOSTS), "paper")
        .when(host.isin(*BLOG_HOSTS) | path.contains("/blog") | host.contains("blog.") | (host == "blog"), "blog")
        .when(host.isin(*FORUM_HOSTS) | holds_any(name, FORUM_TERMS), F.when(host.isin(*SOFTWARE_HOSTS), "software").otherwise("forum"))
        .when(host.isin(*DOCUMENT_HOSTS), "documentation")
        .when(host.isin(*SOFTWARE_HOSTS) | holds_any(name, SOFTWARE_TERMS), "software")
        .when(native.isNotNull() if native is not None else F.lit(False), native if native is not None else F.lit(None))
        .when(is_landing(url, known), "documentation")
        .when(file_signal if file_signal is not None else F.lit(False), "dataset")
        .when(I.under(host, sorted(set(known))) & holds_any(path, DATASET_PATHS), F.when(holds_any(path, COLLECTION_PATHS), "dataset_collection").otherwise("dataset"))
        .otherwise("unknown")
    )


DROPPED = ("paper", "blog", "forum", "documentation", "software")


def verify_reason(status: Column, url: Column, direct: Column, known: Column, label: Column, landing: Column) -> Column:
    """The first reason against a probed record; ``direct`` gives an unknown one its class."""
    return (
        F.when(status.isNull() | (status >= 400), "dead_link")
        .when(landing, "repo_landing_page")
        .when(~direct & ~known, "unverifiable")
        .when((label == "unknown") & ~direct, "unclassifiable")
    )


def evidence_gate(modality: Column, *texts: Column) -> Column:
    """A declared modality, or a term of the field anywhere in the texts."""
    text = F.lower(F.concat_ws(" ", *texts))
    return F.coalesce(F.size(modality) > 0, F.lit(False)) | holds_any(text, EVIDENCE_TERMS)


def post_filter(modality: Column, species: Column, wanted_modality=(), wanted_species=(), evidence: Column | None = None) -> Column:
    """Declared values must meet the wanted ones; where none are declared, modality asks for evidence."""
    out = F.lit(True)
    if wanted_modality:
        meets = F.exists(modality, lambda d: reduce(lambda a, b: a | b, [vocab.modality_overlap(m, d) for m in wanted_modality]))
        out = F.when(F.coalesce(F.size(modality), F.lit(0)) > 0, meets).otherwise(evidence if evidence is not None else F.lit(False))
    if wanted_species:
        lower = F.transform(F.array_compact(species), F.lower)
        some = F.coalesce(F.arrays_overlap(lower, F.array(*[F.lit(s.lower()) for s in wanted_species])), F.lit(False))
        out = out & (some | (F.coalesce(F.size(species), F.lit(0)) == 0))
    return out


def score(title: Column, description: Column, modality: Column, species: Column, keywords: Column, subjects: Column, trust: Column, direct: Column) -> Column:
    """Completeness from 0 to 1: content, richness, trust and link, a quarter each at most."""

    def some(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    content = F.when(some(F.length(title) > 5), 0.15).otherwise(0.0) + F.when(some(F.length(description) > 20), 0.10).otherwise(0.0)
    rich = sum((F.when(some(c), w).otherwise(0.0) for c, w in ((modality, 0.07), (species, 0.06), (keywords, 0.06), (subjects > 0, 0.06))), F.lit(0.0))
    trusted = F.when(trust == "verified", 0.25).when(trust == "stale", 0.0).otherwise(0.10)
    return F.round(F.least(content + F.least(rich, F.lit(0.25)) + trusted + F.when(some(direct), 0.25).otherwise(0.0), F.lit(1.0)), 4)


def bonus(*fields: Column, cap: float = 0.15) -> Column:
    """Four hundredths for each filled field, up to ``cap``."""
    n = sum((F.when(F.coalesce(f, F.lit(False)), 1).otherwise(0) for f in fields), F.lit(0))
    return F.round(F.least(F.lit(cap), n * 0.04), 4)


def stage_report(df: DataFrame, stage: str, reason: str) -> DataFrame:
    """(stage, reason, n): rows by reason, accepted ones under 'accepted'."""
    return df.groupBy(F.lit(stage).alias("stage"), F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
