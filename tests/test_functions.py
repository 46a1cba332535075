"""Rules of the catalog on literal rows."""

import pytest
from pyspark.sql import functions as F

from curatrix.functions import identity as I
from curatrix.functions import text as T
from curatrix.functions import vocab as V
from curatrix.operators import quality as Q


def column(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").collect()
    return [r[1] if len(columns) == 1 else tuple(r)[1:] for r in rows]


X = None


@pytest.fixture(autouse=True)
def _x(spark):
    global X  # a column needs a session
    X = F.col("x")


def test_url_keys(spark):
    urls = ["https://www.Example.org:80/A/b/?q#f", "http://user:pw@example.org", "HTTP://EXAMPLE.org//", None, "", "no url", "https://a.b/%zz?"]
    assert column(spark, urls, "string", I.url_key(X)) == ["http://example.org/A/b", "http://example.org", "http://example.org", None, None, "http://", "http://a.b/%zz"]
    assert column(spark, ["https://www.a.b.example.org/x", "https://localhost/", "bad"], "string", I.domain_family(X)) == ["example.org", "localhost", ""]


def test_dois(spark):
    rows = ["https://doi.org/10.1234/AB", "DOI:10.5281/zenodo.1", "mockdoi", "", None, " 10.123/x", "http://dx.doi.org/10.99999/y "]
    assert column(spark, rows, "string", I.doi_strict(X), I.doi_loose(X)) == [
        ("10.1234/ab", "10.1234/ab"), ("10.5281/zenodo.1",) * 2, (None, "mockdoi"), (None, None), (None, None), (None, "10.123/x"), ("10.99999/y",) * 2,
    ]


def test_record_addresses(spark):
    urls = [
        "https://openneuro.org/datasets/ds000001/versions/1", "https://dandiarchive.org/dandiset/26/draft", "https://zenodo.org/records/77?x",
        "https://figshare.com/articles/dataset/some_title/123", "https://datadryad.org/stash/dataset/doi:10.5061/dryad.abc/", "https://example.org/datasets/1", None,
    ]
    got = column(spark, urls, "string", I.record_identity(X))
    assert [r and tuple(r) for r in got] == [("openneuro", "ds000001"), ("dandi", "DANDI:000026"), ("zenodo", "77"), ("figshare", "123"), ("dryad", "dryad.abc"), None, None]


def test_cross_references(spark):
    texts = [["See https://openneuro.org/datasets/DS1/x and", None, "dandiarchive.org/dandiset/000003?v"], [], None, ["openneuro.org/datasets/"]]
    got = column(spark, texts, "array<string>", I.cross_references(X))
    assert [r and [tuple(v) for v in r] for r in got] == [[("openneuro", "ds1"), ("dandi", "000003")], [], None, []]


def test_titles(spark):
    assert column(spark, ["  The  Big-Data: Étude! ", "ﬁne ①", "?!", None], "string", T.title_norm(X)) == ["the big-data étude", "fine 1", None, None]


def test_licenses(spark):
    rows = ["CC0", "spdx:CC0-1.0", "PDDL", "CC BY-NC 4.0", "spdx:CC-BY-4.0", "CC BY", "public domain", "MIT", "not specified", "none", None, ""]
    assert column(spark, rows, "string", T.license_label(X)) == ["cc0", "cc0", "pddl", "cc-by-nc-4.0", "cc-by-4.0", "cc-by-4.0", "pddl", None, None, None, None, None]


def test_sizes(spark):
    rows = [None, 0, 512, 1024, 1536, 1300000, 5 * 1024**4]
    assert column(spark, rows, "bigint", T.size_label(X)) == [None, None, "512 B", "1 KB", "1.5 KB", "1.2 MB", "5 TB"]


def test_years_and_ages(spark):
    assert column(spark, ["2019-05-01", "in 1999", "12019", "", None], "string", T.publication_year(X, F.lit("2001"))) == [2019, 1999, 2001, 2001, 2001]
    ages = [[0.0, 12.0, 13.0, 17.0], [12.5], [18.0, 64.0, 65.0], [-1.0, None], [], None]
    assert column(spark, ages, "array<double>", T.age_groups(X)) == [["Children", "Adolescents"], None, ["Adults", "Older Adults"], None, None, None]


def test_vocabularies(spark):
    rows = ["an eeg and meg study", "meeg", "resting-state fmri of the café", None]
    assert column(spark, rows, "string", V.labels(X, V.MODALITIES)) == [["meg", "eeg"], [], ["fmri"], []]
    assert column(spark, ["caf eeg", "café"], "string", V.labels(X, {"caf": ["caf"]})) == [["caf"], []]
    blurb = ["View with MEG portal. EEG was recorded.", "MEG analysis tools", "Single-trial EEG analysis; PET too."]
    assert column(spark, blurb, "string", V.acquisition_labels(X)) == [["eeg"], [], ["eeg", "pet"]]
    raw = [[" EEG ", "01", "Magnetoencephalography", "eeg", "odd", None, ""], None]
    assert column(spark, raw, "array<string>", V.normalise(X, V.MODALITIES)) == [["eeg", "meg", "odd"], None]


def test_modality_overlap(spark):
    rows = ["mri", "structural mri", "eeg", "", "FMRI", "xyz"]
    assert column(spark, rows, "string", V.modality_overlap("fMRI", X)) == [True, False, False, False, True, False]
    assert column(spark, ["ecog", "pet", "functional thing"], "string", V.modality_overlap("thing", X)) == [False, False, True]


def test_landing_pages(spark):
    rows = ["https://openneuro.org/", "https://openneuro.org/datasets/ds1", "https://openneuro.org/about", "https://osf.io/abcde", "https://osf.io/a/b", "https://figshare.com/articles/1", "https://x.figshare.com/search", "https://example.org/", "https://zenodo.org/a.nii.gz?x"]
    assert column(spark, rows, "string", Q.is_landing(X)) == [True, False, True, False, True, False, True, False, False]


def test_classes(spark):
    rows = [("https://arxiv.org/abs/1", "A"), ("https://github.com/a/b", "Code"), ("https://neurostars.org/t", "x"), ("https://a.org/x.pdf?y", "t"), ("https://openneuro.org/datasets/1", "EEG"), ("https://neurovault.org/collections/3", "maps"), ("https://a.org", "A toolbox"), ("https://a.org", "plain"), ("https://my.blog.org/", "t")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, u string, t string")
    got = [r.c for r in df.select("i", Q.content_class(F.col("u"), F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["paper", "software", "forum", "documentation", "dataset", "dataset_collection", "software", "unknown", "blog"]
    assert column(spark, [["Data Collection"], ["x", "category:data"], ["journal article"], [None], None], "array<string>", Q.native_class(X)) == ["dataset_collection", "dataset_collection", "paper", None, None]


def test_score(spark):
    df = spark.createDataFrame([("a title", "a description of some length", 5, "verified", True), (None, None, None, None, None), ("tiny", "x", 0, "stale", False)], "t string, d string, n int, k string, l boolean")
    some = F.col("t").isNotNull()
    s = Q.score(F.col("t"), F.col("d"), some, some, some, F.col("n"), F.col("k"), F.col("l"))
    assert [r[0] for r in df.select(s).collect()] == [1.0, 0.1, 0.19]
    assert df.select(Q.bonus(*[F.lit(True)] * 7)).first()[0] == 0.15
