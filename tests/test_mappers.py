import json

from curatrix.sources import mappers as M

PAYLOADS = [
    ("openneuro", {"id": "ds1", "name": "n", "publishDate": "2020-01-02T03:04:05Z", "created": "2019-01-01", "metadata": {"modalities": ["mri", " eeg "], "species": "Human", "subjectCount": 12}, "latestSnapshot": {"description": {"Name": " Title ", "License": "CC0", "DatasetDOI": "doi:10.18112/openneuro.ds1", "Authors": ["A B", "", "C D"]}}}),
    ("dandi", {"identifier": "DANDI:000026", "draft_version": {"name": "D", "created": "2021-05-06T00:00:00+02:00", "metadata": {"license": [{"identifier": "spdx:CC-BY-4.0"}], "species": [{"name": "House mouse"}], "measurementTechnique": [{"name": "ephys"}, {}], "numberOfSubjects": 3}}}),
    ("neurovault", {"id": 7, "name": "", "number_of_images": 40, "modify_date": "2017-06-29 11:20:37.529906", "authors": "X, Y"}),
    ("ebrains", {"@id": "https://kg.ebrains.eu/api/instances/u-1", "https://openminds.ebrains.eu/vocab/fullName": "E", "license": [{"name": "CC BY"}], "custodian": [{"givenName": "G", "familyName": "F"}]}),
    ("zenodo", {"id": 5, "doi": "10.5281/zenodo.5", "metadata": {"title": "Z", "access_right": "embargoed", "creators": [{"name": "K"}, {}], "keywords": ["a"]}, "files": [{"key": "f.zip", "size": 2559248010229, "links": {"self": "u"}}, {"size": 1}]}),
    ("figshare", {"id": 9, "title": "<b>T &amp; t</b>", "tags": ["x"], "license": {"name": "CC0"}, "url_public_html": "https://x.figshare.com/articles/9"}),
    ("dryad", {"identifier": "doi:10.5061/dryad.abc", "title": "R", "authors": [{"firstName": "P", "lastName": "Q"}]}),
    ("osf", {"id": "abc", "attributes": {"title": "O", "tags": []}, "links": {}}),
    ("nitrc", {"secondary_ID": "OASIS3", "name": "N"}),
    ("adni", {"stable_identifier": "adni-1", "dataset_name": "A", "source_url": "https://adni.loni.usc.edu/data", "modality": "MRI"}),
    ("osf", {"attributes": {"title": "no id"}}),
    ("unknown", {"id": 1}),
]


def test_all_sources(spark):
    df = spark.createDataFrame([(s, json.dumps(p)) for s, p in PAYLOADS] + [("osf", "broken {"), ("osf", None)], "source string, raw string")
    got = {r.source: r for r in M.canonical(M.project_all(df)).collect()}
    assert len(got) == 10
    o = got["openneuro"]
    assert (o.title, o.modality, o.species, o.subject_count, o.authors) == ("Title", ["mri", "eeg"], ["Human"], 12, ["A B", "C D"])
    assert str(o.published_at) == "2020-01-02 03:04:05" and o.identity_key == "doi:10.18112/openneuro.ds1"
    d = got["dandi"]
    assert (d.url, d.license, d.species, d.modality, d.subject_count) == ("https://dandiarchive.org/dandiset/000026", "spdx:CC-BY-4.0", ["House mouse"], ["ephys"], 3)
    assert (got["neurovault"].title, got["neurovault"].subject_count, got["neurovault"].authors) == ("NeuroVault Collection 7", 40, ["X, Y"])
    e = got["ebrains"]
    assert (e.source_id, e.title, e.license, e.authors) == ("u-1", "E", "CC BY", ["G F"])
    z = got["zenodo"]
    assert (z.access_tier, z.authors, z.files[0].size_bytes, len(z.files)) == ("registered", ["K"], 2559248010229, 1)
    assert (got["figshare"].title, got["figshare"].url) == ("T t", "https://x.figshare.com/articles/9")
    assert (got["dryad"].source_id, got["dryad"].url, got["dryad"].authors) == ("dryad.abc", "https://datadryad.org/stash/dataset/doi:10.5061/dryad.abc", ["P Q"])
    assert got["osf"].url == "https://osf.io/abc/" and got["nitrc"].url == "https://www.nitrc.org/projects/oasis3"
    assert got["adni"].identity_key == "adni:adni-1" and got["figshare"].identity_key == "url:http://x.figshare.com/articles/9"


def test_registry_and_web(spark):
    assert M.enabled([" OSF ", "nope", "dandi", "osf"]) == ["osf", "dandi"]
    r = M.web_candidates(spark.createDataFrame([("https://a.org", "t")], "url string, title string")).first()
    assert r.source == "web_search" and len(r.source_id) == 16
