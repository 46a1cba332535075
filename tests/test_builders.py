import json

from pyspark.sql import functions as F

from curatrix.sources import builders as B

NODE = {
    "id": " ds000001 ", "name": "ignored", "created": "2018-07-14T01:00:00.000Z", "publishDate": "2019-02-03T00:00:00Z", "public": True,
    "metadata": {"modalities": [], "species": "Human", "ages": ["25", 30, "x", None], "tasksCompleted": None, "studyDesign": " block ", "associatedPaperDOI": "10.1/p"},
    "latestSnapshot": {
        "tag": "1.0.1", "created": "2020-01-01T00:00:00Z", "size": None, "readme": "R", "contributors": [{"name": "C", "orcid": "0"}, {"orcid": "1"}, "x"],
        "description": {"Name": " A study ", "DatasetDOI": "doi:10.18112/openneuro.ds000001.v1", "License": "CC0", "Authors": ["A", " ", 3, "B"], "Funding": "not a list"},
        "summary": {"modalities": ["MRI", "01", "mri", "odd"], "subjects": ["01", "02"], "tasks": ["rest"], "totalFiles": 12, "size": "2048"},
    },
    "snapshots": [{"tag": "1.0.0"}, {"tag": "1.0.1"}],
}


def test_snapshot_records(spark):
    bare = {"id": "ds2", "public": False, "metadata": {"species": ["mouse", " ", 5], "modalities": ["eeg"]}, "name": "N"}
    rows = [(json.dumps(p),) for p in (NODE, bare, {"id": ""}, {"name": "no id"}, [1])] + [("broken {",), (None,)]
    got = {r.source_id: r for r in B.snapshots(spark.createDataFrame(rows, "raw string")).collect()}
    assert set(got) == {"ds000001", "ds2"}
    a, b = got["ds000001"], got["ds2"]
    assert (a.url, a.doi, a.title, a.license, a.availability) == ("https://openneuro.org/datasets/ds000001", "10.18112/openneuro.ds000001.v1", "A study", "CC0", "open")
    assert (a.authors, a.modality_raw, a.species, a.ages, a.age_groups) == (["A", "B"], ["MRI", "01", "mri", "odd"], ["human"], [25.0, 30.0], ["Adults"])
    assert a.modality[-1] == "odd" and len(a.modality) == 2 and "01" not in a.modality
    assert (a.participants, a.tasks, a.study_design, a.size_bytes, a.publication_year) == (2, ["rest"], "block", 2048, 2019)
    assert (a.snapshot.tag, a.snapshot.versions, a.snapshot.tags, a.snapshot.files) == ("1.0.1", 2, ["1.0.0", "1.0.1"], 12)
    assert [tuple(c) for c in a.contributors] == [("C", None, "0")] and a.publication.funding == [] and a.publication.paper_doi == "10.1/p"
    assert str(a.last_updated) == "2020-01-01 00:00:00" and json.loads(a.raw) == NODE
    assert (b.title, b.availability, b.participants, b.ages, b.size_label, b.doi, b.modality) == ("N", None, None, None, None, None, ["eeg"])
    assert len(b.species) == 1 and b.authors == [] and b.snapshot.versions == 0
    assert B.snapshots(spark.createDataFrame(rows, "raw string").limit(0)).count() == 0


def test_lists_dicts_and_texts_alike(spark):
    df = spark.createDataFrame([('{"a": "x", "b": ["y", 1], "c": {"d": " z "}, "n": "7.9"}',)], "raw string").select(F.parse_json("raw").alias("v"))
    v = F.col("v")
    r = df.select(B.text_or_texts(v, "$.a").alias("a"), B.text_or_texts(v, "$.b").alias("b"), B.text_or_texts(v, "$.c").alias("c"), B.first_text(v, "$.b", "$.c.d").alias("d"), B.whole(v, "$.n").alias("n")).first()
    assert tuple(r) == (["x"], ["y"], [], "z", 7)
