from curatrix.operators import difference
from curatrix.sources import tables


def test_one_changed_one_missing_one_extra(spark, tmp_path):
    lines = ['{"id": "a", "doi": "", "n": 1, "tags": ["x"], "title": "T", "note": "l"}', '{"id": "b", "doi": "10/b", "n": 2, "tags": [], "title": "U"}', '{"id": "c", "doi": null, "n": 3, "title": "V"}', '{"id": "c", "doi": null, "n": 3, "title": "V"}']
    document = '[{"id": "a", "primary": null, "n": "1", "tags": ["x"], "title": "T", "note": "r"}, {"id": "b", "primary": "10/B", "n": "2", "title": "U"}, {"id": "d", "n": "4", "title": "W"}]'
    (tmp_path / "l.jsonl").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    (tmp_path / "d.json").write_text("﻿" + document, encoding="utf-8")
    left = tables.census_lines(spark, str(tmp_path / "l.jsonl"))
    right = tables.census_document(spark, str(tmp_path / "d.json"), None)
    assert sorted(r.id for r in left.collect()) == ["a", "b", "c", "c"]  # the mark at the file's start is no part of a name
    got = sorted((tuple(r) for r in difference.differences(left, right, "id", {"doi": "primary"}, leave=["note"]).collect()), key=repr)
    assert got == [("b", "doi", "10/b", "10/B", "value"), ("c", None, None, None, "only_left"), ("c", None, None, None, "repeated_left"), ("d", None, None, None, "only_right")]
    assert difference.differences(left, left.distinct(), "id").where("kind <> 'repeated_left'").count() == 0
    assert difference.differences(left.limit(0), left.limit(0), "id").count() == 0


def test_null_keys_and_no_common_fields(spark):
    a = spark.createDataFrame([(None, "x"), (1, "y")], "id int, v string")
    b = spark.createDataFrame([(None, "z")], "id int, w string")
    assert [tuple(r) for r in difference.differences(a, b, "id").collect()] == [(1, None, None, None, "only_left")]
    assert {tuple(r) for r in difference.differences(a, b, "id", {"v": "w"}).collect()} == {(None, "v", "x", "z", "value"), (1, None, None, None, "only_left")}
