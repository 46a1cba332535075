from curatrix.operators import report


def test_nested_records(spark):
    schema = "id int, title string, ageGroup array<string>, snapshot struct<latestTag:string>, sources array<struct<modality:array<string>,license:string,sourceUrl:string>>, sourceKeys array<string>, doi string, rawMetadata map<string,string>, provenance struct<identity:struct<k:int>>"
    rows = [
        (1, " ", ["Adults", None], ("1.0",), [(["eeg", "meg"], "", "u"), (["meg"], "CC0", None)], ["a:1", "b:1"], "10/x", {"a": "r"}, ((1,),)),
        (2, "T", [], (None,), [(None, None, ""), (["eeg"], "CC0", "u")], ["a:1"], "10/x", {}, (None,)),
        (3, None, None, None, None, None, "", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    cover = {r.field: (r.total, r.non_null, r.missing, r.coverage_pct) for r in report.coverage(df).collect()}
    assert len(cover) == len(report.COVERAGE) == 26
    assert cover["title"] == (3, 1, 2, 33.3) and cover["age_group"] == (3, 1, 2, 33.3) and cover["snapshot_version"] == (3, 1, 2, 33.3) and cover["readme"] == (3, 0, 3, 0.0)
    assert {r.coverage_pct for r in report.coverage(df.limit(0)).collect()} == {0.0}
    counts = {(r.counter, r.value): (r.n, tuple(r.first_seen)) for r in report.value_counts(df, "id").collect()}
    assert counts == {
        ("unique_normalized_modalities", "eeg"): (2, (1, 0, 0)),
        ("unique_normalized_modalities", "meg"): (2, (1, 0, 1)),
        ("unique_raw_licenses", "CC0"): (2, (1, 1, 0)),
        ("unique_age_groups", "Adults"): (1, (1, 0, 0)),
    }
    r = report.integrity(df).first()
    assert (r.records, r.sources, r.missing_urls, r.missing_raw, r.missing_identity) == (3, 4, 2, 2, 2)
    assert (r.duplicate_source_key_count, r.duplicate_source_keys, r.duplicate_doi_count, r.duplicate_dois) == (1, ["a:1"], 1, ["10/x"])
    assert report.integrity(df.limit(0)).first().records == 0
