"""Enrichment, contribution groups, identity over sets and merging, on rows written by hand."""

import random

import pytest

from curatrix.operators import catalog, contributions, enrich

SCHEMA = "id long, source string, title string, description string, keywords array<string>, sizes array<bigint>, meta_modality array<string>, meta_task array<string>, disease string, modality array<string>"


def test_enrich(spark):
    rows = [
        (1, "dandi", "EEG of mice", "Patients with stroke. fMRI too.", ["Epilepsy"], [1024, None, 512], None, None, None, None),
        (2, "web", None, "Portal for MEG. Older-adult data, prefrontal cortex!", None, None, None, None, "", []),
        (3, "ebrains", "rats", None, None, None, ["MRI", "pet"], ["no such task", "rs-fMRI session", "Motor"], "declared", ["x"]),
        (4, None, None, None, None, None, None, None, None, None),
        (4, None, None, None, None, None, None, None, None, None),
        (5, "osf", "", "über" + "Ärat rat_ " * 3 + "word " * 60_000 + "zebrafish", [None], [], None, None, None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r for r in enrich.enrich(df).collect()}
    assert (got[1].access_tier, got[1].size_label, got[1].disease, got[1].species, got[1].modality) == ("open", "1.5 KB", "epilepsy", ["mouse"], ["eeg"])
    assert [(e.field, e.source, e.confidence) for e in got[1].enrichment if e.field == "disease"] == [("disease", "keywords", 85)]
    assert (got[2].modality, got[2].age_group, got[2].region) == ([], "adult", "prefrontal cortex")
    assert (got[3].task, got[3].modality, got[3].disease, got[3].species) == ("resting-state", ["x"], "declared", ["rat"])
    assert got[4].enrichment == [] and got[4].species is None
    assert got[5].species == ["zebrafish"]
    out = enrich.enrich(df)
    assert out.count() == 6 and "meta_species" not in out.columns
    assert enrich.enrich(df.where("false")).count() == 0


def test_contribution_groups(spark):
    schema = "at int, archive string, pmids array<string>, dois array<string>, species string, brain_region array<string>, cell_type array<string>, gender string, min_age string, max_age string, strain string"
    rows = [
        (1, "A ", ["x", "7"], ["doi:10.1234/Q"], "Rat", ["r2", " "], None, "Not reported", "2", "n", ""),
        (2, "A", ["7"], None, "rat ", ["r1", None], ["c"], "Male", "1.5", "4", "s"),
        (3, "A", ["8"], ["10.1234/q"], None, None, None, None, None, None, None),
        (4, "A", None, ["n/a", "10.1234/q"], None, None, None, None, None, None, None),
        (5, None, ["7"], None, None, None, None, None, None, None, None),
        (6, "A", [None], ["none"], None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {(r.pmid, r.n): r for r in contributions.groups(df, "at").collect()}
    assert set(got) == {("7", 2), ("8", 1), (None, 1)}
    a = got["7", 2]
    assert (a.archive, a.doi, a.doi_artifact, a.species, a.brain_regions, a.cell_types, a.genders, a.age_min, a.age_max, a.strains) == ("A", None, "10.1234/q", ["rat"], ["r1", "r2"], ["c"], ["Male"], 1.5, 4.0, ["s"])
    assert (got[None, 1].doi, got[None, 1].doi_artifact) == ("10.1234/q", None)
    assert contributions.groups(df.where("false"), "at").count() == 0


def test_multi_field(spark):
    schema = "id string, title string, authors array<string>, n int, repo string, repos array<string>, doi string"
    old = [("e1", "t", ["a", "b"], 5, None, ["x"], "d"), ("e2", "t", ["b", None], 5, None, ["y"], None), ("e3", None, ["b"], 5, None, ["x"], None), ("e2", "t", ["b", None], 5, None, ["y"], None)]
    new = [("i1", "t", ["b", "c"], 5, "x", None, None), ("i2", "t", ["b"], 5, "z", None, "other"), ("i3", "t", ["c"], 5, "z", None, None), ("i4", "t", ["b"], 5, "z", None, None), ("i5", None, ["b"], 5, "z", None, None), ("i6", "t", ["b"], 5, "y", None, "other")]
    df = [spark.createDataFrame(x, schema) for x in (old, new)]
    got = {r.id: r.target for r in catalog.multi_field(*df, "id", "title", ["authors", "n"], "repo", "repos", "doi").collect()}
    assert got == {"i1": "e2", "i2": "e2", "i4": "e1"}


def test_absorb(spark):
    record = "id string, title string, license string, modality array<string>, ages array<int>, age_groups array<string>"
    have = spark.createDataFrame([("c1", None, "", ["eeg"], [5], None), ("c2", "t", None, None, None, ["kept"])], record)
    source = "id string, title string, license string, modality array<string>, ages array<int>, age_groups array<string>, at int, repository string, source_id string, raw string, via string"
    rows = [("c1", None, "cc0", ["meg", "eeg", None], [70], None, 1, "r", "1", "a", "doi"), ("c1", "late", "x", ["pet"], None, None, 2, "r", "1", "b", "title"), ("c1", "later", "x", None, None, None, 3, "s", "9", None, "url"), ("gone", "x", "x", None, None, None, 1, "r", "2", "c", "doi")]
    got = {r.id: r for r in catalog.absorb(have, spark.createDataFrame(rows, source), "id", "at", ["title", "license"], ["modality"]).collect()}
    a, b = got["c1"], got["c2"]
    assert (a.title, a.license, a.modality, a.ages, a.age_groups) == ("late", "cc0", ["eeg", "meg", "pet"], [5, 70], ["Children", "Older Adults"])
    assert (a.source_keys, a.raw, a.matched_via) == (["r:1", "s:9"], {"r": "b", "s": None}, "url")
    assert (b.title, b.modality, b.age_groups, b.source_keys, b.raw, b.matched_via) == ("t", [], ["kept"], [], None, None)
    assert len(got) == 2


RECORD = "id string, title string, authors array<string>, disease array<string>, ages array<int>, age_groups array<string>"
SOURCE = RECORD + ", at int, repository string, source_id string, raw string, via string, seen int"
HELD = RECORD + ", source_keys array<string>, raw map<string,string>, sources array<struct<key:string,entry:string>>, matched_via string, updated_at int"


def _absorbed(have, sources):
    """:func:`catalog.absorb` as a loop."""
    out = {}
    for r in have:
        title, disease, was = r[1], r[3], r[6:] or (None,) * 5
        keys, raw, entries, via, seen = list(was[0] or []), dict(was[1] or {}), dict(was[2] or []), was[3], was[4]
        lists = [dict.fromkeys(x for x in r[i] or [] if x is not None) for i in (2, 4, 5)]
        for s in sorted((s for s in sources if s[0] == r[0]), key=lambda s: s[6]):
            title, disease = title or s[1], disease or s[3]
            for held, i in zip(lists, (2, 4, 5), strict=True):
                held.update(dict.fromkeys(x for x in s[i] or [] if x is not None))
            key = ":".join(x for x in s[7:9] if x is not None)
            keys += [] if key in keys else [key]
            if s[7] is not None:
                raw[s[7]] = s[9]
            entries[key] = s[9]
            via, seen = s[10], s[11]
        groups = dict.fromkeys("Children" if a <= 12 else "Adults" for a in lists[1])
        out[r[0]] = (title or None, disease or [], list(lists[0]), list(lists[1]), list(groups or lists[2]), keys, raw or None, list(entries.items()) or None, via, seen)
    return out


@pytest.mark.parametrize("carried", [False, True])
@pytest.mark.parametrize("gathered", [0, 3, 500])
def test_absorb_as_a_loop(spark, monkeypatch, gathered, carried):
    monkeypatch.setattr(catalog, "GATHERED", gathered)
    r = random.Random(gathered)

    def some(values, most=3):
        return r.choice([None, [], [r.choice(values) for _ in range(r.randint(1, most))]])

    def fields(i):
        return (i, r.choice([None, "", f"t{r.randint(0, 9)}"]), some(["a", "b", "c", None]), some(["d", "e"]), some([5, 30, 7, None]), some(["Children", "other"]))

    have = [fields(f"c{i}") for i in range(12)]
    if carried:
        have = [h + (r.choice([None, ["r:1", "q:7"]]), r.choice([None, {"r": "old", "q": None}]), r.choice([None, [("q:7", "x"), ("r:1", "y")]]), r.choice([None, "was"]), r.choice([None, 4])) for h in have]
    ids = ["c0"] * 9 + [f"c{i}" for i in range(11)] + ["gone", None]
    sources = [fields(r.choice(ids)) + (at, r.choice(["r", "s", "t", None]), str(r.randint(1, 3)), r.choice([None, f"raw{at}"]), r.choice([None, "doi", "url"]), r.choice([None, at])) for at in range(90)]
    got = catalog.absorb(spark.createDataFrame(have, HELD if carried else RECORD), spark.createDataFrame(sources, SOURCE), "id", "at", ["title"], ["authors"], fill=["disease"], entry="raw", retrieved="seen").collect()
    assert len(got) == len(have)
    as_loop = {x.id: (x.title, x.disease, x.authors, x.ages, x.age_groups, x.source_keys, x.raw, x.sources and [tuple(e) for e in x.sources], x.matched_via, x.updated_at) for x in got}
    assert as_loop == _absorbed(have, sources)


def test_absorb_meets_its_sources_once(spark):
    source = spark.range(200).selectExpr(
        "id % 40 as id", "id as at", "'r' as repository", "string(id) as source_id", "'raw' as raw", "'doi' as via", "'t' as title", "array('m') as modality", "array(5) as ages", "array('x') as age_groups"
    )
    out = catalog.absorb(source.where("at < 40").select("id", "title", "modality", "ages", "age_groups"), source, "id", "at", ["title"], ["modality"])
    assert out.count() == 40
    assert out._jdf.queryExecution().sparkPlan().toString().count("Range (") == 2
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
