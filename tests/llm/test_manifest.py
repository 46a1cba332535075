import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from curatrix.llm import manifest as M
from tests.llm import cases


def docs_of(spark, *rows):
    return cases.docs(spark, *rows).withColumn("n_chars", F.length("text").cast("long"))


def by_sql(sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet/*.parquet')")
    r = con.execute(M.OP11_SQL)
    names = [c[0] for c in r.description]
    return sorted((tuple(row[names.index(c)] for c in COLUMNS) for row in r.fetchall()), key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def compared(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    got = M.op11_postorder_manifest(spark, str(folder))
    assert got.columns == COLUMNS
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == by_sql(folder)
    return rows


@pytest.mark.parametrize("leaves", [1, 2, 3, 4, 9, 10, 26, 27, 28, 100, 243])
def test_addresses_against_the_log(leaves):
    top = M.height(leaves)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(leaves)]
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([M._hash(b"".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    log = M.append_log(digests, top)
    assert len(levels) == top + 1 and len(log) == 32 * sum(map(len, levels))
    for level, nodes in enumerate(levels):
        for i, d in enumerate(nodes):
            at = 32 * M.position(level, i, leaves, top)
            assert log[at : at + 32] == d
    assert log[-32:] == levels[-1][0]


def test_edge_rows(spark, tmp_path):
    rows = compared(spark, tmp_path / "edge", docs_of(spark))
    assert len(rows) == len(cases.ROWS)
    assert all(r[6] for r in rows if r[0] is None)
    assert compared(spark, tmp_path / "none", docs_of(spark, [])) == []
    alone = compared(spark, tmp_path / "one", docs_of(spark, [(8, "a\nb", "en", None)]))[0]
    assert alone[1] == alone[2] == alone[3] and alone[4] == hashlib.sha256(b"").hexdigest()


def test_several_tiers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "LEVELS", 2)
    monkeypatch.setattr(M, "SEGMENT", 9)
    rows = [(i * 7 % 1000, f"text {i}\nof {i % 11}", "en", f"s{i % 40}" if i % 3 else "hot") for i in range(900)]
    out = compared(spark, tmp_path / "tiers", docs_of(spark, rows))
    assert {r[6] for r in out} == {True, False}
    assert {r[0] for r in out if r[6]} == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 2}


def test_a_changed_leaf_or_sibling_breaks_the_root(spark):
    docs = docs_of(spark, [(i, f"t{i}", "en", "a" if i % 4 else "b") for i in range(40)])
    for r in M.manifest(docs).collect():
        assert r.folded == r.root and len(r.proof) % 64 == 0
    for r in M.manifest(docs, changed={"lang": F.lit("de")}, where=F.col("doc_id") == 7).collect():
        assert (r.folded == r.root) == (r.doc_id != 7)
