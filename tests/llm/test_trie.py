import random

import duckdb
import pytest

from curatrix.llm import trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, key string, pos string, n string, depth string"


def compared(spark, folder, rows):
    spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(5).write.parquet(f"{folder}/conversations.parquet")
    out = T.op13_block_trie(spark, str(folder))
    assert out.columns == COLUMNS
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet/*.parquet')")
    r = con.execute(T.OP13_SQL)
    names = [c[0] for c in r.description]
    want = sorted((tuple(row[names.index(c)] for c in COLUMNS) for row in r.fetchall()), key=repr)
    assert got == want
    return got


def conversations(seed, n, longest, words=2):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(3 * n), n):
        for turn in range(r.randrange(1, longest)):
            rows.append((c, turn, r.choice(["user", "assistant"]) if turn % 5 == 4 else "user", "é" * r.randrange(words)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, tmp_path, seed):
    assert len(compared(spark, tmp_path / "a", conversations(seed, 60, 14))) > 60


def test_long_conversations_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 2)
    monkeypatch.setattr(T, "PIECE", 3)
    rows = conversations(3, 30, 12)
    rows += [(c, t, "user", "same" if t < 40 + c % 3 else f"{c}") for c in (200, 201, 207, 213) for t in range(50)]
    rows += [(c, 0, "user", "copy") for c in range(300, 340)]
    compared(spark, tmp_path / "a", rows)


def test_edge_rows(spark, tmp_path):
    rows = [
        (1, None, None, None),
        (1, None, "", ""),
        (1, 2, "user", None),
        (1, 2, "user", "b"),
        (1, 2, "user", "b"),
        (None, 1, "user", "of no conversation"),
        (2, 0, "use", "rx"),
        (3, 0, "user", "x"),
        (4, -5, "user", "long " * 20_000),
        (-3, 1, "user", "x"),
        (-1, 1, "user", "x"),
        (9_000_000_000_000_000_000, 1, "user", "x"),
    ]
    out = compared(spark, tmp_path / "edge", rows)
    root = next(r for r in out if r[1] == 0)
    assert root[:4] == (-3, 0, None, 7)
    assert compared(spark, tmp_path / "none", []) == []


def test_a_conversation_whose_turns_are_all_taken_over_may_end_at_the_root(spark, tmp_path):
    out = compared(spark, tmp_path / "root", [(c, 0, "user", "t") for c in (6, 7, 8, 9, 11, 12, 13, 14)])
    assert {r[1] for r in out} <= {0, 1}
