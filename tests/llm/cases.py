"""Rows that every operator must take: nulls, empty and long texts, repeated rows, extra columns."""

import duckdb

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
ROWS = [
    (1, "", "en", "src1"),
    (2, None, "en", "src0"),
    (None, "a row without an id", None, None),
    (None, None, None, None),
    (3, " \n\t ", "en", "src1"),
    (4, LONG, "en", "src1"),
    (5, "one", "en", "src1"),
    (5, "one", "en", "src1"),
    (6, "Ünï çödé ß 𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ​ text \x85 end", "de", "src2"),
    (6, "another text of the same id", "de", "src2"),
]


def docs(spark, rows=ROWS):
    """documents with extra columns whose names the operators may use inside."""
    extra = ("fp", "k1", "k2", "key", "size", "h", "label", "score", "sid", "row")
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in extra)
    return spark.createDataFrame([(*r, *extra) for r in rows], schema)


def texts(sf_dir, table="documents", columns="doc_id, text"):
    return duckdb.sql(f"SELECT {columns} FROM '{sf_dir}/{table}.parquet' ORDER BY 1").fetchall()


def components(ids, linked):
    """Least member reachable from each of ``ids``, by comparing all pairs."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ids)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}
