"""The corpus queries that SQL can state, against it."""

import pytest

import __spark_entry__ as entry
from tests.test_queries import SF, duck, plain  # noqa: F401


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query(spark, duck, name):  # noqa: F811
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in r.description]
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
