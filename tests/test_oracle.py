"""Every query with SQL against DuckDB over the smallest data folder; every other one must run."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, S = entry.queries(), entry.oracle_sql()
#: Their SQL has 1000 knots, as many as the fitted quantiles have from 1000 rows on.
LARGER = {n: SF.replace("sf0.001", "sf0.01") for n in ("e8_normal_quantiles", "l3_linear_regression")}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    made = {}

    def over(folder):
        if folder not in made:
            c = made[folder] = duckdb.connect()
            c.execute("SET TimeZone='UTC'")
            for t in os.listdir(folder):
                c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{folder}/{t}'")
        return made[folder]

    return over


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) else str(v)


@pytest.mark.parametrize("name", list(Q))
def test_query(spark, con, name):
    folder = LARGER.get(name, SF)
    df = Q[name](spark, folder)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect())
    if name in S:
        rel = con(folder).sql(S[name])
        at = [rel.columns.index(c) for c in cols]
        assert sorted(rel.columns) == cols
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_names_match():
    assert set(S) <= set(Q)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
