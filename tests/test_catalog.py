"""Every registered query of the library with SQL gives DuckDB's rows on the smallest tables."""

import datetime

import duckdb
import pytest

from fotolith import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, (int, str, bool, type(None))) else round(float(v), 5)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in got.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == want


def test_trained_weights_find_a_linear_rule():
    import numpy as np

    from fotolith.plans.training import fit_linear

    x = np.random.default_rng(1).normal(size=(400, 3))
    y = 1.2 - 2 * x[:, 0] + 0.5 * x[:, 2]
    a = np.c_[np.ones(400), x]
    w = fit_linear(a.T @ a, a.T @ y, 1200, 0.025, 0.0)
    assert np.allclose(w, [y.mean(), -2 * x[:, 0].std(), 0, 0.5 * x[:, 2].std()], atol=0.05)
