import duckdb
import pytest

import __spark_entry__ as entry
from linekeeper.plans import catalogue, evidence, library, matches  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).columns[0] == "song"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "orders customer events documents labels conversations pages part".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_catalogue_agrees_with_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    res = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in res.description]
    at = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in res.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_catalogue_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
