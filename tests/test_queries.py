import datetime as dt
import decimal

import duckdb
import pytest

from tickloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sql, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = sql.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=str)


def test_flagship_is_registered():
    assert registry.FLAGSHIP in registry.QUERIES


def test_entry_without_corpus_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_open_survey_items_are_not_claimed():
    for name, handle in (("signal_backtest", "A23"), ("signal_grid", "M3"), ("shared_holdings", "J21")):
        assert handle not in registry.QUERIES[name].__doc__
