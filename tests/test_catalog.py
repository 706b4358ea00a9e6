import glob
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from spanforge.plans import catalog
from spanforge.streaming import live


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {path.split('/')[-1][:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    return float(v) if isinstance(v, (Decimal, float)) else v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, db, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(db.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_has_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_stream_is_the_batch(spark, sf):
    streamed = live.bucketed_totals(spark, f"{sf}/events.parquet").toPandas()
    e = catalog.events(spark, sf).toPandas()
    e["at"] = e["s"] // 3600 * 3600
    want = e.groupby(["event_type", "at"]).agg(n=("cents", "size"), total=("cents", "sum")).reset_index()
    assert rows(streamed) == rows(want)


def test_changes_are_pushed_once_a_key(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, version long, v string").write.parquet(str(folder))
    seen = []
    q = live.push_changes(live.parquet_stream(spark, str(folder)), "id", "version", lambda df, n: seen.extend(map(tuple, df.collect())), str(tmp_path / "checkpoint"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [(1, 2, "b"), (2, 1, "c")]
