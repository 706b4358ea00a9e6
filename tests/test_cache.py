"""Kept tables and results: read while the files are the same, made again when they change, torn ones never read, swept."""

import os

import pytest

from spanforge.plans.cache import Store, cached
from spanforge.plans.query import Compiled, QuerySpec


@pytest.fixture
def data(spark, tmp_path):
    path = str(tmp_path / "in.parquet")
    spark.range(3).write.parquet(path)
    return path


def add(spark, path, n):
    spark.range(n).write.mode("append").parquet(path)


def test_a_table_is_made_once_a_version(spark, tmp_path, data):
    store = Store(spark, str(tmp_path / "kept"))
    read = lambda: store.table("t", store.version_of(data), lambda: spark.read.parquet(data)).count()
    assert [read(), read(), store.made] == [3, 3, 1]
    add(spark, data, 2)
    assert [read(), read(), store.made] == [5, 5, 2]
    # the older version is gone
    (home,) = store.names()
    assert len(os.listdir(home.removeprefix("file:"))) == 1


def test_a_torn_table_is_not_read(spark, tmp_path, data):
    store = Store(spark, str(tmp_path / "kept"))
    version = store.version_of(data)
    store.table("t", version, lambda: spark.range(1))
    (home,) = store.names()
    home = home.removeprefix("file:")
    (name,) = os.listdir(home)
    os.remove(f"{home}/{name}/_SUCCESS")
    assert store.table("t", version, lambda: spark.range(7)).count() == 7 and store.made == 2


def test_results_by_equal_specs_and_versions(spark, tmp_path, data):
    store, seen = Store(spark, str(tmp_path / "kept")), []

    def compute(spec):
        seen.append(spec)
        return Compiled(spark.range(len(seen)), spark.range(10 * len(seen)))

    spec = lambda **more: QuerySpec.from_json('{"metrics": ["total"], "source": "damage"}') if not more else QuerySpec(**more)
    get = lambda s: cached(store, s, store.version_of(data), compute)
    assert get(spec()).rows.count() == 1 and get(QuerySpec(metrics=["total"])).rows.count() == 1 and len(seen) == 1
    assert get(QuerySpec(metrics=["total"], bucketSeconds=5)).series.count() == 20 and len(seen) == 2
    assert get(QuerySpec(metrics=["total"], petRollup=False)).series is None and len(seen) == 3
    add(spark, data, 1)
    assert get(spec()).rows.count() == 4 and len(seen) == 4


def test_the_least_used_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "kept"), most=2)
    for name in ("a", "b", "a", "c"):
        store.table(name, "v", lambda: spark.range(1))
    assert len(store.names()) == 2
    made = store.made
    store.table("c", "v", lambda: spark.range(1))
    assert store.made == made
