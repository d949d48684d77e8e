"""A keyed table against a dictionary."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from kbspark.sources import merged
from kbspark.sources.merged import MergedTable

SCHEMA = "repo_id long, key string, value int, version int"


def size(path, folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(f"{path}/{folder}") for f in fs if f.endswith(".parquet"))


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_changes_as_in_a_dictionary(spark, tmp_path):
    rng, state = random.Random(3), {}
    table = MergedTable(spark, f"file://{tmp_path}/t", ["repo_id", "key"], buckets=4)
    seen = {}
    for step in range(9):
        some = [(rng.choice([0, 1, None]), f"k{rng.randint(0, 60)}" if rng.random() < 0.9 else None, rng.randint(0, 9), v) for v in range(rng.choice([1, 30]))]
        if step % 3 == 2:
            version = table.delete(spark.createDataFrame(some, SCHEMA))
            for r in some:
                state.pop(r[:2], None)
        else:
            version = table.upsert(spark.createDataFrame(some, SCHEMA), ["version"])
            state |= {r[:2]: r for r in some}
        seen[version] = sorted(state.values(), key=repr)
        if step in (3, 6, 8):
            table.fold(0.0 if step == 6 else 0.3)
        assert rows(table) == seen[version]
    for version in list(seen)[-3:]:
        assert rows(table, version) == seen[version]
    assert table.fold(0.0) == [] or rows(table) == seen[version]


def test_a_small_upsert_writes_little(spark, tmp_path):
    path = tmp_path / "t"
    table = MergedTable(spark, f"file://{path}", ["key"], buckets=4)
    base = spark.range(200_000).select(F.col("id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("value"))
    table.upsert(base)
    table.fold()
    (first,) = set(table.manifest()["base"].values())
    table.upsert(base.filter("key % 100 = 0").withColumn("value", F.lit("new")))
    change = table.manifest()["deltas"][-1]["folder"]
    assert size(path, change) < 0.05 * size(path, first)
    assert table.read().filter("value = 'new'").count() == 2000 and table.read().count() == 200_000
    # the base isn't shuffled for so few changes
    plan = table.read()._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    assert table.fold() == []  # too few changes to write a bucket anew


def test_old_versions_and_what_they_name_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merged, "KEPT_VERSIONS", 2)
    table = MergedTable(spark, f"file://{tmp_path}/t", ["key"], buckets=2)
    for i in range(6):
        table.upsert(spark.createDataFrame([(k, i) for k in range(10)], "key int, value int"))
        table.fold(0.0)
    assert rows(table) == [(k, 5) for k in range(10)]
    assert len(table.versions()) <= 3 and len(os.listdir(tmp_path / "t")) <= 8


def test_writers_in_a_race_lose_nothing(spark, tmp_path):
    table = MergedTable(spark, f"file://{tmp_path}/t", ["key"], buckets=2)
    table.upsert(spark.createDataFrame([(0, 0)], "key int, value int"))
    failed = []

    def work(n):
        try:
            mine = MergedTable(spark, f"file://{tmp_path}/t", ["key"])
            for i in range(3):
                mine.upsert(spark.createDataFrame([(10 * n + i + 1, n)], "key int, value int"))
                mine.fold(0.0)
        except Exception as e:  # noqa: BLE001  reported below
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert rows(table) == sorted([(0, 0)] + [(10 * n + i + 1, n) for n in range(3) for i in range(3)], key=repr)


def test_refused_rows(spark, tmp_path):
    table = MergedTable(spark, f"file://{tmp_path}/t", ["key"])
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(1, 2)], "key int, __bucket int"))
    table.upsert(spark.createDataFrame([], "key int, value int"))
    assert table.read().count() == 0
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([("x", 1)], "key string, value int"))
