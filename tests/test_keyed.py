"""Keyed tables: writes touch only the buckets of their keys, and give what the whole-table operators give."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vacantis.operators import upserts as up
from vacantis.operators.keyed import Conflict, KeyedTable, bucket_of

SCHEMA = "a long, b string, v string, n int, tags map<string,string>"


def rows_of(df):
    return sorted((str((r.a, r.b, r.v, r.n, sorted((r.tags or {}).items()))) for r in df.collect()))


def data(n, seed, nulls=True):
    r = random.Random(seed)
    out = [(i, f"k{i % 7}", f"v{seed}-{i}", r.choice([None, i]), {"t": str(i % 3)}) for i in r.sample(range(2 * n), n)]
    return out + ([(None, "x", f"loose{seed}", 1, None), (5, None, f"loose{seed}", 2, {})] if nulls else [])


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable.create(spark.createDataFrame(data(500, 1), SCHEMA), f"{tmp_path}/t", ["a", "b"], buckets=16)


def test_writes_give_what_whole_tables_give(spark, table):
    whole = spark.createDataFrame(data(500, 1), SCHEMA)
    assert rows_of(table.read()) == rows_of(whole) and len(table.read([3]).inputFiles()) < len(table.read().inputFiles())
    for seed in (2, 3):
        u = spark.createDataFrame(data(60, seed) + data(60, seed, False)[:5], SCHEMA)
        whole = up.upsert(whole, u, ["a", "b"], ["v", "n"])
        table = table.upsert(u, ["v", "n"])
        assert rows_of(table.read()) == rows_of(whole)
    new = spark.createDataFrame(data(80, 4, False), SCHEMA)
    assert rows_of(table.insert_ignore(new).read()) == rows_of(up.insert_ignore(whole, new, ["a", "b"]))
    gone = spark.createDataFrame(data(40, 5, False), SCHEMA)
    table = KeyedTable(spark, table.path)
    after = up.insert_ignore(whole, new, ["a", "b"]).join(gone.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "v", "n", "tags")
    assert rows_of(table.delete(gone).read()) == rows_of(after)


def test_a_small_write_reads_and_writes_its_buckets_only(spark, table):
    u = spark.createDataFrame([(1, "k1", "new", 9, None), (2, "k2", "new", 9, None)], SCHEMA)
    mine = {r.b for r in u.select(bucket_of(["a", "b"], 16).alias("b")).collect()}
    assert len(mine) <= 2 and set(table.touched(u)) == mine
    read = table.read(table.touched(u))
    assert {f.split("__bucket=")[1].split("/")[0] for f in read.inputFiles()} <= {str(b) for b in mine}
    seen = []
    after = table.apply(lambda rows, x: seen.append(rows) or up.upsert(rows, x, ["a", "b"], ["v"]), u)
    assert set(seen[0].inputFiles()) <= set(read.inputFiles())  # the scan of the write is pruned as well
    old, new = table._manifest["folders"], after._manifest["folders"]
    assert {int(b) for b in new if new[b] != old.get(b)} <= mine and after.version == 1
    (folder,) = {f for b in new if new[b] != old.get(b) for f in new[b]}
    assert {n for n in os.listdir(f"{table.path}/data/{folder}") if n.startswith("__bucket=")} == {f"__bucket={b}" for b in mine}
    assert rows_of(table.read()) != rows_of(after.read())  # the old version is still there


def test_a_repeated_write_makes_no_version(spark, table):
    u = spark.createDataFrame(data(50, 6, False), SCHEMA)
    once = table.upsert(u, ["v", "n", "tags"])
    twice = once.upsert(u, ["v", "n", "tags"])
    assert once.version == 1 and twice is once
    assert once.upsert(u.limit(0), ["v"]).version == 1 and once.delete(u.limit(0)).version == 1
    same = once.read().filter("a IS NOT NULL AND b IS NOT NULL").limit(20)
    assert once.upsert(same, ["v", "n", "tags"]).version == 1


def test_a_write_on_an_old_version_is_refused(spark, table):
    u = spark.createDataFrame([(1, "k1", "x", 1, None)], SCHEMA)
    table.upsert(u, ["v"])
    with pytest.raises(Conflict):
        table.upsert(u, ["v"])
    with pytest.raises(Conflict):
        KeyedTable.create(u, table.path, ["a", "b"], buckets=2)
    assert KeyedTable(spark, table.path).version == 1


def test_vacuum_grown_and_empty(spark, table, tmp_path):
    u = spark.createDataFrame(data(300, 7, False), SCHEMA)
    for n in range(3):
        table = table.upsert(u.withColumn("n", F.lit(n)), ["n"])
    want = rows_of(table.read())
    assert table.vacuum(1) and rows_of(KeyedTable(spark, table.path).read()) == want and table.vacuum(1) == []
    assert rows_of(table.grown(f"{tmp_path}/g", rows_per_bucket=100).read()) == want
    empty = KeyedTable.create(u.limit(0), f"{tmp_path}/e", ["a", "b"])
    assert empty.read().collect() == [] and rows_of(empty.upsert(u, ["v"]).read()) == rows_of(u)
    with pytest.raises(ValueError):
        KeyedTable(spark, f"{tmp_path}/none")


def test_a_write_finds_changed_buckets_by_one_row_each(spark, table, monkeypatch):
    """No row of the table is shuffled to compare the buckets: what meets is a sum for each."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: plans.append(df.columns) or collect(df))
    u = spark.createDataFrame([(1, "k1", "new", 9, None)], SCHEMA)
    after = table.upsert(u, ["v", "n"])
    assert ["b", "s"] in plans and after.version == 1 and after.upsert(u, ["v", "n"]).version == 1
