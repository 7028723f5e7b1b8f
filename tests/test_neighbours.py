"""Neighbours of many targets beside plain loops, and what the banded form finds of them."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vacantis.operators import neighbours as nb


def plain(rows, targets, k, least):
    good = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = []
    for t, a in targets:
        if t is None or not good(a):
            continue
        s = []
        for i, b in rows:
            if i is not None and good(b) and len(a) == len(b):
                a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
                cos = sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
                s.append((-round(cos, 9), i))
        out += [(t, n + 1, i, -c) for n, (c, i) in enumerate(sorted(x for x in s if -x[0] >= least)[:k])]
    return sorted(out)


def data():
    r = random.Random(17)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(8)]
    near = lambda c, s: [x + r.gauss(0, s) for x in c]
    rows = [(i, near(r.choice(centres), 0.3)) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(3, rows[3][1]), (3, rows[3][1])]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [1.0, None]), (5003, [float("nan")] * 16), (None, rows[0][1]), (5004, [1.0, 2.0]), (5005, []), (5006, [1e200] * 16)]
    targets = [(i, near(r.choice(centres), 0.3)) for i in range(50)] + [(50, rows[3][1]), (51, [2.0, 4.0]), (52, None), (53, [0.0] * 16), (None, rows[0][1]), (54, [3.0] * 16)]
    return rows, targets


@pytest.fixture(scope="module")
def tables(spark):
    rows, targets = data()
    return (spark.createDataFrame([(*x, 1) for x in rows], "id long, embedding array<double>, row int").repartition(4),
            spark.createDataFrame([(*x, 1) for x in targets], "id long, embedding array<double>, dims int"))


@pytest.mark.parametrize("k,least,size", [(10, 0.5, None), (3, -1.0, 40)])
def test_equals_brute_force(tables, monkeypatch, k, least, size):
    if size:
        monkeypatch.setattr(nb, "ROWS", size)
        monkeypatch.setattr(nb, "TARGETS", size // 4)
    got = sorted((r.target_id, r["rank"], r.id, round(r.similarity, 9)) for r in nb.similar_many(*tables, k=k, min_sim=least).collect())
    assert got == plain(*data(), k, least)


def test_banded_form_finds_nine_of_ten_and_cuts_large_buckets(tables, monkeypatch):
    monkeypatch.setattr(nb, "ROWS", 50)  # two hundred copies share all signatures
    rows, targets = tables
    want = nb.similar_many(rows, targets, k=5, min_sim=0.7)
    near = nb.similar_banded(rows, targets, k=5, min_sim=0.7)
    r = nb.recall(want, near).first()
    assert r.neighbours > 200 and r.recall >= 0.9
    assert near.groupBy("target_id", "rank").count().filter("count > 1").isEmpty()
    of_copy = [x.id for x in near.filter("target_id = 50").orderBy("rank").collect()]
    assert of_copy == [3, 3, 3, 1000, 1001]


def test_few_candidates_meet_and_no_cross_join(spark, tables):
    plan = nb.similar_many(*tables)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    r = random.Random(3)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(32)]) for i in range(300)], "id long, embedding array<double>")
    sig = rows.select("id", F.posexplode(nb.signatures(F.col("embedding"), 4, 10)).alias("band", "sig"))
    assert sig.groupBy("band", "sig").count().agg(F.max("count")).first()[0] < 30


def test_empty_tables(tables):
    rows, targets = tables
    for a, b in ((rows.limit(0), targets), (rows, targets.limit(0))):
        assert nb.similar_many(a, b).collect() == [] and nb.similar_banded(a, b).collect() == []
