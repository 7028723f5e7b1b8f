import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantis.llm import hardneg as module
from vacantis.llm.hardneg import Anchor, Bucket, hard_negatives, shelves, whole


def plain(rows, k, m, low, high):
    """The contract, word for word."""
    known = [(n, i, lab, [math.floor(256 * x) for x in v]) for n, (i, v, lab) in enumerate(rows)
             if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, i, lab, v in known:
        if i % 50:
            continue
        scored = sorted((-dot(v, w), j, o, la) for o, j, la, w in known if o != n)
        for s, j, _, _ in [x for x in scored if x[3] == lab][:k]:
            fit = [x for x in scored if x[3] != lab and low * -s <= 100 * -x[0] <= high * -s][:m]
            out += [(i, j, rank + 1, x[1], -s, -x[0]) for rank, x in enumerate(fit)]
    return sorted(out)


def vectors():
    r = random.Random(12)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(4)]
    rows = []
    for i in range(700):
        c = r.randrange(4)
        size = r.choice([0.2, 1, 5])
        rows.append((i, [size * (x + r.gauss(0, 0.7)) for x in centres[c]], (c + (r.random() < 0.2)) % 4))
    rows += [(2000 + i, rows[50][1], 1) for i in range(40)] + [(50, rows[50][1], 2), (50, rows[50][1], 2), (100, rows[7][1], rows[7][2])]
    rows += [(None, [1.0] * 12, 1), (3000, None, 1), (3050, [1.0] * 12, None), (3100, [1.0, None], 1), (3150, [float("nan")], 1), (3200, [float("inf")], 1)]
    rows += [(3250, [], 1), (3300, [0.0] * 12, 2), (3350, [2.0, 1.0], 3), (3400, [1.0] * 20, 3), (3450, [1e6] * 12, 1), (3500, [-1e6, 3e6] * 6, 2), (3550, [4.0] * 12, 77)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*x, 1.0, "r") for x in vectors()], "vec_id long, embedding array<double>, label int, length double, row string").repartition(4)


@pytest.mark.parametrize("k,m,low,high", [(5, 3, 50, 95), (2, 4, 90, 100)])
def test_equals_brute_force(table, k, m, low, high):
    got = sorted(map(tuple, hard_negatives(table, F.col("id") % 50 == 0, k, m, low, high).collect()))
    assert got == plain(vectors(), k, m, low, high)


def test_small_blocks_and_shelves(table, monkeypatch):
    monkeypatch.setattr(module, "SHELF", 60)
    monkeypatch.setattr(module, "TOGETHER", 5)
    monkeypatch.setattr(module, "BLOCK_BITS", 1)
    got = sorted(map(tuple, hard_negatives(table, F.col("id") % 50 == 0).collect()))
    assert got == plain(vectors(), 5, 3, 50, 95)


def test_buckets_hold_every_row_once_in_length_order(table):
    rows = whole(table)
    cut = shelves(rows.coalesce(1).sortWithinPartitions("label", F.desc("length")), 32).collect()
    held = [x for r in cut for x in np.frombuffer(r.rows, np.int64).tolist()]
    assert sorted(held) == sorted(r.row for r in rows.collect()) and max(r.n for r in cut) == 32
    for r in cut:
        b = Bucket(r.asDict())
        assert b.longest == b.lengths.max()
        for f in range(b.dims):
            assert (np.diff(b.sorted_list(f)) >= 0).all()


def test_no_candidate_is_lost_and_some_are_cut(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(6, 16))
    data = [(i, (centres[i % 6] + 0.15 * r.normal(size=16)).tolist(), 0) for i in range(600)]
    rows = whole(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    cut = [Bucket(x.asDict()) for x in shelves(rows.coalesce(1).sortWithinPartitions(F.desc("length")), 128).collect()]
    looked, of = 0, 0
    for x in rows.where("id % 60 = 0").collect():
        q = Anchor(x.row, 0, np.array(x.vec), x.length)
        for b in cut:
            s = b.scores(q, None)
            for share in (0.3, 0.8, 0.95, 1.0):
                bar = share * q.length * b.longest
                some = b.candidates(q, bar)
                some = np.arange(b.n) if some is None else some
                assert set(np.flatnonzero(s >= bar)) <= set(some)
                looked, of = looked + len(some), of + b.n
    assert looked < of / 2


def test_empty_table_and_no_anchor(table):
    assert hard_negatives(table.limit(0), F.col("id") % 50 == 0).collect() == []
    assert hard_negatives(table, F.col("id") == -1).collect() == []
