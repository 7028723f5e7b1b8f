import itertools
from zlib import crc32

import numpy as np
import pytest

from vacantis.llm.factorization import PLACES, RANK, Machine, encode, fit_machine, score, train

from .test_linecrf import good_text, junk_text


def test_linear_time_form_equals_all_pairs():
    r = np.random.default_rng(4)
    m = Machine(0.3, r.normal(size=PLACES), r.normal(size=(PLACES, RANK)))
    rows = [(r.integers(0, PLACES, n), r.normal(size=n)) for n in (1, 5, 30)]
    for (p, v), got in zip(rows, m.scores(rows)):
        z = 0.3 + m.linear[p] @ v + sum(m.factors[p[i]] @ m.factors[p[j]] * v[i] * v[j] for i, j in itertools.combinations(range(len(p)), 2))
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_held_out_accuracy(spark, docs_of):
    rows = [(i, good_text(i) if i % 2 else junk_text(i)) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = docs_of(rows)
    out = score(docs, train(docs, labels)).collect()
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(300) if crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_other_columns_do_not_enter(spark, docs_of):
    rows = [(i, good_text(i)) for i in range(20)]
    m = fit_machine([encode(b"a b", 3, {}), encode(b"c !!", 4, {})], [1, 0])
    a = score(docs_of(rows, lang="en", source="x"), m).orderBy("doc_id").collect()
    b = score(docs_of(rows, lang="fr", source="y"), m).orderBy("doc_id").collect()
    assert [r.score for r in a] == [r.score for r in b]


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    m = train(docs_of([]), none)
    assert score(docs_of([]), m).collect() == []
    out = score(docs_of([(None, ""), (1, None), (2, "x " * 300_000), (2, "é")]), m).collect()
    assert len({r.score for r in out}) == 1 and out[0].score == 0.5 and not out[0].held_out
