import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from vacantis.llm import pitmanyor
from vacantis.llm.pitmanyor import EXACT, Model, Totals, draw_tables, scores, stirling


def corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    weight = [1 / (i + 1) for i in range(200)]
    texts = [" ".join(r.choices(words, weight, k=r.randrange(0, 80))).title() for _ in range(300)]
    return texts + [None, "", "  \n ", "É é É", texts[0], "unseen word" + " zz" * 3, "a " * 50_000]


def split(t):
    return [w.decode("utf-8", "surrogateescape") for w in (t or "").encode().lower().split()] + ["\n"]


def test_counts_and_base_equal_the_contract(spark, docs_of):
    texts = corpus()
    got = {x.doc_id: x for x in scores(docs_of(list(enumerate(texts))).repartition(3), bucket_tokens=2000).collect()}
    assert len(got) == len(texts)
    held = {i: crc32(str(i).encode()) % 5 == 1 for i in got}
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        x, w = got[i], split(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(w), sum(c[k] > 0 for k in w), n)
        assert x.base_score == pytest.approx(sum(math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1))) for k in w), rel=1e-9, abs=1e-9)
        assert x.score < 0 and x.perplexity == pytest.approx(10 ** (-x.score / len(w)))
    out = [i for i in got if held[i] and texts[i]]
    assert sum(got[i].score for i in out) > 1.02 * sum(got[i].base_score for i in out)


def test_layout_does_not_change_scores(spark, docs_of):
    docs = docs_of(list(enumerate(corpus()[:80])))
    a = {x.doc_id: x.score for x in scores(docs.repartition(1), bucket_tokens=500).collect()}
    b = {x.doc_id: x.score for x in scores(docs.repartition(7), bucket_tokens=500).collect()}
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_predictive_sums_to_one():
    """Over all known words and the unknown one, in every context, after any sweep."""
    r = np.random.default_rng(1)
    word, k = np.divmod(np.arange(300), 3)
    c = r.poisson(3, 300) * (word % 4 > 0)
    by = np.bincount(k, c, 3)
    m = Model(int(c.sum()), 75, by.astype(float), 0.6, 0.4, [Totals(by.astype(float), float(c.sum()), 75.0)])
    for s in range(1, 4):
        for t, customers, tables in m.replay(word, k, c, 5, s):
            pass
        m.totals.append(Totals(np.bincount(k, t, 3).astype(float), float(customers.sum()), float(tables.sum())))
    last, q = m.totals[-1], 1.0
    p = m.parent(3, customers, tables)
    unknown = m.parent(3, np.zeros(1), np.zeros(1))[0]
    seen = np.bincount(word, c) > 0
    assert p[seen].sum() + unknown * (76 - seen.sum()) == pytest.approx(1)
    for x in range(3):
        at = k == x
        own = (c[at] - 0.6 * t[at]) / (q + by[x]) + (q + 0.6 * last.tables[x]) / (q + by[x]) * p[word[at]]
        rest = (q + 0.6 * last.tables[x]) / (q + by[x])
        assert own[seen].sum() + rest * unknown * (76 - seen.sum()) == pytest.approx(1)
    assert np.isfinite(m.log_predictive(word, k, c, 5)).all()


def test_stirling_counts_seatings():
    d = 0.3
    s = stirling(d, 6)
    for n in range(1, 7):  # every seating of n customers, weighted
        total = Counter()
        def seat(sizes, left):
            if not left:
                w = 1.0
                for x in sizes:
                    for i in range(1, x):
                        w *= i - d
                total[len(sizes)] += w
                return
            for i in range(len(sizes)):
                seat(sizes[:i] + [sizes[i] + 1] + sizes[i + 1:], left - 1)
            seat(sizes + [1], left - 1)
        seat([], n)
        for t in range(1, n + 1):
            assert math.exp(s[n, t]) == pytest.approx(total[t])


@pytest.mark.parametrize("d,a", [(0.3, 0.05), (0.7, 2.0), (0.8, 60.0), (0.5, 900.0)])
def test_draws_follow_the_conditional(d, a):
    r = np.random.default_rng(2)
    for n in (7, EXACT, 4 * EXACT):
        s = stirling(d, n)[n, 1:n + 1] + np.log(a) * np.arange(1, n + 1)
        p = np.exp(s - s.max())
        p /= p.sum()
        mean = (p * np.arange(1, n + 1)).sum()
        sd = math.sqrt((p * (np.arange(1, n + 1) - mean) ** 2).sum())
        t = draw_tables(np.full(4000, n), np.full(4000, a), d, stirling(d), r)
        exact = n <= EXACT
        assert abs(t.mean() - mean) < (5 * sd / math.sqrt(4000) + (1e-3 if exact else 0.04 * mean + 0.5))
        assert 1 <= t.min() and t.max() <= n and (exact or abs(t.std() - sd) < 0.2 * sd + 0.4)


def test_odd_tables(spark, docs_of):
    assert scores(docs_of([])).collect() == []
    row, = scores(docs_of([(1, "a b")]).where("crc32(cast('1' as binary)) > 0")).collect()
    assert row.n_tokens == 3
    rows = scores(docs_of([(None, "a b"), (None, "a b"), (None, None)])).collect()
    assert sorted((x.n_tokens, x.held_out) for x in rows) == [(1, False), (3, False), (3, False)]


def test_workers_give_memory_back(spark, docs_of, monkeypatch):
    eased, seen = pitmanyor.eased, []
    monkeypatch.setattr(pitmanyor, "eased", lambda run: seen.append(run) or eased(run))
    pitmanyor.scores(docs_of([(i, f"a b c{i}") for i in range(20)])).collect()
    assert {f.__name__ for f in seen} == {"run", "hot_counts", "cold_counts", "emit"}


def test_rare_words_are_contexts_of_their_own(spark, docs_of):
    """Words far below the share of frequent ones, each of which is always followed by the same word."""
    r = random.Random(3)
    texts = [" ".join(f"a{i} b{i}" for i in r.choices(range(1500), k=60)) for _ in range(250)]
    docs = docs_of(list(enumerate(texts)))
    rows = scores(docs, bucket_tokens=3000).collect()
    out = [x for x in rows if x.held_out]
    assert out and sum(x.n_known for x in out) > 0.95 * sum(x.n_tokens for x in out)
    # half of the words are certain by then; a shared restaurant gains nothing
    assert sum(x.score for x in out) > 0.7 * sum(x.base_score for x in out)


def test_frequent_words_are_laid_out_but_not_modelled_apart(spark, docs_of):
    texts = corpus()[:-1]
    one, other = ({x.doc_id: x.score for x in scores(docs_of(list(enumerate(texts))), share=share, bucket_tokens=2000).collect()} for share in (1 / 1000, 1 / 20))
    assert sum(one.values()) == pytest.approx(sum(other.values()), rel=0.01)
    assert all(one[i] == pytest.approx(other[i], rel=0.1) for i in one)
