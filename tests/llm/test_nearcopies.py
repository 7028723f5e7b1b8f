import random

import numpy as np

import corpus_pipeline
from vacantis.llm import nearcopies
from vacantis.llm.nearcopies import drop_near_copies

from .test_simhash import groups


def cut(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)} - {b""}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def corpus():
    """Copies that drift by chains, one large group around a text, and a line common to texts that are not alike."""
    r = random.Random(31)
    word = lambda: f"w{r.randrange(3000)}"
    texts = []
    for _ in range(30):
        w = [word() for _ in range(r.randrange(5, 150))]
        for _ in range(6):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(r.randrange(1, 3)):
                w[r.randrange(len(w))] = word()
    hub = [word() for _ in range(120)]
    for _ in range(120):
        w = list(hub)
        for k in r.sample(range(120), r.randrange(1, 4)):
            w[k] = word()
        texts.append(" ".join(w))
    texts += ["one very common line of eight words here " + " ".join(word() for _ in range(r.randrange(12))) for _ in range(150)]
    texts += [None, "", "  ", "a b c d e", "A b  C d e", "a b c d", "a b c", texts[0].upper()]
    r.shuffle(texts)
    return texts


def test_groups_equal_brute_force_and_three_bits_miss_them(spark, docs_of):
    from vacantis.llm.simhash import drop_near_duplicates

    texts = corpus()
    want = set(groups([cut(t) for t in texts], alike))
    docs = docs_of(list(enumerate(texts)))
    got = corpus_pipeline.near_dedup(spark, docs, None)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert len(drop_near_duplicates(docs).collect()) > len(want)


def test_sketches_and_packed_sets_bound_and_count():
    r = np.random.default_rng(9)
    for _ in range(200):
        both, a, b = (r.integers(0, 1 << 63, r.integers(0, 300), np.uint64) * np.uint64(2) for _ in range(3))
        x, y = (np.unique(np.concatenate([both, own])).view(np.int64) for own in (a, b))
        same = len(np.intersect1d(x, y))
        assert nearcopies.shared(nearcopies.packed(x), nearcopies.packed(y)) == same
        bound = nearcopies.shared_at_most(nearcopies.sketch(x), len(x), nearcopies.sketch(y), len(y))
        assert same <= bound <= same + 0.8 * min(len(x), len(y)) + 30


def test_columns_of_any_name(spark, docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "else")])
    for name in ("row", "__row", "ROW_", "a.b", "shingle"):
        got = drop_near_copies(docs.withColumnRenamed("lang", name))
        assert got.columns[2] == name and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_one_row_per_group(spark, docs_of):
    text, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, text), (5, text), (3, text + " end"), (3, other), (None, text), (None, other + " end"), (None, "c d"), (None, "c d")]
    got = sorted(((r.doc_id, r.text) for r in drop_near_copies(docs_of(rows)).collect()), key=str)
    assert got == sorted([(3, text + " end"), (3, other), (None, "c d")], key=str)
    assert drop_near_copies(docs_of([])).collect() == []
    assert len(drop_near_copies(docs_of([(1, "long " * 200_000), (2, "long " * 100_000)])).collect()) == 1


def around(r, copies, most):
    """A text of 120 words and copies of it with up to ``most`` other words: most copies are like the text, few like each other."""
    word = lambda: f"w{r.randrange(10 ** 6)}"
    base = [word() for _ in range(120)]
    out = [" ".join(base)]
    for _ in range(copies):
        w = list(base)
        for k in r.sample(range(120), r.randrange(1, most)):
            w[k:k + 1] = [word()] * r.randrange(3)
        out.append(" ".join(w))
    return out


def test_pivots_lose_no_link(spark, docs_of, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(nearcopies, "BUSY", 4)
    monkeypatch.setattr(nearcopies, "ROUNDS", 0)
    texts = corpus() + around(r, 60, 9)[1:] + around(r, 40, 6)  # one text is not there itself
    want = set(groups([cut(t) for t in texts], alike))
    got = drop_near_copies(docs_of(list(enumerate(texts))))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


def test_a_large_group_of_changed_copies_costs_no_square(spark, docs_of, monkeypatch):
    texts = around(random.Random(5), 400, 12)
    compared, plain = [], nearcopies._kept
    monkeypatch.setattr(nearcopies, "BUSY", 16)
    monkeypatch.setattr(nearcopies, "_kept", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    want = set(groups([cut(t) for t in texts], alike))
    got = drop_near_copies(docs_of(list(enumerate(texts))))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert sum(compared) < 8 * len(texts)  # pair by pair, 9,077


def test_differences_from_a_pivot_meet_where_both_were_changed():
    """Heads of the differences from any pivot have one in common, whenever two alike sets are not both alike to it."""
    r = np.random.default_rng(4)
    much, of = nearcopies.ALIKE
    met = 0
    for _ in range(3000):
        base = r.choice(400, r.integers(5, 120), replace=False).astype(np.uint64)
        copy = lambda k: np.unique(np.concatenate([r.permutation(base)[k:], r.integers(0, 400, r.integers(0, k + 1)).astype(np.uint64)]))
        pivot, a, b = (copy(int(r.integers(0, max(1, len(base) // 3)))) for _ in range(3))
        if r.random() < 0.3:
            pivot = np.unique(np.concatenate([pivot[: len(pivot) // 5], r.integers(400, 500, 60).astype(np.uint64)]))
        if not len(np.intersect1d(a, b)) * (of + much) >= much * (len(a) + len(b)) or np.array_equal(a, b):
            continue
        common = np.unique(r.integers(0, 400, 100)).astype(np.uint64)
        rank = r.permutation(len(common))
        (x, d, head, near), (y, e, other, close) = (nearcopies.differing(s, pivot, common, rank) for s in (a, b))
        assert d == len(np.setxor1d(a, pivot)) and x == (9 * len(np.intersect1d(a, pivot)) >= 4 * (len(a) + len(pivot)))
        if not x or not y:
            met += 1
            own, its = (head[:near] if x or not y else head), (other[:close] if y or not x else other)
            assert len(np.intersect1d(own, its))
    assert met > 300


def test_a_large_group_without_its_base_is_not_compared_pair_by_pair(spark, docs_of, monkeypatch):
    """Copies of a text that is not there, four changes each: all lack what the pivot was changed in; before, 75,106 comparisons."""
    r = random.Random(6)
    base = [f"w{r.randrange(10 ** 6)}" for _ in range(150)]
    texts = []
    for _ in range(500):
        w = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 2, 3, 3, 3, 4, 4])):
            w[k] = f"w{r.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    compared, plain = [], nearcopies._kept
    monkeypatch.setattr(nearcopies, "_kept", lambda pairs, *rest: compared.append(pairs.count()) or plain(pairs, *rest))
    want = set(groups([cut(t) for t in texts], alike))
    got = drop_near_copies(docs_of(list(enumerate(texts))))
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert sum(compared) < 50 * len(texts)
