import random
from collections import defaultdict
from fractions import Fraction

import pytest

from vacantis.llm.curriculum import SCHEDULES, assigned, due, in_order, mixed, weight, words_in


def plain_targets(sizes, most=3):
    """Targets by giving out the excess again until none is above, in exact fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, target = Fraction(sum(sizes.values())), set(names), {}
    while free:
        total = sum(w[s] for s in free)
        above = {s for s in free if left * w[s] / total > most * sizes[s]}
        if not above:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: Fraction(most * sizes[s]) for s in above}
        left -= sum(most * sizes[s] for s in above)
        free -= above
    return target


@pytest.fixture
def docs(spark):
    r = random.Random(5)
    rows = [(i, " \t".join("w" * r.randrange(1, 5) for _ in range(r.randrange(60))), r.choice(["b", "b", "b", "a", "é", "z", "B", None])) for i in range(600)]
    rows += [(i, "tiny source", "m") for i in range(3)] + [(None, "no id", "a")] * 2 + [(7, None, "q"), (8, "", "q"), (9, "same row", "b"), (9, "same row", "b")]
    rows += [(1000, "one long text " * 60_000, "x")]
    return spark.createDataFrame([(*x, 1, "p") for x in rows], "doc_id long, text string, source string, part int, digest string").repartition(5)


def test_targets_passes_and_cuts(docs):
    got = assigned(docs).collect()
    plain = docs.collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r.doc_id or -1, len((r.text or "").split())) for r in plain)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(u.words for u in r.passes)
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
    for s, n in taken.items():
        assert n == round(want[s]), s
    assert want["q"] == 0 and want["m"] == 18  # a source smaller than its share is used three times
    again = assigned(docs.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), r.size, str(r.source), str(r.passes))
    assert sorted(got, key=key) == sorted(again, key=key)


def test_order_follows_the_schedules(docs):
    uses = mixed(assigned(docs)).collect()
    assert [u.position for u in uses] == sorted(u.position for u in uses) and 0 <= uses[0].position and uses[-1].position < 1
    names = sorted({u.source for u in docs.collect()}, key=lambda s: (s is None, (s or "").encode()))
    for s in names:
        own = [u for u in uses if u.source == s]
        total, so_far = sum(u.words for u in own), 0
        knots = SCHEDULES[names.index(s) % 3]
        for u in own:  # what came before is the demand by that time, from the integral of the lines
            area = sum((min(t, u.position) - a) * (v + v + (w - v) * (min(t, u.position) - a) / (t - a)) / 2
                       for (a, v), (t, w) in zip(knots, knots[1:]) if u.position > a)
            assert area / weight(knots) * total == pytest.approx(so_far, abs=1e-6 * total + 1e-6)
            so_far += u.words


def test_due_inverts_any_lines(spark):
    from pyspark.sql import functions as F

    knots = ((0.0, 0.0), (0.25, 0.0), (0.5, 4.0), (1.0, 0.0))
    rows = spark.range(101).select(due(knots, F.col("id") / 100).alias("t"), "id").orderBy("id").collect()
    assert weight(knots) == 1.5
    for r in rows:
        area = 8 * max(0, min(r.t, 0.5) - 0.25) ** 2 + (1 - 4 * (1 - max(r.t, 0.5)) ** 2)
        assert r.id == 0 or area / 1.5 == pytest.approx(r.id / 100, abs=1e-12)


def test_documents_in_order_and_empty_table(docs):
    rows = in_order(assigned(docs)).collect()
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and [r.position for r in rows[:len(at)]] == at and all(r.taken == 0 for r in rows[len(at):])
    empty = assigned(docs.limit(0))
    assert in_order(empty).collect() == [] and mixed(empty).collect() == []


def test_words(spark):
    for t in (b"", b" ", b"a", b" a", b"a ", b"a\x0bb\x0cc\x1cd \x85", "é ü x".encode()):
        assert words_in(t) == len(t.split()), t
    long = b"ab " * 700_000
    assert words_in(long) == 700_000 and words_in(b"x" * 3_000_000) == 1
