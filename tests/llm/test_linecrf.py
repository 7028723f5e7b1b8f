import itertools
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np

from vacantis.llm.linecrf import ALL_CONTENT, FEATURES, Chain, fit_chain, judge, keep_good, read, train


def good_text(seed):
    r = random.Random(f"good{seed}")
    word = lambda: "".join(r.choice(["an", "or", "ti", "el", "mo", "su"]) for _ in range(r.randrange(1, 5)))
    return "\n".join(" ".join(word() for _ in range(r.randrange(8, 20))).capitalize() + "." for _ in range(8))


def junk_text(seed):
    r = random.Random(f"junk{seed}")
    word = lambda: "".join(r.choice(["AN", "OR", "TI", "EL"]) for _ in range(r.randrange(1, 6))) + r.choice(["!!", "$$$", "%%%"])
    return "\n".join(" ".join(word() for _ in range(12)) for _ in range(8))


def plain_counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit)]


def texts():
    r = random.Random(12)
    out = [None, "", " \n\t", "a", "a a a a", "x y z x y z", "é\xa0ü b c\x0bd", "#|<>\n#|<>\n\n#|<>"]
    for _ in range(200):
        out.append("".join(r.choice(["a ", "b ", "c\n", "dé ", "# ", "\r", "\t"]) for _ in range(r.randrange(150))))
    return out + ["long words " * 100_000]


def test_counts_equal_the_contract(spark, docs_of):
    rows = list(enumerate(texts()))
    for r in judge(docs_of(rows), ALL_CONTENT).collect():
        want = plain_counts(rows[r.doc_id][1])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)


def test_viterbi_equals_trying_every_marking():
    r = np.random.default_rng(3)
    chain = Chain(r.normal(size=FEATURES), r.normal(size=(2, 2)))
    lines = [r.normal(size=(n, FEATURES)).astype(np.float32) for n in (3, 0, 1, 7, 5)]
    for x, got in zip(lines, chain.mark(lines)):
        value = lambda m: sum(x[i] @ chain.line for i, v in enumerate(m) if v) + sum(chain.change[a, b] for a, b in zip(m, m[1:]))
        if len(x):
            assert np.isclose(value(got), max(map(value, itertools.product((0, 1), repeat=len(x)))))
        assert len(got) == len(x)


def test_fit_separates_and_holds_out(spark, docs_of):
    rows = [(i, good_text(i) if i % 2 else junk_text(i)) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = docs_of(rows)
    chain = train(docs, labels)
    out = {r.doc_id: r.kept for r in judge(docs, chain).collect()}
    held = [i for i in out if crc32(str(i).encode()) % 5 == 0]
    assert held and all(out[i] == bool(i % 2) for i in held)
    assert {r.doc_id for r in keep_good(docs, chain).collect()} == {i for i, k in out.items() if k}
    assert keep_good(docs, chain).columns == docs.columns


def test_likelihood_has_the_gradient_that_is_climbed():
    """With lines of one feature each, the fit agrees with logistic regression on isolated lines."""
    good, bad = np.eye(FEATURES, dtype=np.float32)[[1]], np.eye(FEATURES, dtype=np.float32)[[2]]
    chain = fit_chain([good] * 50 + [bad] * 50 + [good] * 5, [1] * 50 + [0] * 50 + [0] * 5, rounds=600, decay=0.0)
    assert abs(1 / (1 + np.exp(-chain.line[1])) - 50 / 55) < 0.02 and chain.line[2] < -3


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert train(docs_of([]), none) is ALL_CONTENT
    assert judge(docs_of([]), ALL_CONTENT).collect() == [] and keep_good(docs_of([]), ALL_CONTENT).collect() == []
    assert [r.kept for r in judge(docs_of([(None, good_text(1))] * 2), ALL_CONTENT).collect()] == [True, True]
    assert read(b"")[0] == [0, 0, 0, 0, 0]
