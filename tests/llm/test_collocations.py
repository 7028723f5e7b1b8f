import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vacantis.llm import collocations as module
from vacantis.llm.collocations import Container, Trie, blocks, collocations, hash_of, phrase_counts, words_of


def plain(rows, least, top, share):
    """The contract, word for word."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cands = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(100 * b >= share * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items() if len(q) > len(p)):
                continue
            score, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus():
    r = random.Random(11)
    names = ["new", "york", "city", "of", "the", "and", "é", "ü", "a\x1cb", "x" * 40, "\x85", "Z", "z"]
    texts = []
    for _ in range(300):
        w = []
        for _ in range(r.randrange(40)):
            w += r.choice([["New", "York", "City"], ["new", "york"], [r.choice(names)], ["of", "the"], [r.choice(names), r.choice(names)]])
        texts.append("".join(x + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! "]) for x in w))
    texts += [None, "", " ", "...", "a", "new york", "one two three four"] + ["same same same same"] * 12
    rows = [(t, r.choice(["en", "en", "en", "fr", None, "und", ""])) for t in texts]
    return rows + [("deep water runs. " * 300_000 + "deep water", "long")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*x, 1, "w") for x in corpus()], "text string, lang string, a long, w string").repartition(6)


@pytest.mark.parametrize("least,top,share", [(10, 2000, 50), (2, 7, 90)])
def test_equals_brute_force(docs, least, top, share):
    got = sorted(map(tuple, collocations(docs, least, top, share).collect()))
    assert got == plain(corpus(), least, top, share)


def test_empty_table(docs):
    assert collocations(docs.limit(0)).collect() == []


def test_counts_past_64_bits_stay_exact(spark):
    n = 3_037_000_503  # its square needs 64 bits
    row = spark.createDataFrame([(n, n, 2 * n - 1)], "a long, l long, r long").select(module._score(*map(module.F.col, "alr")).alias("s")).first()
    assert row.s == 10**6 * n * n // (n * (2 * n - 1))


def test_trie_bursts_and_spills_sorted_runs(monkeypatch):
    monkeypatch.setattr(module, "BURST", 50)
    r, trie, want, runs = np.random.default_rng(3), Trie(), Counter(), Counter()
    for turn in range(40):
        ids = r.integers(1, 60, 300).astype(np.uint64) * np.uint64(977 if turn % 2 else 1)
        keys = (ids << np.uint64(42)) | (np.roll(ids, 1) << np.uint64(21)) | np.roll(ids, 2)
        want.update(keys.tolist())
        trie.count(keys)
        assert trie.size == sum(len(k) for k, _ in trie.runs())
        if turn % 7 == 6:
            for k, c in trie.spill(trie.size // 2):
                assert (np.diff(k.astype(np.int64)) > 0).all()
                runs.update(dict(zip(k.tolist(), c.tolist())))
    assert any(isinstance(c, module.Node) for c in trie.children)
    for k, c in trie.spill(0):
        runs.update(dict(zip(k.tolist(), c.tolist())))
    assert runs == want and trie.size == 0


def test_container_equals_a_dictionary():
    r, box, want = np.random.default_rng(4), Container(), Counter()
    for _ in range(60):
        k, c = np.unique(r.integers(0, 500, 80).astype(np.uint64) << np.uint64(40), return_counts=True)
        box.add(k, c)
        want.update(dict(zip(k.tolist(), c.tolist())))
    assert dict(zip(*(x.tolist() for x in box.items()))) == want and box.size == len(want)


def test_blocks_end_between_words(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 10)
    texts = [b"aa bb", b"a very long text. with words, and" + b"x" * 30 + b" end", b"", b"c"]
    parts = list(blocks(texts))
    joined = b"".join(b if on else b"." + b for b, on in parts)[1:]
    assert joined == b".".join(texts) and max(len(b) for b, _ in parts) < 45
    assert words_of(b" A.b,\tC d ").to_pylist() == ["a", ".", "b", ".", "c", "d"] and words_of(b"").to_pylist() == []


def test_a_shared_hash_starts_again(spark, docs, monkeypatch):
    monkeypatch.setattr(module, "hash_of", lambda lang, w, seed: hash_of(lang, w, seed) >> (60 if seed == 0 else 0))
    small = docs.where("lang = 'fr'").limit(20)
    words, pairs, _ = phrase_counts(small, 1)
    assert words.groupBy("a").count().where("count > 1").isEmpty() and words.count() == words.select("w").distinct().count()
