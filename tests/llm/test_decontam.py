import random

import numpy as np

from vacantis.llm import decontam
from vacantis.llm.decontam import MASKS, drop_leaks, leaks, longest, seeds, word_hashes


def words(text):
    import string

    return [w for w in (w.strip(string.punctuation) for w in (text or "").lower().split()) if w]


def brute(doc, item, identity=0.8, overlap=13):
    """Longest leak over every distance, by plain loops; of a long item over those that have a seed hit."""
    d, q, best = words(doc), words(item), None
    for shift in range(-len(q) + 1, len(d)):
        span = range(max(0, -shift), min(len(q), len(d) - shift))
        if len(q) < overlap:
            n = sum(q[k] == d[k + shift] for k in span)
            if n and n >= identity * len(q) - 1e-9:
                new = (len(span), n, -(span.start + shift), -span.start)
                best = max(best, new) if best else new
            continue
        if not any(all(k + o in span and q[k + o] == d[k + o + shift] for o in m) for m in MASKS for k in span):
            continue
        for a in span:
            for b in range(a + 1, span.stop + 1):
                n = sum(q[k] == d[k + shift] for k in range(a, b))
                if n >= identity * (b - a) - 1e-9 and q[a] == d[a + shift] and q[b - 1] == d[b - 1 + shift] and b - a >= overlap:
                    new = (b - a, n, -(a + shift), -a)
                    best = max(best, new) if best else new
    return best


def cases():
    r = random.Random(5)
    items = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randrange(5, 30))) for _ in range(12)] + ["to be or not", "", None]
    docs = []
    for k in range(60):
        d = [f"v{r.randrange(300)}" for _ in range(r.randrange(10, 50))]
        part = words(items[k % 12])
        for i in r.sample(range(len(part)), len(part) * (k % 4) // 10):
            part[i] = "zz"
        docs.append(" ".join(d[:5] + part[: len(part) - k % 3] + d[5:]).title().replace(" Zz", ", zz"))
    return items, docs + ["", None, "only words"]


def test_leaks_equal_brute_force(spark, docs_of):
    items, docs = cases()
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, doc_id long")
    table = docs_of(list(enumerate(docs)))
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_same, -r.doc_start, -r.item_start) for r in leaks(table, bench).collect()}
    want = {(i, j): b for i, d in enumerate(docs) for j, t in enumerate(items) if (b := brute(d, t))}
    assert got == want and len(want) > 20
    kept = {r.doc_id for r in drop_leaks(table, bench).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def test_short_items_with_a_substitution_anywhere(spark, docs_of, monkeypatch):
    """Items of 1 to 12 words, one of the allowed substitutions at every place, ends included; small groups."""
    monkeypatch.setattr(decontam, "TOGETHER", 3)
    items, docs = [], []
    for n in range(1, 13):
        item = [f"n{n}w{k}" for k in range(n)]
        items.append(" ".join(item))
        docs.append(" ".join(["x", *item, "y"]))
        for k in range(n):
            part = [w if i != k else "sub" for i, w in enumerate(item)]
            docs.append(" ".join(["x", *part, "y"]))
            docs.append(" ".join(part[1:] if k == 0 else part[:-1] if k == n - 1 else [*part[:k], *part[k:]]))  # at the document's ends
            if n > 9:
                docs.append(" ".join(w if i not in (k, (k + 5) % n) else "sub" for i, w in enumerate(item)))
    items += [items[6], "to be", "to be or not", "to be or not to"]
    docs += ["to be or not to be that is"] * 5 + ["to"] * 3
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_same, -r.doc_start, -r.item_start) for r in leaks(docs_of(list(enumerate(docs))), bench).collect()}
    want = {(i, j): b for i, d in enumerate(docs) for j, t in enumerate(items) if (b := brute(d, t))}
    assert got == want and len(want) > 100


def test_substitutions_within_the_share_are_found(spark, docs_of):
    """One word in five replaced, at even distances, so that no six words in a row agree."""
    item = [f"i{k}" for k in range(40)]
    doc = ["x"] * 20 + [w if k % 5 != 4 else "sub" for k, w in enumerate(item)] + ["y"] * 20
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    row, = leaks(docs_of([(1, " ".join(doc))]), bench).collect()
    assert (row.item_id, row.doc_start, row.item_start, row.n_words, row.n_same) == (7, 20, 0, 39, 32)


def test_odd_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g")], "item_id long, text string")
    assert leaks(docs_of([(1, "a")]), none).collect() == []
    assert leaks(docs_of([]), one).collect() == []
    assert {r.doc_id for r in drop_leaks(docs_of([(1, "a"), (None, None)]), none).collect()} == {1, None}
    assert [(r.doc_id, r.item_id) for r in leaks(docs_of([(None, "x a b c d e f g " + "z " * 200_000)]), one).collect()] == [(None, None)] * 2


def test_longest_and_seeds():
    r = random.Random(6)
    for _ in range(300):
        same = np.array([r.random() < 0.7 for _ in range(r.randrange(1, 25))])
        got = longest(same, 0.8)
        size = max((b - a for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                    if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=0)
        assert got[1] == size and got[2] == same[got[0]:got[0] + size].sum()
    w = word_hashes(b"A, b c! D e f g h i j")
    v = word_hashes(b"a b X d e f g h i j")
    assert (seeds(w, (0, 1, 3, 4, 6))[0] == seeds(v, (0, 1, 3, 4, 6))[0]) and len(seeds(w[:3], MASKS[0])) == 0
