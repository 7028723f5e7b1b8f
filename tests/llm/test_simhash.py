import random

import xxhash

from vacantis.llm.simhash import drop_near_duplicates, fingerprint, links, near_duplicates


def plain(text):
    """The contract, word for word."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    """Smallest reachable index by plain search over all pairs."""
    root = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i in range(len(values)):
            for j in range(i):
                if near(values[i], values[j]) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_equals_the_contract():
    r = random.Random(1)
    texts = ["", "A", "a  b", "A b\tC", "a b c d e"] + [" ".join(r.choice("abcdefg") for _ in range(r.randrange(40)))
                                                        for _ in range(200)]
    assert [fingerprint(t.encode()) for t in texts] == [signed(plain(t)) for t in texts]


def test_links_equal_all_pairs(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for _ in range(12):
            values.add(b ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 5))))
    values = sorted(signed(v) for v in values)
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    got = [(r.u, r.v) for r in links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()]
    want = {(a, b) for i, b in enumerate(values) for a in values[:i] if near(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_links_are_not_broadcast(spark, tmp_path):
    """A small table of fingerprints has 17 visitors a half, which no one is to hold at once."""
    spark.range(2000).selectExpr("xxhash64(id) AS fp").write.parquet(f"{tmp_path}/fp")
    found = links(spark.read.parquet(f"{tmp_path}/fp"))
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_groups_equal_brute_force(spark, docs_of):
    r = random.Random(3)
    texts = []
    for _ in range(25):
        w = [f"w{r.randrange(500)}" for _ in range(120)]
        texts.append(" ".join(w))
        for _ in range(3):  # chains of copies that drift
            w = list(w)
            w[r.randrange(len(w))] = "z"
            texts.append(" ".join(w))
    texts += [None, "", "  ", texts[0], texts[0].upper()]
    rows = near_duplicates(docs_of(list(enumerate(texts)))).orderBy("doc_id").collect()
    want = groups([plain(t) for t in texts], lambda a, b: bin(a ^ b).count("1") <= 3)
    assert [x.component_id for x in rows] == want
    assert [x.fp for x in rows] == [signed(plain(t)) for t in texts]
    kept = {x.doc_id for x in drop_near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    assert kept == set(want)


def test_odd_tables(spark, docs_of):
    assert near_duplicates(docs_of([])).collect() == []
    out = near_duplicates(docs_of([(None, "a b c"), (None, ""), (5, ""), (5, ""), (6, "long " * 200_000)])).collect()
    assert len(out) == 5
    assert {(x.doc_id, x.component_id) for x in out if x.fp == 0} == {(None, 5), (5, 5)}
    kept = drop_near_duplicates(docs_of([(None, "a b c"), (7, "a b c"), (3, "a b c")]))
    assert sorted(kept.columns) == sorted(docs_of([]).columns)
    assert {x.doc_id for x in kept.collect()} == {None, 3}
