import re
from collections import defaultdict

from vacantis.llm import urltree
from vacantis.llm.urltree import RULES, judge


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def ruled(host, path):
    fit = [(len(t), t, v) for v, t in RULES
           if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fit)[1:] if fit else (None, None)


def shape(path):
    return "/".join(re.sub("[0-9]+", "#", "#" if re.fullmatch("[0-9a-fA-F-]{16,}", s) else s) for s in path.split("/") if s)


def brute(urls, examples):
    """Verdicts of the method by plain dictionaries, a level at a time."""
    n, lab, bad = defaultdict(int), defaultdict(int), defaultdict(int)
    key = lambda u: (split(u)[0], shape(split(u)[1]))
    for u in urls:
        n[key(u)] += 1
    for u, b in examples:
        lab[key(u)] += 1
        bad[key(u)] += b
    done = {k: [] for k in set(n) | set(lab)}
    segs = {k: k[1].split("/") if k[1] else [] for k in done}
    for d in range(max(map(len, segs.values()), default=0)):
        kids = defaultdict(int)
        for k in done:
            if len(segs[k]) > d:
                kids[k[0], "/".join(done[k]), segs[k][d]] += n[k]
        ways, total = defaultdict(int), defaultdict(int)
        for (h, p, s), c in kids.items():
            ways[h, p] += 1
            total[h, p] += c
        star = {(h, p, s) for (h, p, s), c in kids.items() if ways[h, p] >= 8 and c < 0.05 * total[h, p]}
        for k in done:
            if len(segs[k]) > d:
                s = segs[k][d]
                done[k] = done[k] + ["*" if (k[0], "/".join(done[k]), s) in star else s]
    node = defaultdict(lambda: [0, 0])
    for k, t in done.items():
        for d in range(len(t) + 1):
            node[k[0], tuple(t[:d])][0] += lab[k]
            node[k[0], tuple(t[:d])][1] += bad[k]

    def apart(h, t):
        (l, b), (pl, pb) = node[h, t], node[h, t[:-1]]
        if not (0 < l < pl and 0 < pb < pl):
            return False
        p = pb / pl
        return (b / l - (pb - b) / (pl - l)) ** 2 > 1.96 ** 2 * p * (1 - p) * (1 / l + 1 / (pl - l))

    group, sums = {}, defaultdict(lambda: [0, 0])
    for k, t in done.items():
        group[k] = k[0], next((tuple(t[:d]) for d in range(len(t), 0, -1) if apart(k[0], tuple(t[:d]))), ())
        sums[group[k]][0] += lab[k]
        sums[group[k]][1] += bad[k]
    good = 1 - sum(bad.values()) / max(1, sum(lab.values()))
    return {u: "block" if sum(lab.values()) and (sums[group[key(u)]][0] - sums[group[key(u)]][1] + 5 * good) / (sums[group[key(u)]][0] + 5) < 0.5
            else "allow" for u in urls}


def test_judge_equals_brute_force(spark):
    urls, examples = [], []
    for k in range(400):
        host = ["a.net", "B.net", "c.example.org", "d.com"][k % 4]
        section = ["news", "shop", "tag", f"user{k % 60}x"][k // 4 % 4]
        leaf = [f"{k}", f"{k}.html", f"slug-{'abcdefghijklmnopqrst'[k % 20]}", "deadbeefdeadbeef00"][k // 16 % 4]
        u = f"https://{host}/{section}//{leaf}/?q={k}#x"
        urls.append(u)
        if k % 3:
            examples.append((u, section == "shop" or k % 11 == 0))
    urls += [None, "", "no scheme", "http://", "x://h", "x://H?p=/a", "x://h#/b", "http://é.ORG/es/1", "http://www.example.org/en/12",
             "http://notexample.org/es/1", "ftp://a://b/c", "http://fr.com/fr/é\n1", "http://com/de/", urls[0], "http://example.org/es"]
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    labelled = spark.createDataFrame(examples, "url string, bad boolean")
    method = brute(urls, examples)
    assert "block" in method.values()
    got = judge(table, labelled).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = split(urls[r.page_id])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or method[urls[r.page_id]]), urls[r.page_id]


def test_odd_tables_and_plan(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([(None, "http://x.net/a"), (None, "http://x.net/a")], "page_id long, url string")
    assert judge(pages.limit(0), none).collect() == []
    assert [r.verdict for r in judge(pages, none).collect()] == ["allow"] * 2
    labelled = spark.createDataFrame([("http://x.net/b", True)] * 20 + [("http://y.net/b", False), ("http://z", None)], "url string, bad boolean")
    df = judge(pages, labelled)
    assert [r.verdict for r in df.collect()] == ["block"] * 2
    assert "Python" not in df._jdf.queryExecution().toString()
    labels = spark.createDataFrame([(1, 0, None), (2, 1, 1), (3, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    urls = spark.createDataFrame([(f"http://h/en/{k}.html?x=9",) for k in (1, 2, 3, 4)] + [(None,), ("http://h/99999999999999999999",)], "url string")
    assert {(r.url[12], r.bad) for r in urltree.examples_of(urls, labels).collect()} == {("1", True), ("2", True), ("3", False)}
