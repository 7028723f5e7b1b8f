"""Selector tables against a matcher that asks every element by itself."""

import random
import time

import pytest

from vacantis.operators import selectors as sl
from vacantis.operators.dom import _parse


def plain(nodes, alive, i, steps, k, all_steps):
    """Whether element i is found by steps 0..k, from right to left."""
    s, e = steps[k], nodes[i]
    if not test(nodes, alive, i, s, all_steps):
        return False
    if k == 0:
        return True
    up = e["up"]["n"] if e["up"] is not None else None
    sibs = [j for j in range(len(nodes)) if alive[j] and (nodes[j]["up"]["n"] if nodes[j]["up"] is not None else None) == up]
    if s["joined"] == ">":
        return up is not None and plain(nodes, alive, up, steps, k - 1, all_steps)
    if s["joined"] == "+":
        at = sibs.index(i)
        return at > 0 and plain(nodes, alive, sibs[at - 1], steps, k - 1, all_steps)
    if s["joined"] == "~":
        return any(plain(nodes, alive, j, steps, k - 1, all_steps) for j in sibs if j < i)
    while up is not None:
        if plain(nodes, alive, up, steps, k - 1, all_steps):
            return True
        up = nodes[up]["up"]["n"] if nodes[up]["up"] is not None else None
    return False


def test(nodes, alive, i, s, all_steps):
    e = nodes[i]
    if not alive[i] or s["tag"] and e["tag"] != s["tag"] or s["id"] and e["attrs"].get("id") != s["id"]:
        return False
    if any(c not in e["classes"] for c in s["classes"]):
        return False
    for name, op, value in s["tests"]:
        x = e["attrs"].get(name)
        if x is None or not {"": True, "=": x == value, "~=": value in x.split(), "^=": bool(value) and x.startswith(value),
                             "$=": bool(value) and x.endswith(value), "*=": bool(value) and value in x}[op]:
            return False
    up = e["up"]
    for kind, a, b in s["nth"]:
        sibs = [n["n"] for n in nodes if alive[n["n"]] and n["up"] is up and ("type" not in kind or n["tag"] == e["tag"])]
        at = sibs.index(i) + 1 if not kind.startswith("last") else len(sibs) - sibs.index(i)
        if not any(a * n + b == at for n in range(len(nodes) + 2)):
            return False
    return not any(test(nodes, alive, i, all_steps[k], all_steps) for k in s["nots"])


test.__test__ = False


def random_page(r):
    out, open_ = [], []
    for _ in range(r.randrange(60)):
        what = r.random()
        if what < 0.6:
            tag = r.choice(["div", "ul", "li", "a", "p", "h2", "br", "span"])
            attrs = "".join([r.choice(["", "", f' class="{" ".join(r.sample(["a", "b", "job", "x-y"], r.randrange(3)))}"']), r.choice(["", "", ' id="m"']),
                             r.choice(["", "", f" data-k='{r.choice(['v1', 'v2 v1', ''])}'", ' HREF="/job/1"'])])
            out.append(f"<{tag}{attrs}>")
            open_.append(tag)
        elif what < 0.85 and open_:
            out.append(f"</{open_.pop() if r.random() < 0.8 else r.choice(['div', 'li', 'ul'])}>")
        else:
            out.append(r.choice(["text", " ", "&amp;", "<!-- x -->", "<script>var a='<li>'</script>"]))
    return "".join(out)


SELECTORS = ["*", "div", "ul li", "ul > li", ".job", "li.job.a", "#m", "[data-k]", "[data-k=v1]", "[data-k~=v1]", "[data-k^=v2]", "[data-k$='1']", "a[href*=job]", "[data-k*='']",
             "li:nth-child(2n+1)", "li:nth-child(odd)", "*:nth-child(3)", "li:nth-of-type(-n+2)", ":last-child", "p:first-of-type", "div:nth-last-child(2)",
             "li + li", "h2 ~ p", "div p > a", "div > ul li:not(.a)", "p:not([data-k=v1])", "div, p, li a", ".a .b, ul > .b", "div div div", "* > * + *", "a:not(:first-child)",
             "[ data-k = \"v2 v1\" ] , .x-y"]


@pytest.mark.parametrize("drop", [None, ".a", "ul > li:first-child"])
def test_every_selector_equals_the_plain_matcher(drop):
    r = random.Random(21)
    rules = [(f"s{i}", s) for i, s in enumerate(SELECTORS)] + ([("noise", drop, None, True)] if drop else [])
    rows = []
    for place, row in enumerate(sl.selector_rows(rules)):
        d = dict(zip(["name", "layout", "gone", "alternative", "step", "joined", "tag", "id", "classes", "tests", "nth", "nots"], row)) | {"place": place}
        d["tests"] = [dict(zip(("name", "op", "value"), t)) for t in d["tests"]]
        d["nth"] = [dict(zip(("kind", "a", "b"), t)) for t in d["nth"]]
        rows.append(d)
    found_some = set()
    for _ in range(60):
        html = random_page(r)
        engine = sl._Rules(rows)
        page, found = engine.found(html, None)
        nodes = _parse(html, {"script", "style"}, set()).nodes
        alive = [True] * len(nodes)
        by_name = {}
        for (gone, _, name, _), chain in engine.chains.items():
            by_name.setdefault((gone, name), []).append(chain)
        if drop:
            out = {i for i in range(len(nodes)) if any(plain(nodes, alive, i, c, len(c) - 1, engine.steps) for c in by_name[True, "noise"])}
            alive = [not any(j <= i <= nodes[j]["last"] for j in out) for i in range(len(nodes))]
        for (gone, name), chains in by_name.items():
            if not gone:
                want = [i for i in range(len(nodes)) if any(plain(nodes, alive, i, c, len(c) - 1, engine.steps) for c in chains)]
                assert [i for i, hit in enumerate(found.get(name, [])) if hit] == want, (html, name)
                if want:
                    found_some.add(name)
    assert len(found_some) >= (len(SELECTORS) - 1 if not drop else 10)


def test_unreadable_selectors_are_refused():
    for bad in ["", "div >", "> div", "a,,b", ".", "div[", ":hover", "li:nth-child(x)", "li:nth-child()", "p:not(a b)", "a b]"]:
        with pytest.raises(ValueError):
            sl.selector_rows([("x", bad)])


def test_rows_cards_layouts_and_odd_pages(spark):
    html = ('<nav><ul><li class="job"><a href="/no">menu</a></li></ul></nav><ul class="jobs"><li class="job" id="1"><a href="/j/1"><h3>One <b>a</b></h3></a>'
            '<span class="place">Rome <i class="ad">buy</i> now</span></li><li class="job"><h3>Two</h3></li></ul><div class="posting"><h5>Lever</h5></div>')
    pages = spark.createDataFrame([(1, html, "lever"), (2, None, None), (3, "", "lever"), (4, "<li class=job><li class=job><h3>in", "other")], "page_id int, html string, kind string")
    table = sl.compile_selectors(spark, [("card", "ul.jobs > li.job, li.job"), ("title", "h3"), ("place", ".place"), ("link", "a[href]"),
                                         ("card", ".posting", "lever"), ("title", "h5", "lever"), ("noise", "nav, .ad", None, True)])
    assert set(table.columns) >= {"name", "step", "tag", "classes", "joined"}
    rows = sl.explode_dom(pages, table, layout_col="kind").orderBy("page_id", "name", "rank").collect()
    assert [(r.page_id, r.name, r.rank, r.tag, r.classes, r.href, r.text) for r in rows if r.page_id == 1] == [
        (1, "card", 0, "li", ["job"], None, "One a Rome now"), (1, "card", 1, "li", ["job"], None, "Two"), (1, "card", 2, "div", ["posting"], None, "Lever"),
        (1, "link", 0, "a", [], "/j/1", "One a"), (1, "place", 0, "span", ["place"], None, "Rome now"),
        (1, "title", 0, "h3", [], None, "One a"), (1, "title", 1, "h3", [], None, "Two"), (1, "title", 2, "h5", [], None, "Lever")]
    assert not [r for r in rows if r.page_id in (2, 3)]
    cards = sl.explode_cards(pages, table, "card", "title", "place", "link", layout_col="kind").orderBy("page_id", "rank").collect()
    assert [(r.page_id, r.title, r.place, r.link_href) for r in cards] == [
        (1, "One a", "Rome now", "/j/1"), (1, "Two", None, None), (1, "Lever", None, None), (4, "in", None, None), (4, "in", None, None)]
    assert sl.explode_dom(pages, sl.compile_selectors(spark, [("x", "a")]).limit(0)).count() == 0
    assert sl.explode_dom(pages.limit(0), table).count() == 0


def test_time_grows_with_elements_not_depth():
    rows = [dict(zip(["name", "layout", "gone", "alternative", "step", "joined", "tag", "id", "classes", "tests", "nth", "nots"], r)) | {"place": i}
            for i, r in enumerate(sl.selector_rows([("x", "div div > p ~ p"), ("y", ".a div:nth-child(2) .b")]))]
    for d in rows:
        d["nth"] = [dict(zip(("kind", "a", "b"), t)) for t in d["nth"]]
    html = "<div class=a>" * 4000 + "<p>x</p>" * 30_000 + "<div class=b><p>y"
    begin = time.perf_counter()
    _, found = sl._Rules(rows).found(html, None)
    assert found["x"].sum() == 29_999 and time.perf_counter() - begin < 20
