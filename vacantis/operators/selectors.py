"""Page extraction by a table of selectors.

A selector is text in the usual notation: steps such as ``ul.list > li[data-id]``
with a tag or ``*``, ``.class``, ``#id``, ``[name]``, ``[name=value]`` (also ``~=``,
``^=``, ``$=``, ``*=``), ``:nth-child(an+b)``, ``:nth-last-child``, ``:nth-of-type``,
``:first-child``, ``:last-child`` and ``:not(...)`` of one plain test, joined by
descendant (blank), child ``>``, next sibling ``+`` or later sibling ``~``;
alternatives stand apart by commas.  :func:`compile_selectors` turns a table of
them into rows, one per step.

An element of a page has its number in document order and the number of its last
descendant, so "inside" is interval containment.  A step is then one pass over
the page's elements whatever their depth: a running maximum of the ends of the
elements that the step before found tells which elements lie inside one of them.
Time grows with elements times steps; pages are parsed once and never shuffled.

Defined results: a null or empty page has no elements; unclosed elements end with
the page, stray closing tags are passed over; tags and attribute names are matched
in lower case; names are case-sensitive in classes, ids and values; ranks count
the elements of one name in a page from 0 in document order; an element that two
alternatives of one name find is one row; an empty selector table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from .dom import _parse

#: Selector tables are configuration: they go to every task, so their size is checked.
MOST_STEPS = 100_000

STEPS = ("name string, layout string, gone boolean, alternative int, step int, joined string, tag string, id string, classes array<string>, "
         "tests array<struct<name:string,op:string,value:string>>, nth array<struct<kind:string,a:int,b:int>>, nots array<int>")

_NAME = r"[\w\-\u0080-\U0010ffff]+"
_TOKEN = re.compile(rf"""
    (?P<joined>\s*[>+~]\s*|\s+) | (?P<tag>\*|{_NAME}) | \.(?P<cls>{_NAME}) | \#(?P<id>{_NAME})
  | \[\s*(?P<attr>{_NAME})\s*(?:(?P<op>[~^$*]?=)\s*(?:"(?P<q>[^"]*)"|'(?P<s>[^']*)'|(?P<v>[^\]\s]*))\s*)?\]
  | :not\(\s*(?P<not>[^()]*(?:\([^()]*\))?[^()]*)\) | :(?P<pseudo>[\w-]+)(?:\(\s*(?P<arg>[^)]*?)\s*\))?""", re.X)
_NTH = re.compile(r"^(?:([+-]?\d*)n)?\s*([+-]?\s*\d+)?$")
_KINDS = {"nth-child": "child", "nth-last-child": "last-child", "nth-of-type": "type", "nth-last-of-type": "last-type"}
_SHORT = {"first-child": ("child", 0, 1), "last-child": ("last-child", 0, 1), "first-of-type": ("type", 0, 1), "last-of-type": ("last-type", 0, 1)}


def _nth(pseudo: str, arg: str | None) -> tuple[str, int, int]:
    if pseudo in _SHORT and arg is None:
        return _SHORT[pseudo]
    if pseudo not in _KINDS or arg is None:
        raise ValueError(f"unknown test :{pseudo}")
    arg = {"odd": "2n+1", "even": "2n"}.get(arg.lower(), arg.lower().replace(" ", ""))
    m = _NTH.match(arg)
    if not arg or not m:
        raise ValueError(f"no position: {arg!r}")
    a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
    return _KINDS[pseudo], a, int(m[2] or 0)


def _blank(joined: str) -> dict:
    return {"joined": joined, "tag": None, "id": None, "classes": [], "tests": [], "nth": [], "nots": []}


def _steps(selector: str) -> list[dict]:
    """The steps of one selector without commas; ``nots`` holds tests that must fail."""
    text, at, out = selector.strip(), 0, [_blank("")]
    fresh = True
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read selector {selector!r} at {text[at:]!r}")
        at, step = m.end(), out[-1]
        if m["joined"] is not None:
            if fresh:
                raise ValueError(f"a step is missing in {selector!r}")
            out.append(_blank(m["joined"].strip() or " "))
            fresh = True
            continue
        if m["tag"]:
            if not fresh:
                raise ValueError(f"cannot read selector {selector!r} at {m['tag']!r}")
            step["tag"] = None if m["tag"] == "*" else m["tag"].lower()
        elif m["cls"]:
            step["classes"].append(m["cls"])
        elif m["id"]:
            step["id"] = m["id"]
        elif m["attr"]:
            value = next((m[k] for k in "qsv" if m[k] is not None), None)
            step["tests"].append((m["attr"].lower(), m["op"] or "", value or ""))
        elif m["not"] is not None:
            inner = _steps(m["not"])
            if len(inner) != 1 or inner[0]["nots"]:
                raise ValueError(f":not takes one plain test: {m['not']!r}")
            step["nots"].append(inner[0])
        else:
            step["nth"].append(_nth(m["pseudo"], m["arg"]))
        fresh = False
    if fresh:
        raise ValueError(f"a step is missing in {selector!r}")
    return out


def _alternatives(selector: str) -> list[str]:
    """Parts between commas that stand in no bracket or quote."""
    out, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(selector[begin:i])
            begin = i + 1
    return [*out, selector[begin:]]


def selector_rows(rules: Iterable[tuple]) -> list[tuple]:
    """Step rows of rules (name, selector[, layout[, gone]]).

    A rule with a layout holds for pages of that layout only; elements that a
    ``gone`` rule finds are taken out with all they hold before others are looked for.
    A test in ``:not`` is a row with step -1; ``nots`` are the places of those rows.
    """
    out = []
    counts: dict[tuple, int] = {}
    for name, selector, layout, gone in ((*r, None, False)[:4] if len(r) == 2 else (*r, False)[:4] for r in rules):
        for part in _alternatives(selector):
            n = counts[name, layout] = counts.get((name, layout), -1) + 1
            for k, s in enumerate(_steps(part)):
                nots = []
                for inner in s["nots"]:
                    nots.append(len(out))
                    out.append((name, layout, bool(gone), n, -1, "", inner["tag"], inner["id"], inner["classes"], inner["tests"], inner["nth"], []))
                out.append((name, layout, bool(gone), n, k, s["joined"], s["tag"], s["id"], s["classes"], s["tests"], s["nth"], nots))
    return out


def compile_selectors(spark: SparkSession, rules: Iterable[tuple]) -> DataFrame:
    """The steps of a selector table as rows, see :func:`selector_rows`."""
    rows = selector_rows(rules)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, " + STEPS)


class _Page:
    """A page's elements as columns; only what the selectors ask for is looked up."""

    def __init__(self, html: str | None, classes: set, ids: set, attrs: set):
        tree = _parse(html, {"script", "style"}, set())
        self.nodes, self.texts = tree.nodes, tree.texts
        n = self.n = len(tree.nodes)
        self.last = np.fromiter((e["last"] for e in tree.nodes), np.int64, n)
        self.parent = np.fromiter((-1 if e["up"] is None else e["up"]["n"] for e in tree.nodes), np.int64, n)
        self.tags = np.array([e["tag"] for e in tree.nodes], object)
        self.alive = np.ones(n, bool)
        self.with_class, self.with_id, self.with_attr = {}, {}, {}
        for i, e in enumerate(tree.nodes):
            for c in e["classes"]:
                if c in classes:
                    self.with_class.setdefault(c, []).append(i)
            if e["attrs"]:
                if (x := e["attrs"].get("id")) in ids:
                    self.with_id.setdefault(x, []).append(i)
                for a in attrs & e["attrs"].keys():
                    self.with_attr.setdefault(a, []).append((i, e["attrs"][a]))
        self.by_parent: dict[bool, tuple] = {}

    def take_out(self, found: np.ndarray) -> None:
        self.alive &= ~(found | self.inside(found))
        self.by_parent = {}

    def inside(self, found: np.ndarray) -> np.ndarray:
        """Elements that lie in one of those found: its interval begins before and ends at or behind theirs."""
        ends = np.maximum.accumulate(np.where(found, self.last, -1)) if self.n else self.last
        return np.concatenate([[-1], ends[:-1]]) >= np.arange(self.n) if self.n else found

    def _siblings(self, same_tag: bool):
        """Living elements ordered by parent (and tag), the first of each group, and each one's place and its group's size."""
        if same_tag not in self.by_parent:
            live = np.flatnonzero(self.alive)
            keys = [self.parent[live]]
            if same_tag:
                keys.append(np.unique(self.tags[live].astype(str), return_inverse=True)[1].reshape(-1))
            order = np.lexsort((live, *reversed(keys)))
            sorted_keys = np.stack([k[order] for k in keys])
            new = np.ones(len(live), bool)
            new[1:] = (sorted_keys[:, 1:] != sorted_keys[:, :-1]).any(axis=0)
            start = np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)) if len(live) else np.zeros(0, np.int64)
            size = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] if len(live) else start
            self.by_parent[same_tag] = live[order], start, np.arange(len(live)) - start + 1, size
        return self.by_parent[same_tag]

    def test(self, s, all_steps) -> np.ndarray:
        """Living elements that pass the test of one step by itself."""
        ok = self.alive.copy()

        def only(places):
            keep = np.zeros(self.n, bool)
            keep[places] = True
            np.logical_and(ok, keep, out=ok)

        if s["tag"] is not None:
            ok &= self.tags == s["tag"]
        if s["id"] is not None:
            only(self.with_id.get(s["id"], []))
        for c in s["classes"]:
            only(self.with_class.get(c, []))
        for name, op, value in s["tests"]:
            only([i for i, x in self.with_attr.get(name, []) if _passes(x, op, value)])
        for kind, a, b in s["nth"]:
            who, _, place, size = self._siblings("type" in kind)
            at = size - place + 1 if kind.startswith("last") else place
            good = at == b if a == 0 else ((at - b) % a == 0) & ((at - b) // a >= 0)
            only(who[good])
        for k in s["nots"]:
            ok &= ~self.test(all_steps[k], all_steps)
        return ok

    def follow(self, found: np.ndarray, joined: str) -> np.ndarray:
        """Where the next step may be, after the elements found by the one before."""
        if joined == " ":
            return self.inside(found)
        if joined == ">":
            return np.where(self.parent >= 0, found[self.parent], False) if self.n else found
        who, start, _, _ = self._siblings(False)
        hit, out = found[who], np.zeros(self.n, bool)
        if joined == "+":
            out[who[1:]] = hit[:-1] & (start[1:] == start[:-1])
        else:
            before = np.concatenate([[0], np.cumsum(hit)])
            out[who] = before[np.arange(len(who))] > before[start]
        return out

    def text(self, i: int) -> str:
        """The text of an element without what was taken out."""
        e = self.nodes[i]
        parts, at = [], e["from"]
        for j in self.cuts[bisect_right(self.cuts, i):bisect_right(self.cuts, e["last"])]:
            parts += self.texts[at:self.nodes[j]["from"]]
            at = self.nodes[j]["to"]
        return " ".join(" ".join([*parts, *self.texts[at:e["to"]]]).split())

    def seal(self) -> None:
        """After all is taken out: the outermost elements that are gone."""
        gone = ~self.alive
        self.cuts = np.flatnonzero(gone & ~self.inside(gone)).tolist()


def _passes(x: str, op: str, value: str) -> bool:
    if op == "":
        return True
    if op == "=":
        return x == value
    if op == "~=":
        return value in x.split()
    if not value:
        return False
    return {"^=": x.startswith, "$=": x.endswith, "*=": x.__contains__}[op](value)


class _Rules:
    """Step rows as they are looked up in a task."""

    def __init__(self, rows: list[dict]):
        self.steps = {r["place"]: r | {"tests": [(t["name"], t["op"], t["value"]) for t in r["tests"]],
                                       "nth": [(t["kind"], t["a"], t["b"]) for t in r["nth"]]} for r in rows}
        self.chains: dict[tuple, list] = {}
        for place in sorted(self.steps):
            s = self.steps[place]
            if s["step"] >= 0:
                self.chains.setdefault((s["gone"], s["layout"], s["name"], s["alternative"]), []).append(s)
        every = self.steps.values()
        self.classes = {c for s in every for c in s["classes"]}
        self.ids = {s["id"] for s in every if s["id"] is not None}
        self.attrs = {t[0] for s in every for t in s["tests"]}

    def found(self, html: str | None, layout: str | None) -> tuple[_Page, dict[str, np.ndarray]]:
        """The page and, per name, which of its elements its rules find."""
        page = _Page(html, self.classes, self.ids, self.attrs)
        out: dict[str, np.ndarray] = {}
        for gone in (True, False):
            for (g, wanted, name, _), chain in self.chains.items():
                if g != gone or wanted is not None and wanted != layout:
                    continue
                hit = page.test(chain[0], self.steps)
                for s in chain[1:]:
                    if not hit.any():
                        break
                    hit = page.follow(hit, s["joined"]) & page.test(s, self.steps)
                out[name, gone] = out[name, gone] | hit if (name, gone) in out else hit
            if gone:
                for hit in out.values():
                    page.take_out(hit)
                page.seal()
                out = {}
        return page, {name: hit for (name, _), hit in out.items()}


def _shared(pages: DataFrame, selectors: DataFrame):
    rows = [r.asDict(True) for r in selectors.limit(MOST_STEPS + 1).collect()]
    if len(rows) > MOST_STEPS:
        raise ValueError(f"a selector table has at most {MOST_STEPS} steps")
    return pages.sparkSession.sparkContext.broadcast(rows)


ELEMENTS = "array<struct<name:string,rank:int,node:int,last:int,tag:string,classes:array<string>,href:string,text:string>>"


def _elements(page: _Page, found: dict[str, np.ndarray]) -> list[dict]:
    return [{"name": name, "rank": rank, "node": i, "last": int(page.last[i]), "tag": page.nodes[i]["tag"], "classes": page.nodes[i]["classes"],
             "href": page.nodes[i]["attrs"].get("href"), "text": page.text(i)}
            for name in sorted(found) for rank, i in enumerate(np.flatnonzero(found[name]).tolist())]


def _cards(page: _Page, found: dict[str, np.ndarray], whole: str, parts: tuple[str, ...]) -> list[dict]:
    """Each whole with the first element of every part that begins inside it."""
    out, spots = [], {p: np.flatnonzero(found.get(p, np.zeros(0, bool))) for p in parts}
    for rank, i in enumerate(np.flatnonzero(found.get(whole, np.zeros(0, bool))).tolist()):
        card = {"rank": rank, "node": i, "href": page.nodes[i]["attrs"].get("href"), "text": page.text(i)}
        for p, at in spots.items():
            k = int(np.searchsorted(at, i, "right"))
            inside = k < len(at) and at[k] <= page.last[i]
            j = int(at[k]) if inside else None
            card |= {p: page.text(j) if inside else None, f"{p}_href": page.nodes[j]["attrs"].get("href") if inside else None}
        out.append(card)
    return out


def _read(pages: DataFrame, selectors: DataFrame, kind: str, rows_of, html_col: str, layout_col: str | None):
    """The column that ``rows_of`` makes of every page, by one pass over it."""
    shared, made = _shared(pages, selectors), T.DataType.fromDDL(kind)
    arrow = to_arrow_type(made)

    @F.arrow_udf(made)
    def read(html: pa.Array, layout: pa.Array) -> pa.Array:
        rules = _Rules(shared.value)
        return pa.array([rows_of(*rules.found(h.as_py(), x.as_py())) for h, x in zip(html, layout)], arrow)

    layout = F.lit(None).cast("string") if layout_col is None else F.col(f"`{layout_col}`").cast("string")
    return read(F.col(f"`{html_col}`").cast("string"), layout)


def explode_dom(pages: DataFrame, selectors: DataFrame, id_col: str = "page_id", html_col: str = "html", layout_col: str | None = None) -> DataFrame:
    """(page_id, name, rank, node, last, tag, classes, href, text) of the elements that the selectors find.

    ``selectors`` are the step rows of :func:`compile_selectors`; ``layout_col``
    tells which of the layout's own rules hold for a page besides the common ones.
    """
    found = _read(pages, selectors, ELEMENTS, _elements, html_col, layout_col)
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), F.explode(found).alias("e")).select("page_id", "e.*")


def explode_cards(pages: DataFrame, selectors: DataFrame, whole: str, *parts: str, id_col: str = "page_id", html_col: str = "html",
                  layout_col: str | None = None) -> DataFrame:
    """(page_id, rank, node, href, text, {part}, {part}_href, …) of the elements named ``whole``.

    A part is the first element of that name inside the whole, by interval containment.
    """
    fields = "".join(f",`{p}`:string,`{p}_href`:string" for p in parts)
    found = _read(pages, selectors, f"array<struct<rank:int,node:int,href:string,text:string{fields}>>",
                  lambda page, found: _cards(page, found, whole, parts), html_col, layout_col)
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), F.explode(found).alias("e")).select("page_id", "e.*")
