"""Page structure (U1) and what is read from it.

One Arrow UDF turns a page into the list of its interesting elements; a card or
block carries the first title, place, … and link inside it, found by position
while the tree is at hand.  Strategies are then single passes over that list, so
a page is parsed once, never shuffled, and costs time in proportion to its size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import text as tx
from ..functions.core import nz, once
from ..rules import misc, providers as pr
from .extract import jsonld_column, payload_jobs_column, script_jobs_column

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {"div", "article", "section", "li"}

_TEXT = T.StringType()
ELEMENTS = T.ArrayType(T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("tag", _TEXT),
    T.StructField("cardset", T.IntegerType()), T.StructField("kinds", T.ArrayType(_TEXT)),
    T.StructField("signature", _TEXT), T.StructField("group", T.IntegerType()), T.StructField("repeats", T.IntegerType()),
    T.StructField("href", _TEXT), T.StructField("text", _TEXT),
    *[T.StructField(f"first_{k}", _TEXT) for k in ("title", "location", "department", "type", "href", "link")]]))


class _Tree(HTMLParser):
    """Elements in document order with the span of their text."""

    def __init__(self, skip_tags, skip_classes):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open, self.texts, self.size = [], [], [], 0
        self.skip_tags, self.skip_classes = skip_tags, skip_classes
        self.muted = 0

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        classes = attrs.get("class", "").split()
        parent = self.open[-1] if self.open else None
        mute = tag in self.skip_tags or any(c in self.skip_classes for c in classes)
        node = {"n": len(self.nodes), "last": len(self.nodes), "tag": tag, "attrs": attrs, "classes": classes,
                "from": self.size, "to": self.size, "up": parent, "kids": [], "mute": mute, "off": bool(self.muted) or mute}
        if parent is not None:
            parent["kids"].append(tag)
        self.nodes.append(node)
        if tag in _VOID:
            return
        self.open.append(node)
        self.muted += mute

    def handle_endtag(self, tag):
        if not any(n["tag"] == tag for n in self.open):
            return
        while self.open:
            node = self.open.pop()
            self._close(node)
            if node["tag"] == tag:
                return

    def _close(self, node):
        node["to"], node["last"] = self.size, len(self.nodes) - 1
        self.muted -= node["mute"]

    def handle_data(self, data):
        if not self.muted and data.strip():
            self.texts.append(data)
            self.size += 1

    def finish(self):
        self.close()
        while self.open:
            self._close(self.open.pop())
        return self


def _parse(html, skip_tags, skip_classes):
    tree = _Tree(skip_tags, skip_classes)
    tree.feed(html or "")
    return tree.finish()


def _is(node, selector):
    head, _, inner = selector.partition(" ")
    if inner:
        up = node["up"]
        while up is not None and not _is(up, head):
            up = up["up"]
        return up is not None and _is(node, inner)
    mark, name = selector[0], selector[1:]
    if mark == ".":
        return name in node["classes"]
    if mark == "~":
        return name in " ".join(node["classes"])
    if mark == "@":
        return name in node["attrs"]
    return node["tag"] == selector


def _elements(html, layout):
    spec = pr.LAYOUTS.get(layout) or pr.LAYOUTS["generic"]
    tree = _parse(html, set(pr.EXCLUDED_BLOCKS) | {"script", "style"}, set(pr.EXCLUDED_CLASSES))
    out = []
    for node in tree.nodes:
        if node["off"]:
            continue
        cardset = next((i for i, group in enumerate(spec["cards"]) if any(_is(node, s) for s in group)), None)
        kinds = [k for k in ("title", "location", "department", "type") if any(_is(node, s) for s in spec.get(k, []))]
        signature = None
        if node["tag"] in _BLOCKS:
            signature = " ".join(sorted(node["classes"])) + "|" + ",".join(node["kids"])
        href = node["attrs"].get("href") if node["tag"] == "a" else None
        if cardset is None and not kinds and signature is None and href is None:
            continue
        # only small parts carry their text; a card's text is that of its parts
        text = " ".join(" ".join(tree.texts[node["from"]:node["to"]]).split()) if kinds or href is not None else None
        out.append({"node": node["n"], "last": node["last"], "tag": node["tag"], "cardset": cardset, "kinds": kinds,
                    "signature": signature, "href": href, "text": text})
    return _with_parts(out)


def _with_parts(elements):
    """Give each card and block its first part of every kind, and each block its group: blocks of one signature."""
    spots = {k: [e for e in elements if k in e["kinds"]] for k in ("title", "location", "department", "type")}
    spots["href"] = [e for e in elements if e["href"] is not None]
    places = {k: [e["node"] for e in v] for k, v in spots.items()}
    repeats = Counter(e["signature"] for e in elements if e["signature"] is not None)
    groups = {s: i for i, s in enumerate(repeats)}
    for e in elements:
        if e["signature"] is not None:
            e["group"], e["repeats"] = groups[e["signature"]], repeats[e["signature"]]
        if e["signature"] is None and e["cardset"] is None:
            continue
        for k, at in places.items():
            i = bisect_right(at, e["node"])
            if i < len(at) and at[i] <= e["last"]:
                part = spots[k][i]
                e[f"first_{k}"] = part["href"] if k == "href" else part["text"]
                if k == "href":
                    e["first_link"] = part["text"]
    return elements


@F.pandas_udf(ELEMENTS)
def elements_udf(html: pd.Series, layout: pd.Series) -> pd.Series:
    return pd.Series([_elements(h, l) for h, l in zip(html, layout)])


@F.pandas_udf(_TEXT)
def text_lines_udf(html: pd.Series) -> pd.Series:
    def lines(h):
        tree = _parse(h, set(pr.NOISE_TAGS) | {"nav", "header", "footer"}, set(pr.NOISE_CLASSES))
        return "\n".join(" ".join(t.split()) for t in tree.texts)
    return pd.Series([lines(h) for h in html])


@F.pandas_udf(_TEXT)
def main_text_udf(html: pd.Series) -> pd.Series:
    def main(h):
        tree = _parse(h, set(pr.NOISE_TAGS), set())
        for wanted in [*pr.MAIN_TAGS, ".main-content", ".content", ".job-description", ".job-content",
                       ".posting-content", "body"]:
            node = next((n for n in tree.nodes if _is(n, wanted) and not n["off"]), None)
            if node is not None:
                return "\n".join(" ".join(t.split()) for t in tree.texts[node["from"]:node["to"]])
        return "\n".join(" ".join(t.split()) for t in tree.texts)
    return pd.Series([main(h) for h in html])


def with_elements(pages: DataFrame, layout: Column | str = "generic") -> DataFrame:
    """Pages with an ``elements`` list."""
    layout = F.lit(layout) if isinstance(layout, str) else layout
    return pages.withColumn("elements", elements_udf("html", layout))


def layout_elements(pages: DataFrame, layout: Column | str = "generic") -> DataFrame:
    """One row per interesting element of a fixed layout; ``selectors.explode_dom`` takes a selector table."""
    return with_elements(pages, layout).select("page_id", F.explode("elements").alias("e")).select("page_id", "e.*")


def _job(title, url, location, department, kind) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(title.alias("title"), url.alias("url"), location.alias("location"), department.alias("department"),
                    kind.alias("type"), none.alias("posted"), none.alias("description"), none.alias("salary"),
                    F.lit(None).cast("boolean").alias("remote"))


def _card_job(card: Column, url: Column, link_title: Column) -> Column:
    """The job a card element describes: first part of each kind inside it."""
    title = F.coalesce(card["first_title"], F.when(link_title, card["first_link"]))
    href = F.coalesce(nz(card["href"]), nz(card["first_href"]))
    return _job(tx.clean_text(title), F.coalesce(tx.resolve_url(url, href), url), tx.clean_text(card["first_location"]),
                tx.clean_text(card["first_department"]), tx.clean_text(card["first_type"]))


def _first_group(elements: Column, group: str, url: Column, link_title: Column, min_title: Column) -> Column:
    """Jobs with a long enough title of the first group that has any."""
    both = F.transform(elements, lambda e: F.struct(e[group].alias("g"), _card_job(e, url, link_title).alias("j")))
    good = F.filter(both, lambda x: F.length(x["j"]["title"]) >= min_title)
    return once(good, lambda found: once(F.array_min(F.transform(found, lambda x: x["g"])), lambda first: F.transform(
        F.filter(found, lambda x: x["g"] == first), lambda x: x["j"])))


def card_jobs_column(elements: Column, url: Column, min_title: Column, link_title: Column) -> Column:
    """Jobs of the first card group that gives any."""
    return _first_group(F.filter(elements, lambda e: e["cardset"].isNotNull()), "cardset", url, link_title, min_title)


def link_jobs_column(elements: Column, url: Column) -> Column:
    """Jobs of links whose address looks like a posting and whose text is no navigation."""
    none = F.lit(None).cast("string")
    pattern = "(?i)(?:" + "|".join(misc.GENERIC_JOB_HREF) + ")"
    links = F.filter(elements, lambda e: (e["href"] != "") & ~e["href"].startswith("#") & e["href"].rlike(pattern))
    jobs = F.transform(links, lambda e: _job(tx.clean_text(e["text"]), tx.resolve_url(url, e["href"]), none, none, none))
    # the first link of an address decides: sorted by address and place, then back by place
    placed = F.sort_array(F.transform(jobs, lambda j, i: F.struct(j["url"].alias("url"), i.alias("i"), j.alias("j"))))
    firsts = once(placed, lambda all_: F.filter(all_, lambda x, n: (n == 0) | ~F.get(all_, n - 1)["url"].eqNullSafe(x["url"])))
    back = F.sort_array(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"))))
    return F.filter(F.transform(back, lambda x: x["j"]), lambda j: tx.is_job_title(j["title"]))


def block_jobs_column(elements: Column, url: Column) -> Column:
    """Jobs of the first repeated block structure (three or more) that gives any."""
    return _first_group(F.filter(elements, lambda e: e["repeats"] >= 3), "group", url, F.lit(True), F.lit(5))


def _first_filled(*named: tuple[str, Column]) -> Column:
    """Struct of the first strategy with at least one job; later ones are not computed."""
    def filled(name: str):
        return lambda jobs: F.when(F.size(jobs) > 0, F.struct(F.lit(name).alias("strategy"), jobs.alias("jobs")))
    return F.coalesce(*[once(jobs, filled(name)) for name, jobs in named])


def _rows(df: DataFrame, picked: Column) -> DataFrame:
    return (df.withColumn("__p", picked).filter(F.col("__p").isNotNull())
            .select("page_id", F.col("__p.strategy").alias("strategy"), F.posexplode("__p.jobs").alias("position", "job"))
            .select("page_id", "strategy", "position", "job.*"))


def extract_generic(pages: DataFrame) -> DataFrame:
    """JSON-LD, else cards, else job links, else repeated blocks; one strategy per page."""
    p = with_elements(pages, "generic")
    e, url = F.col("elements"), F.col("url")
    return _rows(p, _first_filled(("jsonld", jsonld_column(F.col("html"), url)),
                                  ("cards", card_jobs_column(e, url, F.lit(5), F.lit(True))),
                                  ("links", link_jobs_column(e, url)), ("blocks", block_jobs_column(e, url))))


def _layout_flags(kind: Column) -> tuple[Column, Column]:
    by = lambda key, default: F.coalesce(*[F.when(kind == k, F.lit(s.get(key, default))) for k, s in pr.LAYOUTS.items()], F.lit(default))
    return by("min_title", 1), by("link_title", True)


def extract_board_html(pages: DataFrame) -> DataFrame:
    """Cards of a platform's own layout, else JSON-LD, else posting links."""
    p = with_elements(pages, F.col("ats_type"))
    low, link_title = _layout_flags(F.col("ats_type"))
    e, url = F.col("elements"), F.col("url")
    return _rows(p, _first_filled(("cards", card_jobs_column(e, url, low, link_title)),
                                  ("jsonld", jsonld_column(F.col("html"), url)), ("links", link_jobs_column(e, url))))


def extract_jobs(snapshots: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per snapshot the platform's reader, else the generic one; and snapshots without a job.

    ``snapshots(page_id, company_id, url, html)``: JSON bodies go through the
    field map, pages through scripts, layout and generic strategies.
    """
    c = companies.select(F.col("id").alias("company_id"), "ats_type", "ats_identifier")
    s = snapshots.join(c, "company_id", "left")
    s = with_elements(s, F.coalesce("ats_type", F.lit("generic")))
    low, link_title = _layout_flags(F.coalesce("ats_type", F.lit("generic")))
    html, url, e = F.col("html"), F.col("url"), F.col("elements")
    picked = _first_filled(
        ("payload", payload_jobs_column("html", "ats_type", "ats_identifier")), ("scripts", script_jobs_column("html", "ats_type")),
        ("cards", card_jobs_column(e, url, low, link_title)), ("jsonld", jsonld_column(html, url)),
        ("links", link_jobs_column(e, url)), ("blocks", block_jobs_column(e, url)))
    s = s.withColumn("__p", picked)
    jobs = (s.filter(F.col("__p").isNotNull())
            .select("page_id", "company_id", F.col("__p.strategy").alias("strategy"), F.posexplode("__p.jobs").alias("position", "job"))
            .select("page_id", "company_id", "strategy", "position", "job.*"))
    return jobs, s.filter(F.col("__p").isNull()).select("page_id", "company_id")


def simplify_html(html: Column | str, limit: int | None = None) -> Column:
    """Text lines of a page without scripts, chrome and noise.

    ``limit`` cuts with a marker, as a prompt would need it; by default the
    text stays whole.
    """
    text = text_lines_udf(html)
    if limit is None:
        return text
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(pr.SIMPLE_TAIL))).otherwise(text)


def main_content(html: Column | str) -> Column:
    """Text of the main content area, else of the body."""
    return main_text_udf(html)
