"""URL filter: a path-template tree per host, judged by labelled purity, under a list of rules.

Runs on DataFrame functions only.  A url's path becomes a list of segments in
which numbers and long hexadecimal names are already ``#``.  From the root of
each host's tree downward, a node with ``BRANCHES`` or more different children
has its rare ones (under ``RARE`` of the node's pages) generalised to ``*``.
Branches are then compared with their siblings: a branch whose share of bad
labels does not differ from the rest of its parent's by a two-proportion test
is merged with it, so a template belongs to the deepest branch above it that
does differ, or to its host.  A merged branch is rejected if its smoothed purity

    (good labels + WEIGHT * share of good labels overall) / (labels + WEIGHT)

is under ``PURITY``.  A url that a rule fits has the longest rule's verdict.

Pages are grouped into templates first, with partial sums before the shuffle, so
a host with a third of all pages is a few rows; only templates are joined among
themselves, and pages meet the rejected templates in a join that can be split.

Defined results: a url that is null or has no ``://`` has empty host and path,
which form a host of their own; null ids and repeated rows are judged like
others; without labels nothing is rejected beyond the rules; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, stored

#: (verdict, host and path); the path begins at the first slash.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BRANCHES, RARE = 8, 0.05
Z, WEIGHT, PURITY = 1.96, 5.0, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def shape_of(path: Column) -> Column:
    """The path's segments, numbers and long hexadecimal names as #, joined by single slashes."""
    named = F.regexp_replace(path, "(?<=/)[0-9a-fA-F-]{16,}(?=/|$)", "#")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(named, "[0-9]+", "#"), "/+", "/"), "^/|/$", "")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked first
        top, _, rest = text.partition("/")
        fits = ((host == top) | host.endswith("." + top)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def templates(urls: DataFrame, examples: DataFrame, branches: int = BRANCHES, rare: float = RARE) -> DataFrame:
    """(host, shape, template, labels, bad): every shape of a path with its place in the generalised tree."""
    def shaped(df, n, labels, bad):
        return df.select(host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"),
                         n.alias("n"), labels.alias("labels"), bad.alias("bad"))

    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    seen = shaped(urls, one, zero, zero).union(shaped(examples.where("bad IS NOT NULL"), zero, one, F.col("bad").cast("long")))
    tree = stored(seen.groupBy("host", "shape").agg(*(F.sum(c).alias(c) for c in ("n", "labels", "bad")))
                  .withColumn("segments", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/")))
                  .withColumn("done", F.array().cast("array<string>")), "shapes")
    for d in range(tree.agg(F.max(F.size("segments"))).first()[0] or 0):
        here = tree.withColumn("prefix", F.array_join("done", "/")).withColumn("segment", F.get("segments", F.lit(d)))
        kids = here.where("segment IS NOT NULL").groupBy("host", "prefix", "segment").agg(F.sum("n").alias("k"))
        nodes = kids.groupBy("host", "prefix").agg(F.count("*").alias("ways"), F.sum("k").alias("total"))
        variable = (kids.join(nodes, ["host", "prefix"]).where((F.col("ways") >= branches) & (F.col("k") < rare * F.col("total")))
                    .select("host", "prefix", "segment", F.lit("*").alias("star")))
        tree = stored(here.join(variable, ["host", "prefix", "segment"], "left").withColumn(
            "done", F.when(F.col("segment").isNull(), F.col("done")).otherwise(
                F.concat("done", F.array(F.coalesce("star", "segment"))))).select(*tree.columns), "tree")
    return tree.select("host", "shape", F.array_join("done", "/").alias("template"), "done", "labels", "bad")


def rejected(tree: DataFrame, z: float = Z, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """(host, shape) of the shapes whose merged branch is not pure enough."""
    whole = tree.agg(F.sum("labels").alias("l"), F.sum("bad").alias("b")).first()
    if not whole["l"]:
        return tree.select("host", "shape").limit(0)
    good = 1 - whole["b"] / whole["l"]
    leaves = tree.groupBy("host", "template", "done").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    above = leaves.select("host", "template", "labels", "bad", "done", F.explode(F.sequence(F.lit(0), F.size("done"))).alias("depth")).select(
        "host", "template", "labels", "bad", "depth", F.array_join(F.expr("slice(done, 1, depth)"), "/").alias("prefix"),
        F.when(F.col("depth") > 0, F.array_join(F.expr("slice(done, 1, greatest(depth - 1, 0))"), "/")).alias("parent"))
    nodes = stored(above.groupBy("host", "prefix", "depth", "parent").agg(F.sum("labels").alias("l"), F.sum("bad").alias("b")), "nodes")
    upper = nodes.select("host", F.col("prefix").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("l").alias("pl"), F.col("b").alias("pb"))
    own, rest = F.col("b") / F.col("l"), (F.col("pb") - F.col("b")) / (F.col("pl") - F.col("l"))
    pooled = F.col("pb") / F.col("pl")
    spread = pooled * (1 - pooled) * (1 / F.col("l") + 1 / (F.col("pl") - F.col("l")))
    apart = (nodes.join(upper, ["host", "parent", "depth"])
             .where((F.col("l") > 0) & (F.col("pl") > F.col("l")) & (F.col("pb") > 0) & (F.col("pb") < F.col("pl")))
             .where((own - rest) * (own - rest) > z * z * spread).select("host", "prefix", "depth"))
    branch = (above.select("host", "template", "prefix", "depth").join(apart, ["host", "prefix", "depth"])
              .groupBy("host", "template").agg(F.max_by("prefix", "depth").alias("branch"), F.max("depth").alias("level")))
    placed = stored(leaves.select("host", "template", "labels", "bad").join(branch, ["host", "template"], "left").withColumns(
        {"branch": F.coalesce("branch", F.lit("")), "level": F.coalesce("level", F.lit(0))}), "branches")
    impure = placed.groupBy("host", "branch", "level").agg(F.sum("labels").alias("l"), F.sum("bad").alias("b")).where(
        (F.col("l") - F.col("b") + weight * good) / (F.col("l") + weight) < purity).select("host", "branch", "level")
    named = placed.join(impure, ["host", "branch", "level"], "left_semi").select("host", "template")
    return tree.select("host", "shape", "template").join(named, ["host", "template"], "left_semi").select("host", "shape")


def judge(pages: DataFrame, examples: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
          branches: int = BRANCHES, rare: float = RARE, z: float = Z, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """Per row: page_id, host, path, rule, template shape and verdict.

    ``examples`` are labelled urls: (url, bad), bad true for pages that were found unwanted.
    """
    urls = only(pages, id_col, url_col).toDF("page_id", "url")
    bad = stored(rejected(templates(urls, examples, branches, rare), z, weight, purity).withColumn("impure", F.lit(True)), "rejected")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = urls.select("page_id", host.alias("host"), path.alias("path"), shape_of(path).alias("shape"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(bad, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), "shape",
        F.coalesce(verdict, F.when(F.col("impure"), "block").otherwise("allow")).alias("verdict"))


def examples_of(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """Labelled urls where the last number of a page's path names a labelled document: bad if it is poor or toxic."""
    marks = only(labels, "doc_id", "quality", "toxic").dropna(subset=["doc_id"]).groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("bad"))
    number = F.expr(r"try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)")
    urls = only(pages, url_col).toDF("url").withColumn("path", path_of(F.col("url"))).select("url", number.alias("doc_id"))
    return urls.join(marks, "doc_id").select("url", "bad")
