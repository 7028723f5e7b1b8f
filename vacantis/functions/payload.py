"""Reading values out of JSON documents of unknown shape."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..rules.providers import JSONLD_LINKS
from .core import nz, once


def jpath(path: str) -> str:
    """``a.b[0].c`` as a variant path; names with signs are quoted."""
    if path == "$":
        return path
    out = "$"
    for part in path.split("."):
        name, index = re.fullmatch(r"(.*?)((?:\[\d+\])*)", part).groups()
        out += (f".{name}" if re.fullmatch(r"\w+", name) else f'["{name}"]') + index
    return out


def jtext(v: Column, path: str) -> Column:
    """Scalar at ``path`` as text; objects, lists and empty text give null."""
    p = jpath(path)
    nested = (F.try_variant_get(v, p, "map<string,variant>").isNotNull()
              | F.try_variant_get(v, p, "array<variant>").isNotNull())
    return once(F.try_variant_get(v, p, "string"),
                lambda t: F.when((t != "") & (~t.rlike(r"^\s*[\{\[]") | ~nested), t))


def jget(v: Column, *paths: str) -> Column:
    """First non-empty scalar over alternative paths."""
    return F.coalesce(*[jtext(v, p) for p in paths])


def jlist(v: Column, path: str) -> Column:
    return F.try_variant_get(v, jpath(path), "array<variant>")


def jarray(v: Column, *paths: str) -> Column:
    """C4: first non-empty list over alternative paths; ``$`` is a root list."""
    return F.coalesce(*[once(jlist(v, p), lambda a: F.when(F.size(a) > 0, a)) for p in paths])


def _members(v: Column) -> Column:
    """Members of a list, or the object itself as one member."""
    none = F.array().cast("array<variant>")
    own = F.when(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.array(v))
    return F.coalesce(jlist(v, "$"), own, none)


# Every way down a document leads through one of these links or a list inside a list.
_STEP = "|".join(f'"{k}"' for k in JSONLD_LINKS) + r"|\[\s*(?=\[)"


def jsonld_postings(body: Column) -> Column:
    """Every ``JobPosting`` object of a JSON-LD document reachable through lists, ``@graph``,
    ``itemListElement`` and ``mainEntity``, at any depth.

    The document is walked a level at a time.  It cannot have more levels than
    links, which are counted in its text, so nothing is cut off.
    """
    none = F.array().cast("array<variant>")

    def below(x: Column) -> Column:
        # members of a list inside the level, and what the links of an object lead to
        return F.concat(F.coalesce(jlist(x, "$"), none),
                        *[F.coalesce(_members(F.try_variant_get(x, jpath(k), "variant")), none) for k in JSONLD_LINKS])

    def step(acc: Column, _: Column) -> Column:
        return once(F.flatten(F.transform(acc["level"], below)), lambda deeper: F.when(F.size(acc["level"]) == 0, acc).otherwise(
            F.struct(deeper.alias("level"), F.concat(acc["found"], F.filter(deeper, is_posting)).alias("found"))))

    def is_posting(x: Column) -> Column:
        return F.coalesce(jtext(x, "@type") == "JobPosting", F.lit(False))

    def walk(v: Column) -> Column:
        levels = F.regexp_count(body, F.lit(_STEP)) + 1
        return once(_members(v), lambda top: F.aggregate(
            F.sequence(F.lit(1), levels), F.struct(top.alias("level"), F.filter(top, is_posting).alias("found")), step)["found"])

    return F.coalesce(once(F.try_parse_json(body), walk), none)
