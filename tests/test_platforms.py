"""Platform lookup: literals come before the patterns, and no address changes by that."""

import re

from vacantis.functions import classify as cl
from vacantis.rules import boards


def plain(url):
    """The rule list as written: the first platform with a pattern that occurs, the first such pattern's group."""
    for label, patterns in boards.URL_PATTERNS.items():
        for p in patterns:
            m = re.search("(?i)" + p, url)
            if m:
                ident = m.group(1) if m.groups() else ""
                return label, ident if ident and ident.lower() not in boards.NOT_IDENTIFIERS else None
    return None, None


def addresses():
    for patterns in boards.URL_PATTERNS.values():
        for p in patterns:
            for name in ("acme", "Embed", "jobs"):
                u = p.replace("([^/]+)", name).replace("([^.]+)", name).replace("\\d+", "5").replace("\\d*", "").replace("\\.", ".")
                yield from (u, f"https://{u}/x?lever.co", u.upper())
    yield from ("", "https://example.org", "https://boards.greenhoİuse.io/x")


def test_every_pattern_finds_what_it_did(spark):
    urls = list(addresses())
    got = spark.createDataFrame(list(enumerate(urls)), "id long, u string").select("id", cl.ats_from_url("u").alias("a")).collect()
    assert {urls[r.id]: tuple(r.a) for r in got} == {u: plain(u) for u in urls}
    nothing = spark.createDataFrame([(None,)], "u string").select(cl.ats_from_url("u").alias("a")).first().a
    assert tuple(nothing) == (None, None)


def test_patterns_are_asked_once_and_behind_a_literal(spark):
    plan = spark.createDataFrame([("",)], "u string").select(cl.ats_from_url("u").alias("a"))._jdf.queryExecution().analyzed().toString()
    patterns = sum(map(len, boards.URL_PATTERNS.values()))
    assert plan.count("regexp_extract(") <= patterns and plan.upper().count("RLIKE") <= len(boards.URL_PATTERNS) + patterns
    assert plan.lower().count("contains(") >= patterns / 2
