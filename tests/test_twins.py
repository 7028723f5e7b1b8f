"""Column functions against small independent Python twins and hand-made examples."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vacantis.functions import classify as cl, dates as dt, scoring as sc, text as tx
from vacantis.functions.core import needle
from vacantis.rules import locations as loc, roles, skills as sk


def column(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def random_titles(n=400):
    rng = random.Random(7)
    words = ["Senior", "Sr.", "engineer", "Software  Engineer", "DIRECTOR", "of", "engineering", "cto", "HR", "people",
             "ios", "Developer", "ſre", "VP", "ii", "I", "lead", "é", "data\nengineer", "ux/ui", "co-op", "interns",
             "mid-level", "API", "c++", "react.js", "ruby on rails", "go-lang", "asp.net", "C#x", "node js", "K8s", "K8s",
             "fast api design", "us", "U.S.", "LA", "remote", "in office", "3 days in office", "UK,", "Paris", "spring boot"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(n)]


def first(rules, text, default=None):
    for label, patterns in rules.items():
        if any(re.search(p, text, re.I) for p in patterns):
            return label
    return default


def test_rule_lists_equal_plain_regular_expressions(spark):
    titles = random_titles()
    assert column(spark, titles, cl.role_family) == [first(roles.ROLE_FAMILIES, t, "other") for t in titles]
    assert column(spark, titles, cl.role_specialization) == [first(roles.SPECIALIZATIONS, t) for t in titles]
    assert column(spark, titles, lambda c: cl.seniority(c, F.lit(None).cast("string"))) == [
        first(roles.SENIORITY_TITLES, t, "mid") for t in titles]


def skills_twin(text):
    out = set()
    for name, aliases in sk.SKILL_ALIASES.items():
        if any(re.search(rf"\b{re.escape(a)}\b", text, re.I) for a in aliases):
            out.add(name)
    return sorted(out)


def test_one_pass_skills_equal_one_search_per_alias(spark):
    rng = random.Random(3)
    alias = [a for v in sk.SKILL_ALIASES.values() for a in v] + ["x", "é", "r", ".", "-"]
    texts = [rng.choice([" ", "", "/", ", "]).join(rng.choice(alias) for _ in range(rng.randint(1, 8))) for _ in range(600)] + random_titles()
    got = column(spark, texts, lambda c: cl.skills(F.lit(""), c))
    assert got == [skills_twin(" " + t) for t in texts]


def location_type_twin(text):
    text = (text or "").strip(" ")
    hit = lambda ps: any(re.search(p, text, re.I) for p in ps)
    if not text:
        return None
    if hit(loc.REMOTE):
        return "hybrid" if hit(loc.HYBRID) else "remote"
    if hit(loc.HYBRID):
        return "hybrid"
    if hit(loc.ONSITE):
        return "onsite"
    known = (any(k in text.lower() for k in loc.TECH_HUBS) or any(re.search(rf"\b{s}\b", text) for s in loc.US_STATES.values())
             or any(hit(p) for p in loc.COUNTRIES.values()) or re.search(loc.CITY_COMMA_STATE, text))
    return "onsite" if known else None


def test_location_type(spark):
    texts = random_titles() + ["Remote - US", "Remote or office, hybrid", "Austin, TX", "", None, "Nowhere", "Springfield, ZZ"]
    assert column(spark, texts, cl.location_type) == [location_type_twin(t) for t in texts]


def test_needles_are_in_every_match():
    assert needle(r"solutions?\s*engineer") == ("solution", False) or needle(r"solutions?\s*engineer")[0] == "engineer"
    assert needle(r"developer") == ("developer", True)
    assert needle(r"a|b") == ("", False)
    assert needle(r"hr\s*")[0] == "hr"
    assert needle(r"\bu\.s\.\b") == ("u.s.", False)


GOLDEN = [
    (cl.role_family, {"Senior Software Engineer": "software_engineering", "Platform Engineer": "software_engineering",
                      "Solutions Engineer": "sales", "Chef": "other", "Art Director": "engineering_management"}),
    (lambda c: cl.seniority(c, F.lit("5+ years of experience")), {"Sr. Staff Engineer": "staff", "Engineer II": "mid", "Engineer": "senior"}),
    (cl.location_type, {"Remote - US": "remote", "Remote or office, hybrid": "hybrid", "Austin, TX": "onsite", "": None}),
    (lambda c: F.array_join(cl.locations(c), ";"), {"NYC or SF": "San Francisco, CA;New York, NY", "Atlanta": "Los Angeles, CA", "": ""}),
    (lambda c: F.concat_ws(",", tx.parse_salary(c)["min_salary"], tx.parse_salary(c)["max_salary"]),
     {"$120k - $150k": "120000,150000", "£90,000": "90000,90000", "competitive": ""}),
    (cl.employment_type, {"Full-time": "full_time", "Contractor": "contract", "Internship": "internship", "": None}),
    (tx.normalize_url, {"HTTPS://X.com/Jobs/1/?a=b": "https://x.com/jobs/1/", "https://x.com/a//": "https://x.com/a"}),
    (lambda c: tx.derive_domain(c, F.lit("https://boards.greenhouse.io/acme")), {"https://www.Acme.com/x": "acme.com", None: None}),
    (tx.norm_company, {"Acme Technologies": "acme", "Foo, Inc.": "foo"}),
    (lambda c: F.concat_ws("/", cl.ats_from_url(c)["ats_type"], cl.ats_from_url(c)["ats_identifier"]),
     {"https://jobs.lever.co/acme/1": "lever/acme", "https://boards.greenhouse.io/embed": "greenhouse", "https://x.com": ""}),
    (lambda c: cl.is_us_location(c)["is_us"], {"London, UK": False, "Austin, TX": True, "Remote": False, "Milwaukee": False, None: False}),
    (lambda c: sc.seniority_compatible(F.lit("mid"), c), {"senior": True, "staff": False, "x": True}),
    (lambda c: sc.score_band(c.cast("double")), {"0.9": "Excellent match", "0.6": "Moderate match", "0.59": "Potential match"}),
    (tx.base_domain, {"a.b.co": "b.co", "localhost": "localhost"}),
    (lambda c: F.array_join(tx.company_slugs(c, F.lit("acme.com")), "|"), {"Acme Corp": "acme|acmecorp|acme-corp"}),
    (tx.parent_name, {"gm.com": "GM", "acme.com": "Acme"}),
]


@pytest.mark.parametrize("fn, cases", GOLDEN)
def test_golden(spark, fn, cases):
    assert column(spark, list(cases), fn) == list(cases.values())


def test_freshness(spark):
    as_of = "2024-01-31 00:00:00"
    days = [datetime(2024, 1, 24), None, datetime(2024, 2, 5)]
    assert column(spark, days, lambda c: dt.freshness(c, as_of), "v timestamp") == [0.5, 0.5, 1.0]


def test_parse_date_forms(spark):
    forms = ["2024-01-05T10:00:00+02:00", "Fri, 05 Jan 2024 08:00:00 GMT", "Fri, 5 Jan 2024 08:00:00 +0000", "2024-01-05 08:00:00",
             "2024-01-05", "January 5, 2024", "5 January 2024", "01/05/2024", "soon", "", None, "2024-13-45"]
    got = column(spark, forms, lambda c: F.date_format(dt.parse_date(c), "yyyy-MM-dd HH"))
    assert got == ["2024-01-05 08"] * 4 + ["2024-01-05 00"] * 4 + [None] * 4
