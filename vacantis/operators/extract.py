"""Payloads and pages to job, link and company rows (X-operators)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as cl, dates as dt, text as tx
from ..functions.core import CI, extract, first_extract, nz, once
from ..functions.payload import jget, jlist, jpath, jsonld_postings, jtext
from ..rules import boards, misc, providers as pr


# How a platform's payload is read is data: a *spec* per platform, looked up by the
# row's platform and followed by one expression, the same for all.  So a document
# costs its own fields, however many platforms there are, and a new platform is a
# row of the field map.

#: An alternative of a field: what kind it is and the variant paths it needs.
_ALTERNATIVE = "struct<kind:string,paths:array<array<string>>>"
SPECS = f"map<string,struct<jobs:array<string>,fields:array<array<{_ALTERNATIVE}>>,remote:array<string>>>"
FIELD_MAP = "ats_type string, field string, priority int, alternative string"
#: A field map is configuration and goes into the plan, so its size is checked.
MOST_ROWS = 20_000


def _alternative(text: str) -> dict:
    """An alternative as it is written in the field map, taken apart."""
    kind, _, rest = text.partition(" ")
    if kind == "csc":
        return {"kind": "csc", "paths": [[jpath(q) for q in p.split("|")] for p in rest.split() if p != "-"]}
    if kind in ("names", "range"):
        return {"kind": kind, "paths": [[jpath(p)] for p in rest.split()]}
    if kind == "each":
        return {"kind": "each", "paths": [[jpath(rest)]]}
    if kind == "url" and rest:  # a piece of text, or nothing and what fills the place
        pieces = re.split(r"\{(\w+)\}", rest)
        return {"kind": "url", "paths": [[x] if i % 2 == 0 else ["", x if x == "ident" else jpath(x)] for i, x in enumerate(pieces) if x]}
    return {"kind": "path", "paths": [[jpath(text)]]}


def field_map_rows() -> list[tuple]:
    """The known platforms' field map as rows (ats_type, field, priority, alternative)."""
    return [(kind, field, n, alt) for kind, spec in pr.PROVIDERS.items() for field, alts in spec.items() for n, alt in enumerate(alts)]


def specs_of(rows) -> str:
    """Field map rows as the JSON text of the platforms' specs."""
    maps: dict[str, dict[str, list]] = {}
    for kind, field, priority, alt in rows:
        maps.setdefault(kind, {}).setdefault(field, []).append((priority, alt))
    read = lambda m, field: [alt for _, alt in sorted(m.get(field, []))]
    return json.dumps({kind: {"jobs": [jpath(p) for p in read(m, "jobs")], "remote": [jpath(p) for p in read(m, "remote")],
                              "fields": [[_alternative(a) for a in read(m, f)] for f in pr.PAYLOAD_FIELDS]} for kind, m in maps.items()})


_KNOWN = specs_of(field_map_rows())


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, {path}, '{kind}')"


def _text(v: str, path: str) -> str:
    """SQL of :func:`vacantis.functions.payload.jtext`; ``path`` is an expression."""
    scalar = f"{_get(v, path, 'map<string,variant>')} IS NULL AND {_get(v, path, 'array<variant>')} IS NULL"
    return (f"element_at(transform(array({_get(v, path, 'string')}), t -> CASE WHEN t <> '' AND "
            f"(left(t, 1) NOT IN ('{{', '[') OR ({scalar})) THEN t END), 1)")


def _salary(v: str) -> str:
    """SQL of :func:`vacantis.functions.text.jsonld_salary` on the paths of an alternative ``a``."""
    lo, hi = (f"nullif({_get(v, f'a.paths[{i}][0]', 'bigint')}, 0)" for i in (0, 1))
    cur = f"coalesce({_text(v, 'a.paths[2][0]')}, 'USD')"
    return (f"CASE WHEN {lo} IS NOT NULL AND {hi} IS NOT NULL THEN concat({cur}, ' ', format_number({lo}, 0), ' - ', format_number({hi}, 0)) "
            f"WHEN {lo} IS NOT NULL THEN concat({cur}, ' ', format_number({lo}, 0), '+') "
            f"WHEN {hi} IS NOT NULL THEN concat('Up to ', {cur}, ' ', format_number({hi}, 0)) END")


def _first(alternatives: str, name: str, value: str, kind: str = "string") -> str:
    """The first of a list that gives something; those behind it are not looked at."""
    return f"aggregate({alternatives}, cast(null AS {kind}), (found, {name}) -> coalesce(found, {value}))"


def _field(v: str, alternatives: str, ident: str) -> str:
    """One field of a job object, first non-empty alternative."""
    member = "coalesce(" + ", ".join(_text("x", f"'{jpath(p)}'") for p in ("name", "city", "$")) + ")"
    pieces = f"transform(a.paths, p -> CASE WHEN size(p) = 1 THEN p[0] WHEN p[1] = 'ident' THEN nullif({ident}, '') ELSE {_text(v, 'p[1]')} END)"
    value = (f"CASE a.kind WHEN 'path' THEN {_text(v, 'a.paths[0][0]')} "
             f"WHEN 'csc' THEN nullif(concat_ws(', ', transform(a.paths, ps -> {_first('ps', 'p', _text(v, 'p'))})), '') "
             f"WHEN 'names' THEN nullif(array_join(transform({_get(v, 'a.paths[0][0]', 'array<variant>')}, x -> {_text('x', 'a.paths[1][0]')}), ', '), '') "
             f"WHEN 'each' THEN nullif(array_join(transform({_get(v, 'a.paths[0][0]', 'array<variant>')}, x -> {member}), ', '), '') "
             f"WHEN 'range' THEN {_salary(v)} "
             f"WHEN 'url' THEN element_at(transform(array({pieces}), u -> CASE WHEN NOT exists(u, x -> x IS NULL) THEN array_join(u, '') END), 1) END")
    return _first(alternatives, "a", value)


def payload_jobs_sql(body: str, kind: str, ident: str, specs: str = _KNOWN) -> str:
    """SQL for the array of job structs of a payload document; jobs without a title are left out.

    Arguments are SQL expressions.  The document is parsed once; pages and
    other non-JSON bodies, and unknown platforms, give an empty array.
    """
    some = f"element_at(transform(array({_get('d', 'p', 'array<variant>')}), a -> CASE WHEN size(a) > 0 THEN a END), 1)"
    jobs = _first("m.jobs", "p", some, "array<variant>")
    fields = [f"'{n}', {_field('j', f'm.fields[{i}]', ident)}" for i, n in enumerate(pr.PAYLOAD_FIELDS)]
    fields.append(f"'remote', {_first('m.remote', 'p', _get('j', 'p', 'boolean'), 'boolean')}")
    none = "cast(array() AS array<variant>)"
    found = f"coalesce(element_at(transform(array(try_parse_json({body})), d -> {jobs}), 1), {none})"
    known = "from_json('" + specs.replace("\\", "\\\\").replace("'", "\\'") + f"', '{SPECS}')"
    return (f"element_at(transform(array(try_element_at({known}, {kind})), m -> "
            f"filter(transform({found}, j -> named_struct({', '.join(fields)})), j -> j.title IS NOT NULL)), 1)")


def payload_jobs_column(body: str, kind: str, ident: str, specs: str = _KNOWN) -> Column:
    return F.expr(payload_jobs_sql(body, kind, ident, specs))


def extract_payload_jobs(payloads: DataFrame, field_map: DataFrame | None = None) -> DataFrame:
    """Board payloads of all platforms to raw jobs, in one narrow pass.

    ``field_map`` has rows like :func:`field_map_rows` and takes the place of the known platforms.
    """
    specs = _KNOWN
    if field_map is not None:
        rows = field_map.select("ats_type", "field", "priority", "alternative").limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a field map has at most {MOST_ROWS} rows")
        specs = specs_of(map(tuple, rows))
    jobs = payload_jobs_column("body", "ats_type", "ats_identifier", specs)
    return (payloads.select("company_id", "ats_type", F.posexplode(jobs).alias("position", "job"))
            .select("company_id", "ats_type", "position", "job.*"))


def _place(v: Column) -> Column:
    """Location of a JSON-LD posting: text, address text, address parts or name; the first of a list."""
    def one(x):
        parts = nz(F.concat_ws(", ", jtext(x, "address.addressLocality"), jtext(x, "address.addressRegion"),
                               jtext(x, "address.addressCountry")))
        return F.coalesce(jtext(x, "$"), jtext(x, "address"), parts, jtext(x, "name"))
    first = F.try_element_at(jlist(v, "jobLocation"), F.lit(1))
    return F.coalesce(one(F.try_variant_get(v, "$.jobLocation", "variant")), one(first))


def jsonld_column(html: Column, url: Column) -> Column:
    """Array of jobs in the JSON-LD scripts of a page."""
    docs = F.regexp_extract_all(html, F.lit(pr.JSONLD_SCRIPT), F.lit(1))
    found = F.flatten(F.transform(docs, jsonld_postings))
    num = lambda v, p: F.try_variant_get(v, p, "bigint")
    jobs = F.transform(found, lambda v: F.struct(
        jget(v, "title", "name").alias("title"), F.coalesce(jtext(v, "url"), url).alias("url"),
        _place(v).alias("location"), F.lit(None).cast("string").alias("department"),
        jtext(v, "employmentType").alias("type"), jtext(v, "datePosted").alias("posted"),
        jtext(v, "description").alias("description"),
        tx.jsonld_salary(jtext(v, "baseSalary.currency"), num(v, "$.baseSalary.value.minValue"),
                         num(v, "$.baseSalary.value.maxValue")).alias("salary"),
        F.lit(None).cast("boolean").alias("remote")))
    return F.filter(jobs, lambda j: j["title"].isNotNull())


def extract_jsonld(pages: DataFrame) -> DataFrame:
    """X2."""
    return (pages.select("page_id", F.posexplode(jsonld_column(F.col("html"), F.col("url"))).alias("position", "job"))
            .select("page_id", "position", "job.*"))


# pieces of a JSON text: strings, brackets, and the rest between them
_PIECES = r'''"(?:[^"\\]|\\.)*+"|[\[\]]|[^"\[\]]++|"'''


def _balanced(tail: str) -> str:
    """SQL: the list that a text begins with, up to its own closing bracket; null when it has none.

    One pass over the pieces; brackets inside strings do not count.
    """
    step = ("CASE WHEN a.size > 0 AND a.depth = 0 THEN a ELSE named_struct('depth', a.depth + CASE x WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END, "
            "'size', a.size + length(x)) END")
    return (f"element_at(transform(array({tail}), t -> aggregate(regexp_extract_all(t, r'{_PIECES}', 0), named_struct('depth', 0, 'size', 0), "
            f"(a, x) -> {step}, a -> CASE WHEN a.size > 0 AND a.depth = 0 THEN left(t, a.size) END)), 1)")


def script_jobs_column(html: str, kind: str) -> Column:
    """Array of jobs of JSON lists assigned inside scripts."""
    lists = ", ".join(_balanced(f"regexp_extract({html}, r'{p}', 1)") for p in pr.SCRIPT_ARRAYS)
    jobs = payload_jobs_sql("doc", kind, "cast(NULL AS string)")
    return F.expr(f"array_distinct(flatten(transform(array_compact(array({lists})), doc -> {jobs})))")


def extract_script_jobs(pages: DataFrame) -> DataFrame:
    """``jobs = […]`` inside scripts, read with the platform's field map."""
    return (pages.select("page_id", F.posexplode(script_jobs_column("html", "ats_type")).alias("position", "job"))
            .select("page_id", "position", "job.*"))


def embedded_state(html: Column | str) -> Column:
    """State object that a page ships in a script, as a variant."""
    html = F.col(html) if isinstance(html, str) else html
    return F.try_parse_json(first_extract(html, pr.EMBEDDED_STATE))


def outbound_links(pages: DataFrame) -> DataFrame:
    """Links to other sites that could be companies.  ``pages(source, html)``."""
    urls = F.regexp_extract_all("html", F.lit(CI + boards.OUTBOUND_LINK), F.lit(1))
    out = pages.select("source", F.explode(F.array_distinct(urls)).alias("url"))
    out = out.withColumn("domain", tx.strip_www(F.lower(F.regexp_extract("url", CI + boards.OUTBOUND_HOST, 1))))
    return out.filter((F.col("domain") != tx.strip_www(F.lower("source"))) & tx.is_candidate_domain("domain"))


def careers_link(html: Column | str, base: Column | str) -> Column:
    """First careers link of a page, resolved."""
    html = F.col(html) if isinstance(html, str) else html
    return tx.resolve_url(base, first_extract(html, boards.CAREER_LINK_PATTERNS, flags=CI))


def job_links(html: Column | str, base: Column | str, k: int | None = None) -> Column:
    """Links that look like single postings, resolved, in pattern order; all of them, or the first ``k``."""
    html = F.col(html) if isinstance(html, str) else html
    base = F.col(base) if isinstance(base, str) else base
    hrefs = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit(CI + p), F.lit(1)) for p in boards.JOB_LINK_PATTERNS]))
    links = F.filter(F.transform(hrefs, lambda h: tx.resolve_url(base, h)),
                     lambda u: (F.length(u) >= 20) & (F.regexp_replace(u, "/+$", "") != F.regexp_replace(base, "/+$", "")))
    links = F.array_distinct(links)
    return links if k is None else F.slice(links, 1, k)


def _link_of(rank: int, label: str):
    return lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), F.lit(label).alias("ats_type"),
                                 x["url"].alias("url"), x["id"].alias("id"))


def board_links(pages: DataFrame) -> DataFrame:
    """Every board link of a page as a company, once per page, type and identifier.

    ``pages(page_id, html)``; patterns with an empty identifier fall back to
    the address.
    """
    found = []
    for rank, (label, pattern) in enumerate(misc.BOARD_LINKS):
        both = F.arrays_zip(F.regexp_extract_all("html", F.lit(CI + pattern), F.lit(1)).alias("url"),
                            F.regexp_extract_all("html", F.lit(CI + pattern), F.lit(2)).alias("id"))
        found.append(F.transform(both, _link_of(rank, label)))
    x = pages.select("page_id", F.explode(F.flatten(F.array(*found))).alias("m")).select("page_id", "m.*")
    x = x.withColumn("url", F.when(F.col("url").startswith("http"), F.col("url")).otherwise(F.concat(F.lit("https://"), "url")))
    host = tx.host_of("url")
    own = F.when(F.col("ats_type").isin("bamboohr", "recruitee", "breezy"),
                 F.when(~tx.first_label_of(host).isin("www", "jobs", "careers"), tx.first_label_of(host)))
    by_host = None
    for label, h in misc.BOARD_LINK_HOSTS.items():
        hit = (F.col("ats_type") == label) & host.contains(h)
        part = extract(F.col("url"), r"^https?://[^/]+/+([^/?#]+)")
        by_host = F.when(hit, part) if by_host is None else by_host.when(hit, part)
    x = x.withColumn("ats_identifier", F.coalesce(nz("id"), own, by_host))
    x = x.filter(F.col("ats_identifier").isNotNull() & ~F.lower("ats_identifier").isin(misc.BOARD_LINK_SKIP))
    x = (x.groupBy("page_id", "ats_type", "ats_identifier")
         .agg(F.min_by("url", F.struct("rank", "pos")).alias("source_url")))
    valid = None
    for label, h in misc.BOARD_LINK_HOSTS.items():
        hit = (F.col("ats_type") == label) & F.col("source_url").contains(h)
        valid = hit if valid is None else valid | hit
    built = F.lit(None).cast("string")
    for label, form in misc.BOARD_LINK_URLS.items():
        built = F.when(F.col("ats_type") == label, F.format_string(form, "ats_identifier")).otherwise(built)
    return x.select("page_id", "ats_type", "ats_identifier", tx.name_from_slug("ats_identifier").alias("name"),
                    F.when(valid, F.col("source_url")).otherwise(F.coalesce(built, tx.board_url("ats_type", "ats_identifier"))).alias("careers_url"),
                    "source_url", F.lit("US").alias("country"))


def companies_from_news(items: DataFrame, as_of, max_age_days: int = 30) -> DataFrame:
    """Companies named in funding news, once each over all items.

    ``items(title, description, link, pub_date, feed_name)``.  The earliest
    link (in text order) of a name wins.
    """
    i = items.filter(dt.feed_recent("pub_date", as_of, max_age_days) & tx.has_any_keyword("title", "description"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    names = F.concat(F.regexp_extract_all(text, F.lit(CI + misc.NEWS_RAISES), F.lit(1)),
                     F.regexp_extract_all(text, F.lit(CI + misc.NEWS_AMOUNT_FOR), F.lit(1)))
    named = F.transform(F.filter(names, lambda n: F.length(n).between(3, 40) & n.rlike("^[A-Z]")
                                 & ~F.lower(n).isin(misc.NEWS_SKIP_WORDS)),
                        lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("website_url")))
    hosts = F.regexp_extract_all(text, F.lit(misc.NEWS_URL), F.lit(1))
    linked = F.transform(F.filter(hosts, lambda d: ~F.lower(d).isin(misc.NEWS_SKIP_DOMAINS)),
                         lambda d: F.struct(F.initcap(tx.first_label_of(d)).alias("name"),
                                            F.concat(F.lit("https://"), d).alias("website_url")))
    rows = i.select("link", "feed_name", "description", cl.funding_stage(text).alias("funding_stage"),
                    F.posexplode(F.concat(named, linked)).alias("pos", "c"))
    best = F.min_by(F.struct("c", "link", "feed_name", "description", "funding_stage"), F.struct("link", "pos"))
    rows = rows.groupBy(F.lower("c.name").alias("key")).agg(best.alias("b"))
    return rows.select(
        F.col("b.c.name").alias("name"), F.col("b.c.website_url").alias("website_url"),
        F.concat(F.lit("funding_news_"), F.replace(F.lower("b.feed_name"), F.lit(" "), F.lit("_"))).alias("source"),
        F.col("b.link").alias("source_url"), F.trim(F.regexp_replace("b.description", "<[^>]+>", "")).alias("description"),
        F.col("b.funding_stage").alias("funding_stage"), F.lit("US").alias("country"))
