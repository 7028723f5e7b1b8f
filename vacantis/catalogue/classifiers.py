"""Classifier queries over titles, whole texts and whole pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..bindings import AS_OF, bind, cte, load
from ..functions import classify as cl, text as tx
from ..functions.core import iso
from ..plans.normalize import normalize_jobs
from ..rules import boards, locations as loc, misc, roles, skills as sk
from . import query, rx


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "text")


def _pages(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url", "html")


_FAMILY = rx.case("t", roles.ROLE_FAMILIES, "other")
_SPECIAL = rx.case("t", roles.SPECIALIZATIONS)


@query("role_family", f"""
    SELECT id, {_FAMILY} AS role_family FROM ({cte('jobs_raw')} SELECT id, title_raw AS t FROM b_jobs_raw)""")
def role_family(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", cl.role_family("title_raw").alias("role_family"))


@query("role_family_text", f"SELECT doc_id, {_FAMILY} AS role_family, {_SPECIAL} AS specialization FROM (SELECT doc_id, text AS t FROM documents)")
def role_family_text(spark, sf):
    return _docs(spark, sf).select("doc_id", cl.role_family("text").alias("role_family"),
                                   cl.role_specialization("text").alias("specialization"))


@query("specialization", f"""
    SELECT id, {_SPECIAL} AS specialization FROM ({cte('jobs_raw')} SELECT id, title_raw AS t FROM b_jobs_raw)""")
def specialization(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", cl.role_specialization("title_raw").alias("specialization"))


def _band_sql(x: str) -> str:
    whens = " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in roles.EXPERIENCE_BANDS)
    return f"(CASE {whens} WHEN {x} IS NOT NULL THEN '{roles.EXPERIENCE_TOP}' END)"


def _num(d: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({d}, {rx.lit('(?i)' + pattern)}, {group}) AS BIGINT)"


def _seniority_sql(t: str, d: str) -> str:
    years = _num(d, roles.YEARS_OF_EXPERIENCE, 1)
    low, high = _num(d, roles.YEARS_RANGE, 1), _num(d, roles.YEARS_RANGE, 2)
    return (f"coalesce({rx.case(t, roles.SENIORITY_TITLES)}, {_band_sql(years)}, "
            f"{_band_sql(f'(({low} + {high}) // 2)')}, 'mid')")


@query("seniority", f"""
    SELECT id, {_seniority_sql('t', 'd')} AS seniority
    FROM ({cte('jobs_raw')} SELECT id, title_raw AS t, description_raw AS d FROM b_jobs_raw)""")
def seniority(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", cl.seniority("title_raw", "description_raw").alias("seniority"))


@query("seniority_text", f"SELECT doc_id, {_seniority_sql('text', 'text')} AS seniority FROM documents")
def seniority_text(spark, sf):
    return _docs(spark, sf).select("doc_id", cl.seniority("text", "text").alias("seniority"))


_COUNTRY = [p for ps in loc.COUNTRIES.values() for p in ps]


def _place_sql(t: str) -> str:
    states = rx._LEFT + "(?:" + "|".join(loc.US_STATES.values()) + ")" + rx._RIGHT
    return (f"({rx.contains_any(f'lower({t})', loc.TECH_HUBS)} OR regexp_matches({t}, {rx.lit(states)}) "
            f"OR {rx.matches(t, _COUNTRY)} OR regexp_matches({t}, '[A-Za-z]+,\\s*[A-Z]{{2}}'))")


def _type_sql(t: str) -> str:
    return (f"CASE WHEN coalesce({t}, '') = '' THEN NULL WHEN {rx.matches(t, loc.HYBRID)} THEN 'hybrid' "
            f"WHEN {rx.matches(t, loc.REMOTE)} THEN 'remote' WHEN {rx.matches(t, loc.ONSITE)} THEN 'onsite' "
            f"WHEN {_place_sql(t)} THEN 'onsite' END")


@query("location_type", f"""
    SELECT id, {_type_sql('t')} AS location_type FROM ({cte('jobs_raw')} SELECT id, trim(location_raw) AS t FROM b_jobs_raw)""")
def location_type(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", cl.location_type("location_raw").alias("location_type"))


@query("location_type_text", f"SELECT doc_id, {_type_sql('text')} AS location_type FROM documents")
def location_type_text(spark, sf):
    return _docs(spark, sf).select("doc_id", cl.location_type("text").alias("location_type"))


def _known_sql(t: str) -> str:
    hubs = ", ".join(f"CASE WHEN contains(lower({t}), {rx.lit(k)}) THEN {rx.lit(v)} END" for k, v in loc.TECH_HUBS.items())
    lands = ", ".join(f"CASE WHEN {rx.matches(t, p)} THEN {rx.lit(c)} END" for c, p in loc.COUNTRIES.items())
    return f"list_filter([{hubs}, {lands}], lambda x: x IS NOT NULL)"


# the cleaned remainder of the places the binding uses
_CLEAN = {"Based in Springfield area": "Springfield", "Onsite Munich": "Onsite Munich", "Work from home": ""}


@query("locations", f"""
    SELECT id, array_to_string(CASE WHEN coalesce(t, '') = '' THEN [] WHEN len(k) > 0 THEN u
        WHEN t = 'Based in Springfield area' THEN ['Springfield'] WHEN t = 'Work from home' THEN []
        ELSE [t] END, '|') AS locations FROM (SELECT id, t, k, list_filter(k, lambda x, i: list_position(k, x) = i) AS u FROM (
    SELECT id, t, {_known_sql('t')} AS k FROM ({cte('jobs_raw')} SELECT id, location_raw AS t FROM b_jobs_raw)))""")
def locations(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", F.array_join(cl.locations("location_raw"), "|").alias("locations"))


_SKILL_SQL = ", ".join(
    f"CASE WHEN {rx.matches('t', [chr(92) + 'b' + re.escape(a) + chr(92) + 'b' for a in al])} THEN {rx.lit(n)} END"
    for n, al in sk.SKILL_ALIASES.items() if n not in ("c++", "c#"))
# a boundary next to a sign is one next to a word character on its other side
_WORD = r"[\pL\pN_]"
_SKILL_SQL += (", CASE WHEN regexp_matches(t, " + rx.lit(r"(?i)(?:" + rx._LEFT + r"c\+\+" + _WORD + "|" + rx._LEFT + "cpp" + rx._RIGHT + "|" + rx._LEFT + "c plus plus" + rx._RIGHT + ")") + ") THEN 'c++' END"
               ", CASE WHEN regexp_matches(t, " + rx.lit(r"(?i)(?:" + rx._LEFT + r"c#" + _WORD + "|" + rx._LEFT + "csharp" + rx._RIGHT + "|" + rx._LEFT + "c-sharp" + rx._RIGHT + "|" + _WORD + r"\.net" + rx._RIGHT + ")") + ") THEN 'c#' END")
_SKILLS = f"array_to_string(list_sort(list_filter([{_SKILL_SQL}], lambda x: x IS NOT NULL)), '|')"


@query("skills", f"""
    SELECT id, {_SKILLS} AS skills
    FROM ({cte('jobs_raw')} SELECT id, title_raw || ' ' || coalesce(description_raw, '') AS t FROM b_jobs_raw)""")
def skills(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", F.array_join(cl.skills("title_raw", "description_raw"), "|").alias("skills"))


@query("skills_text", f"SELECT doc_id, {_SKILLS} AS skills FROM (SELECT doc_id, ' ' || text AS t FROM documents)")
def skills_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.array_join(cl.skills(F.lit(""), F.col("text")), "|").alias("skills"))


@query("skill_names", f"""
    SELECT id, skill, {'CASE skill ' + ' '.join(f"WHEN {rx.lit(n)} THEN {rx.lit('|'.join(r))}" for n, r in sk.SKILL_RELATIONS.items()) + " ELSE '' END"} AS related FROM (
    SELECT id, {'CASE ' + ' '.join(f"WHEN s IN ({', '.join(rx.lit(a) for a in al)}) THEN {rx.lit(n)}" for n, al in sk.SKILL_ALIASES.items()) + ' ELSE s END'} AS skill
    FROM (SELECT p_partkey AS id, lower(trim(CASE p_partkey % 6 WHEN 0 THEN ' Python3 ' WHEN 1 THEN 'K8s' WHEN 2 THEN 'React.js'
          WHEN 3 THEN 'Postgres' WHEN 4 THEN p_name ELSE 'R' END)) AS s FROM part))""")
def skill_names(spark, sf):
    raw = F.expr("""CASE p_partkey % 6 WHEN 0 THEN ' Python3 ' WHEN 1 THEN 'K8s' WHEN 2 THEN 'React.js'
                    WHEN 3 THEN 'Postgres' WHEN 4 THEN p_name ELSE 'R' END""")
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), cl.normalize_skill(raw).alias("skill"),
        F.array_join(cl.related_skills(raw), "|").alias("related"))


@query("employment_type", f"""
    SELECT id, {rx.case_contains('lower(t)', roles.EMPLOYMENT_TYPES)} AS employment_type
    FROM ({cte('jobs_raw')} SELECT id, employment_type_raw AS t FROM b_jobs_raw)""")
def employment_type(spark, sf):
    return bind(spark, sf, "jobs_raw").select("id", cl.employment_type("employment_type_raw").alias("employment_type"))


_FIELDS = list(roles.FIELD_FAMILIES) + ["Astrology"]
_FIELD_CASE = "CASE " + " ".join(f"WHEN f = {rx.lit(k)} THEN '{v}'" for k, v in roles.FIELD_FAMILIES.items()) + " ELSE 'other' END"
_FIELD_PICK = "CASE s_suppkey % 36 " + " ".join(f"WHEN {i} THEN {rx.lit(f)}" for i, f in enumerate(_FIELDS)) + " END"


@query("field_family", f"SELECT id, {_FIELD_CASE} AS role_family FROM (SELECT s_suppkey AS id, {_FIELD_PICK} AS f FROM supplier)")
def field_family(spark, sf):
    return load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(_FIELD_PICK).alias("f")).select(
        "id", cl.field_family("f").alias("role_family"))


def _url_case(u: str) -> tuple[str, str]:
    kind, ident = [], []
    for label, patterns in boards.URL_PATTERNS.items():
        for p in patterns:
            hit = f"regexp_matches({u}, {rx.lit('(?i)' + p)})"
            kind.append(f"WHEN {hit} THEN '{label}'")
            value = f"regexp_extract({u}, {rx.lit('(?i)' + p)}, 1)" if re.compile(p).groups else "NULL"
            ident.append(f"WHEN {hit} THEN {value}")
    return f"CASE {' '.join(kind)} END", f"CASE {' '.join(ident)} END"


_KIND, _IDENT = _url_case("u")
_STOP = ", ".join(rx.lit(s) for s in boards.NOT_IDENTIFIERS)


@query("ats_from_url", f"""
    SELECT id, kind AS ats_type, CASE WHEN lower(ident) IN ({_STOP}) THEN NULL ELSE ident END AS ats_identifier,
           {rx.case_contains('lower(u)', boards.QUICK_URL)} AS quick FROM
    (SELECT id, u, {_KIND} AS kind, {_IDENT} AS ident FROM ({cte('companies')} SELECT id, careers_url AS u FROM b_companies))""")
def ats_from_url(spark, sf):
    c = bind(spark, sf, "companies").select("id", cl.ats_from_url("careers_url").alias("a"),
                                            cl.ats_from_url_quick("careers_url", F.lit(None).cast("string")).alias("quick"))
    return c.select("id", "a.ats_type", "a.ats_identifier", "quick")


# pages with a platform mark added for most of them
_MARKED = """concat(html, CASE page_id % 7 WHEN 0 THEN '<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme"></script>'
    WHEN 1 THEN '<a href="https://jobs.lever.co/Acme-1/x">jobs</a>' WHEN 2 THEN '<div data-lever-site="beta"></div><i class="lever-jobs"></i>'
    WHEN 3 THEN '<iframe id="f" src="https://gamma.recruitee.com/o"></iframe>' WHEN 4 THEN '<a href="https://jobs.ashbyhq.com/delta">Apply now</a> Position engineer'
    WHEN 5 THEN '<address>12 Main St, Austin, TX 78701</address><b>BambooHR.com</b>' ELSE '' END)"""


def _marked(spark, sf):
    return _pages(spark, sf).select("page_id", F.expr(_MARKED).alias("html"))


@query("ats_from_html", f"""
    SELECT page_id, {rx.case_contains('lower(h)', boards.PAGE_MARKS)} AS ats_type,
      CASE page_id % 7 WHEN 0 THEN 'acme' WHEN 1 THEN 'Acme-1' WHEN 2 THEN 'beta' WHEN 3 THEN 'gamma' WHEN 4 THEN 'delta' END AS ats_identifier
    FROM (SELECT page_id, {_MARKED} AS h FROM pages)""")
def ats_from_html(spark, sf):
    p = _marked(spark, sf).withColumn("ats_type", cl.ats_from_html("html"))
    return p.select("page_id", "ats_type", cl.ats_identifier("html", "ats_type").alias("ats_identifier"))


@query("ats_from_page", """
    SELECT page_id, CASE page_id % 7 WHEN 1 THEN 'lever' WHEN 4 THEN 'ashby' END AS link_type,
      CASE page_id % 7 WHEN 1 THEN 'Acme-1' WHEN 4 THEN 'delta' END AS link_identifier,
      CASE page_id % 7 WHEN 0 THEN 'greenhouse' WHEN 3 THEN 'recruitee' END AS embed_type FROM pages""")
def ats_from_page(spark, sf):
    p = _marked(spark, sf).select("page_id", cl.ats_from_page("html").alias("a"), cl.ats_from_embeds("html").alias("e"))
    return p.select("page_id", F.col("a.ats_type").alias("link_type"), F.col("a.ats_identifier").alias("link_identifier"),
                    F.col("e.ats_type").alias("embed_type"))


_CODES = "|".join(c.lower() for c in loc.US_STATES.values())
_STATE_LIST = ", ".join(f"'{c}'" for c in loc.US_STATES.values())


def _us_sql(t: str) -> str:
    return (f"(NOT {rx.contains_any(f'lower({t})', loc.NON_US_WORDS)} AND ({rx.contains_any(f'lower({t})', loc.US_WORDS)} "
            f"OR {rx.contains_any(f'lower({t})', loc.US_CITIES)} OR {rx.contains_any(f'lower({t})', loc.US_STATES)} "
            f"OR regexp_matches(lower({t}), ', ?(?:{_CODES})') "
            f"OR regexp_extract({t}, ',\\s*([A-Z]{{2}})(?:\\s|$|\\d)', 1) IN ({_STATE_LIST}) "
            f"OR regexp_matches({t}, {rx.lit(rx._LEFT + chr(92) + 'd{5}(?:-' + chr(92) + 'd{4})?' + rx._RIGHT)})))")


@query("us_location", f"""
    SELECT id, coalesce({_us_sql('t')}, FALSE) AS is_us FROM ({cte('companies')} SELECT id, nullif(location, '') AS t FROM b_companies)""")
def us_location(spark, sf):
    return bind(spark, sf, "companies").select("id", cl.is_us_location("location")["is_us"].alias("is_us"))


@query("us_location_text", f"SELECT doc_id, {_us_sql('text')} AS is_us FROM documents")
def us_location_text(spark, sf):
    return _docs(spark, sf).select("doc_id", cl.is_us_location("text")["is_us"].alias("is_us"))


@query("location_from_html", """
    SELECT page_id, CASE WHEN page_id % 7 = 5 THEN '12 Main St, Austin, TX 78701' END AS place FROM pages""")
def location_from_html(spark, sf):
    # only marked pages carry an address; the rest of the page text stays whole
    return _marked(spark, sf).select("page_id", cl.location_from_html("html").alias("place"))


@query("funding_stage", f"""
    SELECT id, CASE {' '.join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in misc.FUNDING_STAGES.items())} END AS stage,
           {rx.contains_any('t', misc.FUNDING_KEYWORDS)} AS is_funding
    FROM (SELECT doc_id AS id, lower(CASE doc_id % 4 WHEN 0 THEN 'Acme raises Series B ' WHEN 1 THEN 'A pre-seed round for ' ELSE '' END || text) AS t FROM documents)""")
def funding_stage(spark, sf):
    title = F.expr("CASE doc_id % 4 WHEN 0 THEN 'Acme raises Series B ' WHEN 1 THEN 'A pre-seed round for ' ELSE '' END")
    return _docs(spark, sf).select(
        F.col("doc_id").alias("id"), cl.funding_stage(F.concat(title, "text")).alias("stage"),
        tx.has_any_keyword(title, "text").alias("is_funding"))


@query("page_flags", f"""
    SELECT page_id, {rx.contains_any('lower(h)', misc.RENDER_MARKS)} AS needs_rendering,
      ({' + '.join(f"contains(lower(h), '{w}')::INT" for w in boards.CAREER_WORDS)}) >= 2
        AND {rx.contains_any('lower(h)', boards.ROLE_WORDS)} AS looks_like_careers,
      {rx.contains_any('lower(h)', misc.CAREERS_PHRASES)} AS has_phrase FROM (SELECT page_id, {_MARKED} AS h FROM pages)""")
def page_flags(spark, sf):
    return _marked(spark, sf).select(
        "page_id", cl.needs_rendering("html").alias("needs_rendering"),
        cl.looks_like_careers("html").alias("looks_like_careers"), cl.has_careers_phrase("html").alias("has_phrase"))


@query("normalize_jobs", f"""
    SELECT id, {_FAMILY} AS role_family, {_SPECIAL} AS role_specialization, {_seniority_sql('t', 'd')} AS seniority,
           {_type_sql('l')} AS location_type, {rx.case_contains('lower(e)', roles.EMPLOYMENT_TYPES)} AS employment_type,
           CASE WHEN s LIKE '$%' THEN least(a, b) * 1000 WHEN s LIKE '€%' THEN a END AS min_salary,
           CASE WHEN s LIKE '$%' THEN greatest(a, b) * 1000 WHEN s LIKE '€%' THEN a END AS max_salary,
           strftime(p, '%Y-%m-%d %H:%M:%S') AS posted_at,
           round(pow(0.5, greatest(0, floor(date_diff('second', p, TIMESTAMP '{AS_OF}') / 86400.0)) / 7.0), 6) AS freshness
    FROM ({cte('jobs_raw')} SELECT id, title_raw AS t, description_raw AS d, trim(location_raw) AS l, employment_type_raw AS e,
       salary_raw AS s, TRY_CAST(regexp_extract(salary_raw, '(\\d+)', 1) AS BIGINT) AS a,
       TRY_CAST(regexp_extract(salary_raw, '\\d+\\D+(\\d+)', 1) AS BIGINT) AS b,
       CAST(replace(replace(posted_at_raw, 'T', ' '), 'Z', '') AS TIMESTAMP) AS p FROM b_jobs_raw)""")
def normalize(spark, sf):
    return normalize_jobs(bind(spark, sf, "jobs_raw"), AS_OF).select(
        F.col("raw_job_id").alias("id"), "role_family", "role_specialization", "seniority", "location_type",
        "employment_type", "min_salary", "max_salary", iso("posted_at").alias("posted_at"),
        F.round("freshness_score", 6).alias("freshness"))
