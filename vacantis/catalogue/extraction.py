"""Extraction, source and embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, AS_OF_EVENTS, bind, cte, load, pick
from ..functions.core import iso
from ..operators import aggregates as ag, dom, extract as ex, selectors as sl
from ..plans import crawl as cr, embed as em
from ..plans.normalize import embedding_text
from ..rules import boards, misc, providers as pr
from ..sources import directories as sd, tables as st
from . import query, rx

_EDGE = "[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
# text of a page's article, long enough to be a description
_ARTICLE = f"""(SELECT CASE WHEN length(a) > 100 THEN a END FROM (SELECT trim(regexp_replace(regexp_replace(
    regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g'), '{_EDGE}', ' ', 'g')) AS a))"""

# Every order is one posting in its platform's own JSON; a second object without a
# title rides along and has to be dropped.
_KINDS = list(pr.PROVIDERS)
_DOCS = {
    "greenhouse": '{{"jobs":[{{"title":"{t}","absolute_url":"{u}","location":{{"name":"{l}"}},"departments":[{{"name":"{d}"}},{{"name":"Extra"}}],"updated_at":"{p}"}},{{"absolute_url":"x"}}]}}',
    "lever": '[{{"text":"{t}","id":"{i}","categories":{{"location":"{l}","team":"{d}","commitment":"{k}"}},"descriptionPlain":"text {i}"}},{{"id":"0"}}]',
    "ashby": '{{"jobs":[{{"title":"{t}","id":"{i}","location":"{l}","team":{{"name":"{d}"}},"employmentType":"{k}","publishedAt":"{p}"}}]}}',
    "workable": '{{"jobs":[{{"title":"{t}","url":"","shortlink":"{u}","city":"{l}","state":"","country":"US","department":"{d}","type":"{k}","created_at":"{p}"}}]}}',
    "bamboohr": '{{"result":[{{"jobOpeningName":"{t}","url":"{u}","location":"{l}","departmentLabel":"{d}","employmentStatusLabel":"{k}","datePosted":"{p}"}},{{"title":""}}]}}',
    "boon": '{{"jobs":[],"openings":[{{"job_title":"{t}","apply_url":"{u}","location":"{l}","team":"{d}","type":"{k}","posted_date":"{p}"}}]}}',
    "bullhorn": '{{"data":[{{"title":"{t}","publicUrl":"{u}","address":{{"city":"{l}","country":"US"}},"categories":{{"data":[{{"name":"{d}"}}]}},"employmentType":"{k}","dateAdded":"{p}"}}]}}',
    "eddy": '{{"data":[{{"title":"{t}","url":"{u}","city":"{l}","state":"CA","department":"{d}","employment_type":"{k}","created_at":"{p}"}}]}}',
    "folkshr": '{{"jobs":[{{"title":"{t}","url":"{u}","location":{{"city":"{l}"}},"department":{{"name":"{d}"}},"type":"{k}","published_at":"{p}"}}]}}',
    "freshteam": '{{"job_postings":[{{"title":"{t}","url":"{u}","branch":{{"city":"{l}"}},"department":{{"name":"{d}"}},"type":"{k}","created_at":"{p}"}}]}}',
    "gem": '{{"openings":[{{"name":"{t}","applyUrl":"{u}","locationName":"{l}","team":"{d}","type":"{k}","createdAt":"{p}"}}]}}',
    "gohire": '{{"vacancies":[{{"title":"{t}","url":"{u}","city":"{l}","country":"US","category":"{d}","type":"{k}","published_at":"{p}","salary":"50k"}}]}}',
    "icims": '{{"jobList":[{{"jobTitle":"{t}","detailUrl":"{u}","location":"{l}","category":"{d}","jobType":"{k}","postedDate":"{p}"}}]}}',
    "jazzhr": '[{{"title":"{t}","board_url":"{u}","city":"{l}","department":"{d}","type":"{k}","open_date":"{p}"}}]',
    "jobvite": '{{"requisitions":[{{"jobTitle":"{t}","applyUrl":"{u}","location":"{l}","category":"{d}","employmentType":"{k}","date":"{p}"}}]}}',
    "manatal": '{{"results":[{{"position_name":"{t}","apply_url":"{u}","locations":[{{"name":"{l}"}}],"department":{{"name":"{d}"}},"job_type":"{k}","created_at":"{p}"}}]}}',
    "pcrecruiter": '{{"Positions":[{{"PositionTitle":"{t}","Url":"{u}","City":"{l}","Category":"{d}","JobType":"{k}","OpenDate":"{p}"}}]}}',
    "pinpoint": '{{"data":[{{"attributes":{{"title":"{t}","location_name":"{l}","team":"{d}","type":"{k}","created_at":"{p}"}},"links":{{"self":"{u}"}}}}]}}',
    "recooty": '{{"results":[{{"job_title":"{t}","url":"{u}","city":"{l}","category":"{d}","employment_type":"{k}","created_at":"{p}"}}]}}',
    "recruitcrm": '{{"data":[{{"job_title":"{t}","job_url":"{u}","location":"{l}","department":"{d}","job_type":"{k}","created_on":"{p}","min_salary":1000,"max_salary":25000,"currency":"EUR"}}]}}',
    "recruitee": '{{"offers":[{{"position":"{t}","careers_url":"{u}","city":"{l}","category":"{d}","contract_type":"{k}","created_at":"{p}"}}]}}',
    "smartrecruiters": '{{"content":[{{"name":"{t}","ref":"{u}","location":{{"city":"{l}","country":"US"}},"department":{{"label":"{d}"}},"typeOfEmployment":{{"label":"{k}"}},"createdOn":"{p}"}}]}}',
    "successfactors": '{{"d":{{"results":[{{"jobReqLocale":{{"externalTitle":"{t}"}},"jobPostingUrl":"{u}","locationObj":{{"name":"{l}"}},"custDepartment":"{d}","jobType":"{k}","createdDateTime":"{p}"}}]}}}}',
    "talentreef": '{{"positions":[{{"position_title":"{t}","apply_url":"{u}","city":"{l}","brand":"{d}","job_type":"{k}","posted_date":"{p}"}}]}}',
    "zoho_recruit": '{{"data":[{{"Posting_Title":"{t}","$apply_url":"{u}","City":"{l}","Department":"{d}","Job_Type":"{k}","Created_Time":"{p}"}}]}}',
}
_WITH_COUNTRY = "('workable', 'bullhorn', 'gohire', 'smartrecruiters')"


def _payload_sql() -> str:
    arms = []
    for i, kind in enumerate(_KINDS):
        doc = _DOCS[kind].replace("{{", "\x01").replace("}}", "\x02")
        for key, column in (("t", "t"), ("u", "u"), ("l", "l"), ("d", "d"), ("k", "k"), ("p", "p"), ("i", "i")):
            doc = doc.replace("{" + key + "}", f"', {column}, '")
        arms.append(f"WHEN {i} THEN concat('" + doc.replace("\x01", "{").replace("\x02", "}") + "')")
    return f"CASE i % {len(_KINDS)} {' '.join(arms)} END"


def _payloads(spark, sf):
    o = load(spark, sf, "orders").selectExpr(
        "o_orderkey AS i", "o_custkey AS company_id", "concat('Engineer ', o_orderkey) AS t", "concat('https://x.example/', o_orderkey) AS u",
        "concat('Town', o_custkey % 50) AS l", "o_orderpriority AS d", "CASE WHEN o_orderkey % 2 = 0 THEN 'Full-time' ELSE 'Contract' END AS k",
        "cast(cast(o_orderdate AS DATE) AS STRING) AS p")
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("i") % len(_KINDS) + 1).cast("int"))
    # braces in the documents would read as parameters of spark.sql, so expr is used
    return o.select("company_id", kind.alias("ats_type"), F.concat(F.lit("c"), "company_id").alias("ats_identifier"),
                    F.col("i").alias("order_id"), F.expr(_payload_sql()).alias("body"))


@query("payload_jobs", f"""
    SELECT company_id, kind AS ats_type, t AS title,
      CASE kind WHEN 'lever' THEN concat('https://jobs.lever.co/c', company_id, '/', i) WHEN 'ashby' THEN concat('https://jobs.ashbyhq.com/c', company_id, '/', i) ELSE concat('https://x.example/', i) END AS url,
      concat(l, CASE WHEN kind IN {_WITH_COUNTRY} THEN ', US' WHEN kind = 'eddy' THEN ', CA' ELSE '' END) AS location,
      CASE WHEN kind = 'greenhouse' THEN concat(d, ', Extra') ELSE d END AS department,
      CASE WHEN kind <> 'greenhouse' THEN k END AS type, CASE WHEN kind <> 'lever' THEN p END AS posted,
      CASE WHEN kind = 'lever' THEN concat('text ', i) END AS description,
      CASE kind WHEN 'gohire' THEN '50k' WHEN 'recruitcrm' THEN 'EUR 1,000 - 25,000' END AS salary
    FROM (SELECT o_orderkey AS i, o_custkey AS company_id, ({'[' + ', '.join(rx.lit(k) for k in _KINDS) + ']'})[1 + o_orderkey % {len(_KINDS)}] AS kind,
      concat('Engineer ', o_orderkey) AS t, concat('Town', o_custkey % 50) AS l, o_orderpriority AS d,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Full-time' ELSE 'Contract' END AS k, strftime(o_orderdate, '%Y-%m-%d') AS p FROM orders)""")
def payload_jobs(spark, sf):
    return ex.extract_payload_jobs(_payloads(spark, sf)).select(
        "company_id", "ats_type", "title", "url", "location", "department", "type", "posted", "description", "salary")


# JSON-LD added to whole pages: single object, list, and graph with nested list items
_LD = """concat(html, '<script type="application/ld+json">', CASE page_id % 4
    WHEN 0 THEN concat('{"@type":"JobPosting","title":"Job ', page_id, '","datePosted":"2024-01-02","jobLocation":{"address":{"addressLocality":"Town","addressCountry":"US"}},"baseSalary":{"currency":"USD","value":{"minValue":1000,"maxValue":2000}}}')
    WHEN 1 THEN concat('[{"@type":"Organization"},{"@type":"JobPosting","name":"Job ', page_id, '","url":"https://x.example/', page_id, '","jobLocation":"Remote"}]')
    WHEN 2 THEN concat(repeat('{"@graph":[', page_id % 9), '{"@type":"ItemList","itemListElement":[{"@type":"JobPosting","title":"Job ', page_id, '","jobLocation":[{"address":"Main St"},{"name":"No"}]},{"@type":"JobPosting"}]}', repeat(']}', page_id % 9))
    ELSE '{broken' END, '</script>')"""


def _ld_pages(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url", F.expr(_LD).alias("html"))


@query("jsonld_jobs", """
    SELECT page_id, 'Job ' || page_id AS title, CASE WHEN page_id % 4 = 1 THEN 'https://x.example/' || page_id ELSE url END AS url,
      CASE page_id % 4 WHEN 0 THEN 'Town, US' WHEN 1 THEN 'Remote' ELSE 'Main St' END AS location,
      CASE WHEN page_id % 4 = 0 THEN '2024-01-02' END AS posted, CASE WHEN page_id % 4 = 0 THEN 'USD 1,000 - 2,000' END AS salary
    FROM pages WHERE page_id % 4 <> 3""")
def jsonld_jobs(spark, sf):
    return ex.extract_jsonld(_ld_pages(spark, sf)).select("page_id", "title", "url", "location", "posted", "salary")


# whole pages with a careers block in front: cards, links, repeated blocks, or nothing
_SITE = """concat(CASE page_id % 4
    WHEN 0 THEN concat('<div class="job"><h3>Engineer ', page_id, '</h3><span class="location">Town</span><a href="/jobs/', page_id, '">More</a></div>')
    WHEN 1 THEN concat('<nav><a href="/jobs/no">Nav Engineer</a></nav><a href="/careers/dev-', page_id, '">Developer role</a><a href="/jobs/all">View all jobs</a>')
    ELSE '' END, html)"""


@query("generic_jobs", """
    SELECT page_id, 'cards' AS strategy, 'Engineer ' || page_id AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/jobs/' || page_id AS url, 'Town' AS location FROM pages WHERE page_id % 4 = 0
    UNION ALL SELECT page_id, 'links', 'Developer role', regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/careers/dev-' || page_id, NULL FROM pages WHERE page_id % 4 = 1""")
def generic_jobs(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url", F.expr(_SITE).alias("html"))
    return dom.extract_generic(p).select("page_id", "strategy", "title", "url", "location")


@query("board_html_jobs", """
    SELECT page_id, title, url, location, department, type FROM (
      SELECT page_id, 'Lead ' || page_id AS title, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/p/' || page_id AS url, 'Town' AS location, 'Ops' AS department,
        CASE page_id % 4 WHEN 1 THEN 'Full' WHEN 3 THEN 'Full' END AS type FROM pages)""")
def board_html_jobs(spark, sf):
    card = """concat(CASE page_id % 4
        WHEN 0 THEN concat('<div class="job-card"><h2>Lead ', page_id, '</h2><a href="/p/', page_id, '">x</a><i class="location">Town</i><b class="department">Ops</b></div>')
        WHEN 1 THEN concat('<div class="posting"><h5>Lead ', page_id, '</h5><a class="posting-btn" href="/p/', page_id, '">x</a><i class="location">Town</i><b class="department">Ops</b><u class="commitment">Full</u></div>')
        WHEN 2 THEN concat('<div class="ashby-JobPosting-x"><h3>Lead ', page_id, '</h3><a href="/p/', page_id, '">x</a><i class="a-location">Town</i><b class="my-team">Ops</b></div>')
        ELSE concat('<div class="opening"><h4>Lead ', page_id, '</h4><a href="/p/', page_id, '">x</a><i class="job-location">Town</i><b class="department">Ops</b><u class="type">Full</u></div>') END, html)"""
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' ELSE 'smartrecruiters' END")
    p = load(spark, sf, "pages").select("page_id", "url", kind.alias("ats_type"), F.expr(card).alias("html"))
    return dom.extract_board_html(p).select("page_id", "title", "url", "location", "department", "type")


@query("script_jobs", """
    SELECT page_id, 'Role ' || page_id AS title, 'https://x.example/' || page_id AS url FROM pages WHERE page_id % 2 = 0""")
def script_jobs(spark, sf):
    block = """concat(html, CASE WHEN page_id % 2 = 0 THEN concat('<script>var jobList = [{"title":"Role ', page_id, '","tags":["x]",["y"]],"url":"https://x.example/', page_id, '"}]; var other = [1];</script>') ELSE '' END)"""
    p = load(spark, sf, "pages").select("page_id", F.lit("jobvite").alias("ats_type"), F.expr(block).alias("html"))
    return ex.extract_script_jobs(p).select("page_id", "title", "url")


@query("extract_jobs", cte("companies") + """
    SELECT p.page_id, CASE WHEN p.page_id % 2 = 0 AND coalesce(c.ats_type, 'generic') IN ('generic', 'greenhouse', 'custom') THEN 'cards' ELSE 'jsonld' END AS strategy,
      'Job ' || p.page_id AS title FROM pages p LEFT JOIN b_companies c ON c.id = p.page_id
    UNION ALL SELECT -id, 'payload', 'Job C' || id FROM b_companies WHERE ats_type IN ('greenhouse', 'lever', 'ashby')""")
def extract_jobs(spark, sf):
    # whole pages with a card or a script in front, and one JSON document per company on a platform
    html = """concat('<script type="application/ld+json">{"@type":"JobPosting","title":"Job ', page_id, '"}</script>',
        CASE WHEN page_id % 2 = 0 THEN concat('<div class="opening"><a href="/1">Job ', page_id, '</a></div>') ELSE '' END, html)"""
    pages = load(spark, sf, "pages").select("page_id", F.col("page_id").alias("company_id"), "url", F.expr(html).alias("html"))
    c = bind(spark, sf, "companies")
    body = """CASE ats_type WHEN 'lever' THEN concat('[{"text":"Job C', id, '"}]') ELSE concat('{"jobs":[{"title":"Job C', id, '"}]}') END"""
    docs = c.filter("ats_type IN ('greenhouse', 'lever', 'ashby')").select(
        (-F.col("id")).alias("page_id"), F.col("id").alias("company_id"), F.col("careers_url").alias("url"), F.expr(body).alias("html"))
    return ex_jobs(pages.unionByName(docs), c)


def ex_jobs(s, c):
    jobs, _ = dom.extract_jobs(s, c)
    return jobs.select("page_id", "strategy", "title")


_LINKED = """concat(html, '<a href="https://www.partner', page_id % 40, '.com/x?y=1">P</a> <a href=http://static.cdn.com/a>S</a><a href="https://twitter.com/z">T</a>
    <a href="/careers/open">We hire</a><a href="https://a.example.com/jobs/', page_id, '">J</a><a href="https://jobs.lever.co/Team-', page_id, '">L</a> boards.greenhouse.io/embed boards.greenhouse.io/co', page_id, ' ')"""


def _linked(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url", F.expr(_LINKED).alias("html"))


@query("outbound_links", """
    SELECT page_id::VARCHAR AS source, 'partner' || (page_id % 40) || '.com' AS domain, 'https://www.partner' || (page_id % 40) || '.com/x?y=1' AS url FROM pages
    UNION ALL SELECT page_id::VARCHAR, 'a.example', 'https://a.example' FROM pages
    UNION ALL SELECT page_id::VARCHAR, 'jobs.lever', 'https://jobs.lever' FROM pages""")
def outbound_links(spark, sf):
    return ex.outbound_links(_linked(spark, sf).withColumn("source", F.col("page_id").cast("string"))).select("source", "domain", "url")


@query("page_links", """
    SELECT page_id, o || '/careers/open' AS careers, 'https://a.example.com/jobs/' || page_id AS jobs
    FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o FROM pages)""")
def page_links(spark, sf):
    return _linked(spark, sf).select("page_id", ex.careers_link("html", "url").alias("careers"),
                                     F.array_join(ex.job_links("html", "url"), "|").alias("jobs"))


@query("board_links", """
    SELECT page_id, 'lever' AS ats_type, 'Team-' || page_id AS ats_identifier, 'https://jobs.lever.co/Team-' || page_id AS careers_url, 'Team ' || page_id AS name FROM pages
    UNION ALL SELECT page_id, 'greenhouse', 'co' || page_id, 'https://boards.greenhouse.io/co' || page_id, 'Co' || page_id FROM pages""")
def board_links(spark, sf):
    return sd.read_aggregator_pages(_linked(spark, sf)).select("page_id", "ats_type", "ats_identifier", "careers_url", "name")


@query("new_outbound", cte("companies") + """
    SELECT 'partner' || k || '.com' AS domain, n AS mentions FROM (SELECT page_id % 40 AS k, count(*) AS n FROM pages GROUP BY 1)
    UNION ALL SELECT 'a.example', count(*) FROM pages UNION ALL SELECT 'jobs.lever', count(*) FROM pages""")
def new_outbound(spark, sf):
    from ..operators.joins import new_outbound as op

    links = ex.outbound_links(_linked(spark, sf).withColumn("source", F.col("page_id").cast("string")))
    return op(links, bind(spark, sf, "companies")).select("domain", "mentions")


@query("news_companies", """
    SELECT 'Firm' || k AS name, min(link) AS source_url, 'funding_news_' || arg_min(f, link) AS source, first(s ORDER BY link) AS funding_stage FROM (
      SELECT user_id AS k, 'https://news.example/' || lpad(event_id::VARCHAR, 8, '0') AS link, event_type AS f,
             CASE WHEN event_id % 2 = 0 THEN 'Series A' END AS s FROM events WHERE event_id % 3 < 2 AND ts > TIMESTAMP '2024-01-01') GROUP BY k""")
def news_companies(spark, sf):
    items = load(spark, sf, "events").selectExpr(
        "CASE event_id % 3 WHEN 0 THEN concat('Firm', user_id, ' raises $', event_id, ' million') WHEN 1 THEN concat('Report: $12.5 million for Firm', user_id) ELSE concat('Firm', user_id, ' hires a cook') END AS title",
        "CASE WHEN event_id % 2 = 0 THEN 'A Series A deal.' ELSE 'A deal.' END AS description",
        "concat('https://news.example/', lpad(cast(event_id AS STRING), 8, '0')) AS link",
        "date_format(cast(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\") AS pub_date", "event_type AS feed_name")
    return ex.companies_from_news(items, AS_OF_EVENTS).select("name", "source_url", "source", "funding_stage")


@query("page_descriptions", f"""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'We build "things" ' || repeat('and more ', 15) || 'now.' ELSE {_ARTICLE} END AS json_text,
      CASE page_id % 3 WHEN 0 THEN '2024-01-05 00:00:00' WHEN 1 THEN '2024-01-06 00:00:00' END AS posted FROM pages""")
def page_descriptions(spark, sf):
    html = """concat(CASE page_id % 3 WHEN 0 THEN concat('{"description": "<p>We build \\\\"things\\\\"</p>', repeat('and more ', 15), '<b>now.</b>", "datePosted": "2024-01-05"}')
        WHEN 1 THEN 'Posted: 2024-01-06 ' ELSE '' END, html)"""
    p = load(spark, sf, "pages").select("page_id", F.expr(html).alias("html"))
    return p.select("page_id", cr.page_description(F.col("html")).alias("json_text"),
                    iso(cr.page_posted(F.col("html"))).alias("posted"))


@query("enrich_outcomes", cte("jobs", "companies") + """
    SELECT j.id, CASE WHEN c.ats_type = 'greenhouse' AND j.location_type = 'remote' THEN 'delisted' WHEN c.ats_type = 'greenhouse' AND j.location_type = 'hybrid' THEN 'enriched'
      WHEN c.ats_type = 'lever' AND j.role_specialization IS NULL THEN 'enriched' ELSE 'failed' END AS outcome
    FROM b_jobs j JOIN b_companies c ON c.id = j.company_id WHERE j.is_active AND coalesce(j.description, '') = ''""")
def enrich_outcomes(spark, sf):
    jobs = bind(spark, sf, "jobs").withColumn("enrich_failed_at", F.lit(None).cast("timestamp"))
    c = bind(spark, sf, "companies")
    j = jobs.select("id", "source_url", "company_id", "location_type", "role_specialization").join(c.select(F.col("id").alias("company_id"), "ats_type", "ats_identifier"), "company_id")
    details = j.filter("ats_type = 'greenhouse' AND location_type IN ('remote', 'hybrid')").select(
        "ats_type", "ats_identifier", F.col("id").cast("string").alias("provider_job_id"), F.expr("CASE WHEN location_type = 'remote' THEN 404 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN location_type = 'hybrid' THEN concat('<p>Job ', id, '</p>') END").alias("description_html"), F.lit(None).cast("string").alias("published_at"))
    pages = j.filter("ats_type = 'lever' AND role_specialization IS NULL").select(
        F.col("source_url").alias("url"), F.lit(200).alias("status"), F.expr("concat('<article>', repeat('long text ', 20), id, '</article>')").alias("html"))
    _, o = cr.enrich(jobs, c, details, pages, AS_OF)
    return o


@query("embedding_text", cte("jobs") + """
    SELECT id, concat_ws(' ', upper(seniority[1]) || seniority[2:] || ' ' || title, nullif(description, ''), CASE WHEN len(skills) > 0 THEN 'Skills: ' || array_to_string(skills, ', ') END,
      'Role: ' || role_family, 'Specialization: ' || role_specialization, 'Work type: ' || location_type) AS embedding_text FROM b_jobs""")
def embedding_texts(spark, sf):
    return embedding_text(bind(spark, sf, "jobs")).select("id", "embedding_text")


# each step looks for the last space of the 200 characters before the limit
_CHUNKS = f"""
    WITH RECURSIVE c AS (
      SELECT doc_id, text, 0 AS start, 0 AS no FROM documents
      UNION ALL SELECT doc_id, text, CASE WHEN stop - 500 > start THEN stop - 500 ELSE stop END, no + 1 FROM (
        SELECT *, CASE WHEN start + 6000 < length(text) AND contains(substr(text, start + 5801, 200), ' ')
                 THEN start + 5800 + length(regexp_extract(substr(text, start + 5801, 200), '(?s)^(.*) ', 1)) ELSE start + 6000 END AS stop FROM c)
      WHERE length(text) > 6000 AND CASE WHEN stop - 500 > start THEN stop - 500 ELSE stop END < length(text)),
    p AS (SELECT doc_id, no, CASE WHEN length(text) <= 6000 THEN text ELSE regexp_replace(substr(text, start + 1,
        CASE WHEN start + 6000 < length(text) AND contains(substr(text, start + 5801, 200), ' ')
             THEN 5800 + length(regexp_extract(substr(text, start + 5801, 200), '(?s)^(.*) ', 1)) ELSE 6000 END), '^{_EDGE}|{_EDGE}$', '', 'g') END AS chunk FROM c)
    SELECT doc_id, no::BIGINT AS chunk_no, length(chunk) AS n_chars, md5(chunk) AS digest FROM p"""


@query("chunk_text", _CHUNKS)
def chunk_text(spark, sf):
    return em.chunk_text(load(spark, sf, "documents"), "doc_id", "text").select(
        "doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.length("chunk").cast("bigint").alias("n_chars"),
        F.md5("chunk").alias("digest"))


@query("embed_jobs", cte("jobs") + """
    SELECT id, 1::BIGINT AS chunks, 64::BIGINT AS dim, TRUE AS is_right FROM b_jobs WHERE is_active AND coalesce(description, '') <> ''""")
def embed_jobs(spark, sf):
    jobs = bind(spark, sf, "jobs").withColumn("embedding", F.lit(None).cast("array<float>"))
    out, _ = em.embed_jobs(jobs, dim=64)
    # the vector again from its definition, word by word and without Python
    h = F.crc32(F.col("word").cast("binary"))
    words = embedding_text(jobs).select("id", F.explode(F.filter(F.split(F.lower("embedding_text"), r"\s+"), lambda w: w != "")).alias("word"))
    parts = words.groupBy("id", (h % 64).alias("at")).agg(F.sum(F.when(h >= 2147483648, 1.0).otherwise(-1.0)).alias("x"))
    want = parts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("parts"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    near = F.forall(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.abs(
        F.get("embedding", i.cast("int")) - F.coalesce(F.try_element_at("parts", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)) < 1e-5)
    return out.join(want, "id", "left").select("id", F.col("chunks").cast("bigint").alias("chunks"), F.size("embedding").cast("bigint").alias("dim"), near.alias("is_right"))


# three equal blocks in front of whole pages
_BLOCKS = """concat('<div class="row"><h4>Role one</h4><a href="/r/1">Open</a></div><div class="row"><h4>Role two</h4><a href="/r/2">Open</a></div>',
    '<div class="row"><h4>Role three</h4><a href="/r/3">Open</a></div>', html)"""
_BODY = "regexp_replace(html, '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>', '', 'g')"
_ADDED = {"div": 3, "h4": 3, "a": 3}


def _blocked(spark, sf):
    return load(spark, sf, "pages").select("page_id", "url", F.expr(_BLOCKS).alias("html"))


@query("dom_elements", " UNION ALL ".join(f"""
    SELECT page_id, '{t}' AS tag, n, {'n' if t in ('h1', 'h2', 'h3', 'h4', 'a') else '0::BIGINT'} AS with_text
    FROM (SELECT page_id, {_ADDED.get(t, 0)} + len(regexp_extract_all({_BODY}, '<{t}[ >]')) AS n FROM pages) WHERE n > 0"""
    for t in ("div", "article", "section", "li", "h1", "h2", "h3", "h4", "a")))
def dom_elements(spark, sf):
    return dom.layout_elements(_blocked(spark, sf)).groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.count("text").alias("with_text"))


# a list of jobs in front of whole pages, with one that is old, a row that is no job, and advertisements inside
_LISTED = """concat('<section class="jobs n', page_id % 3, '"><ul class="list"><li class="job" data-id="', page_id, '"><a href="/j/', page_id, '"><b>Role</b> one</a><i class="ad">buy <b>now</b></i><span class="place">Rome ',
    page_id % 7, '</span></li><li class="job old" data-id="x"><a href="/j/old">Old</a></li><li>none</li><li data-id="y" class="new job"><a href="https://else">Out</a><h3>Role two</h3></li></ul></section>', html)"""
_SELECTORS = [("card", "section.jobs > ul li.job[data-id]:not(.old)"), ("title", "li.job > a[href^='/j/'], .job h3"), ("place", ".job .place"),
              ("menu", "nav ul > li > a[href]"), ("second", "nav li:nth-child(2) > a"), ("heading", "article > h1:first-child"), ("noise", ".ad", None, True)]
_UNESCAPED = "trim(regexp_replace(replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '\\s+', ' ', 'g'))"


def _listed(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.expr(_LISTED).alias("html"))


@query("select_elements", f"""
    WITH p AS (SELECT page_id, list_transform(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<li><a href="[^"]*">([^<]*)</a></li>', 1), lambda x: {_UNESCAPED}) AS menu,
        list_transform(regexp_extract_all(html, '<article><h1>([^<]*)</h1>', 1), lambda x: {_UNESCAPED}) AS heading FROM pages),
    r AS (SELECT page_id, 'menu' AS name, unnest(range(len(menu))) AS rank, 'a' AS tag, unnest(menu) AS text FROM p UNION ALL SELECT page_id, 'second', 0, 'a', menu[2] FROM p WHERE len(menu) > 1
      UNION ALL SELECT page_id, 'heading', unnest(range(len(heading))), 'h1', unnest(heading) FROM p
      UNION ALL SELECT page_id, 'card', 0, 'li', 'Role one Rome ' || (page_id % 7) FROM p UNION ALL SELECT page_id, 'card', 1, 'li', 'Out Role two' FROM p
      UNION ALL SELECT page_id, 'title', 0, 'a', 'Role one' FROM p UNION ALL SELECT page_id, 'title', 1, 'a', 'Old' FROM p UNION ALL SELECT page_id, 'title', 2, 'h3', 'Role two' FROM p
      UNION ALL SELECT page_id, 'place', 0, 'span', 'Rome ' || (page_id % 7) FROM p)
    SELECT page_id, name, rank::INTEGER AS rank, tag, text FROM r""")
def select_elements(spark, sf):
    table = sl.compile_selectors(spark, _SELECTORS)
    return sl.explode_dom(_listed(spark, sf), table).select("page_id", "name", "rank", "tag", "text")


@query("select_cards", """
    SELECT page_id, 0 AS rank, 'Role one' AS title, 'Rome ' || (page_id % 7) AS place, '/j/' || page_id AS href FROM pages
    UNION ALL SELECT page_id, 1, 'Role two', NULL, NULL FROM pages""")
def select_cards(spark, sf):
    table = sl.compile_selectors(spark, _SELECTORS)
    return sl.explode_cards(_listed(spark, sf), table, "card", "title", "place").select("page_id", "rank", "title", "place", F.col("title_href").alias("href"))


@query("repeated_blocks", "SELECT page_id, 'row|h4,a' AS signature, 3::BIGINT AS n FROM pages")
def repeated_blocks(spark, sf):
    e = dom.layout_elements(_blocked(spark, sf)).filter(F.col("signature").isNotNull())
    return ag.repeated_blocks(e).groupBy("page_id", "signature").agg(F.count("*").alias("n"))


def _lines(html: str) -> str:
    """SQL: text lines between the tags of a page."""
    text = "replace(replace(replace(regexp_replace(x, '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"')"
    return (f"list_filter(list_transform(string_split_regex({html}, '<[^>]*>'), lambda x: trim(regexp_replace({text}, '{_EDGE}', ' ', 'g'))), "
            "lambda x: x <> '')")


@query("page_text", f"""
    SELECT page_id, array_to_string({_lines("regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1)")}, ' ') AS main_text FROM pages""")
def page_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.replace(dom.main_content("html"), F.lit("\n"), F.lit(" ")).alias("main_text"))


@query("simplify_html", f"""
    SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, array_to_string({_lines(
        "regexp_replace(html, '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '<x>', 'g')")}, chr(10)) AS t FROM pages)""")
def simplify_html(spark, sf):
    p = load(spark, sf, "pages").select("page_id", dom.simplify_html("html").alias("t"))
    return p.select("page_id", F.length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query("directory_companies", """
    SELECT c_name AS name, 'https://c' || c_custkey || '.com' AS website_url, CASE WHEN c_custkey % 2 = 0 THEN 'Austin, TX' ELSE 'Paris' END AS location,
      CASE WHEN c_custkey % 2 = 0 THEN 'US' END AS country, CASE WHEN c_custkey % 3 = 0 THEN 'ai, b2b' ELSE 'Robots' END AS industry, 'W' || (c_custkey % 20) AS funding_stage
    FROM customer WHERE c_mktsegment <> 'BUILDING'
    UNION ALL SELECT s_name, NULL, NULL, NULL, NULL, NULL FROM supplier""")
def directory_companies(spark, sf):
    # braces and quotes are built with to_json, one document per company
    c = load(spark, sf, "customer")
    rec = F.struct(F.col("c_name").alias("name"), F.expr("concat('https://c', c_custkey, '.com')").alias("website"),
                   F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Austin, TX' ELSE 'Paris' END").alias("location"),
                   F.expr("CASE WHEN c_custkey % 3 <> 0 THEN 'Robots' END").alias("industry"), F.array(F.lit("ai"), F.lit("b2b")).alias("tags"),
                   F.expr("concat('W', c_custkey % 20)").alias("batch"), F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN 'Inactive' ELSE 'Active' END").alias("status"))
    body = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.array(rec).alias("companies")))).otherwise(
        F.to_json(F.struct(F.struct(F.struct(F.array(rec).alias("companies")).alias("pageProps")).alias("props"))))
    docs = c.select(F.lit("https://dir.example/list").alias("url"), body.alias("body"))
    html = load(spark, sf, "supplier").select(F.lit("https://dir.example/list").alias("url"), F.concat(
        F.lit('<a href="/companies/s">'), "s_name", F.lit('</a><a href="/companies/all">View</a>')).alias("body"))
    return sd.read_directory(docs.unionByName(html)).select("name", "website_url", "location", "country", "industry", "funding_stage")


@query("org_companies", """
    SELECT c_name AS name, 'https://c' || c_custkey || '.com' AS website_url, CASE WHEN c_custkey % 2 = 0 THEN 'US' END AS country FROM customer
    WHERE c_custkey % 10 >= 3 AND c_mktsegment <> 'MACHINERY'""")
def org_companies(spark, sf):
    rec = F.struct(F.col("c_name").alias("login"), F.expr("concat('c', c_custkey, '.com')").alias("blog"), F.expr("CAST(c_custkey % 10 AS INT)").alias("public_repos"),
                   F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'Boston' ELSE 'Oslo' END").alias("location"),
                   F.expr("CASE WHEN c_mktsegment = 'MACHINERY' THEN 'A research lab' ELSE 'Tools' END").alias("description"))
    return sd.read_orgs(load(spark, sf, "customer").select(F.to_json(rec).alias("body"))).select("name", "website_url", "country")


@query("search_companies", """
    SELECT 'Firm ' || p_partkey AS name, 'firm' || p_partkey || '.com' AS domain, CASE WHEN p_partkey % 3 = 1 THEN 'https://www.firm' || p_partkey || '.com/careers' END AS careers_url
    FROM part WHERE p_partkey % 3 < 2""")
def search_companies(spark, sf):
    h = load(spark, sf, "part").selectExpr(
        "CASE p_partkey % 3 WHEN 0 THEN concat('https://firm', p_partkey, '.com/about') WHEN 1 THEN concat('https://www.firm', p_partkey, '.com/careers') ELSE concat('https://linkedin.com/', p_partkey) END AS link",
        "concat('Firm ', p_partkey, ' - Careers | Site') AS title", "p_name AS snippet")
    return sd.read_search_results(h).select("name", "domain", "careers_url")


@query("embedded_companies", """
    SELECT page_id, 'Co ' || page_id AS name, 'co' || page_id || '.com' AS domain, 'lever' AS ats_type, 'co' || page_id AS ats_identifier FROM pages WHERE page_id % 2 = 0""")
def embedded_companies(spark, sf):
    state = F.expr("""concat(html, '<script>window.__INITIAL_STATE__ = {"companies":{"items":[{"name":"Co ', page_id, '","website":"https://www.co', page_id, '.com",',
        CASE WHEN page_id % 2 = 0 THEN '"jobsUrl"' ELSE '"other"' END, ':"https://jobs.lever.co/co', page_id, '"}]}};</script>')""")
    return sd.read_embedded_state(load(spark, sf, "pages").select("page_id", state.alias("html"))).select("page_id", "name", "domain", "ats_type", "ats_identifier")


@query("harvest_boards", """
    SELECT DISTINCT 'team' || (doc_id % 77) AS board FROM documents""")
def harvest_boards(spark, sf):
    body = F.concat("text", F.lit(" https://boards.greenhouse.io/Team"), F.col("doc_id") % 77, F.lit(" boards.greenhouse.io/embed/x"))
    return sd.harvest_boards(load(spark, sf, "documents").select(body.alias("body")))


@query("fetch_list", cte("companies") + """
    SELECT id AS company_id, ats_type FROM b_companies WHERE is_active AND careers_url IS NOT NULL""")
def fetch_list(spark, sf):
    return st.fetch_list(bind(spark, sf, "companies")).select("company_id", "ats_type")
