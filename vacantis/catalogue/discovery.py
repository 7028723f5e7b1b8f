"""Discovery, detection, crawl and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, AS_OF_EVENTS, PLACES, bind, cte, load, pick
from ..functions import text as tx
from ..functions.core import iso
from ..operators import aggregates as ag, joins as jn
from ..plans import analytics as an, crawl as cr, detect as de, discover as di
from . import query, rx
from .classifiers import _us_sql

_T = f"TIMESTAMP '{AS_OF}'"

# b_discovered with the derived domain
_FOUND = cte("discovered", "companies", "queue") + """, known AS (
      SELECT lower(domain) AS domain FROM b_companies WHERE domain IS NOT NULL
      UNION SELECT lower(domain) FROM b_queue WHERE status IN ('pending', 'processing')),
    d AS (SELECT *, regexp_replace(coalesce(regexp_extract(lower(website_url), '^[a-z]+://([^/]+)', 1),
          CASE WHEN careers_url NOT LIKE '%greenhouse%' THEN regexp_extract(careers_url, '^[a-z]+://([^/]+)', 1) END), '^www\\.', '') AS domain FROM b_discovered)"""


@query("drop_known", _FOUND + """
    SELECT source, count(*) AS n FROM d WHERE domain IS NULL OR domain NOT IN (SELECT domain FROM known) GROUP BY 1""")
def drop_known(spark, sf):
    d = bind(spark, sf, "discovered").withColumn("domain", tx.derive_domain("website_url", "careers_url"))
    return jn.drop_known(d, bind(spark, sf, "companies"), bind(spark, sf, "queue")).groupBy("source").agg(F.count("*").alias("n"))


_ROUTED = _FOUND + f""", r AS (
      SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source_rank, discovered_at, row_id) AS rn FROM d),
    o AS (SELECT row_id, source, domain, CASE
        WHEN domain IS NOT NULL AND (rn > 1 OR domain IN (SELECT domain FROM known)) THEN 'duplicate'
        WHEN NOT coalesce(CASE WHEN country = 'US' THEN TRUE WHEN coalesce(location, '') <> '' THEN {_us_sql('location')} ELSE FALSE END, FALSE) THEN 'non_us'
        WHEN domain IS NOT NULL AND careers_url IS NOT NULL THEN 'new' WHEN careers_url IS NULL THEN 'queued' ELSE 'duplicate' END AS outcome FROM r)"""


@query("discover_outcomes", _ROUTED + " SELECT row_id, domain, outcome FROM o")
def discover_outcomes(spark, sf):
    return di.route(bind(spark, sf, "discovered"), bind(spark, sf, "companies"), bind(spark, sf, "queue")).select("row_id", "domain", "outcome")


@query("discover_summary", _ROUTED + """
    SELECT source, count(*) AS total, count(*) FILTER (WHERE outcome = 'new') AS new, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE outcome = 'non_us') AS non_us, count(*) FILTER (WHERE outcome = 'queued') AS queued,
           0::BIGINT AS updated, 0::BIGINT AS error FROM o GROUP BY 1""")
def discover_summary(spark, sf):
    _, _, routed = di.discover(bind(spark, sf, "discovered"), bind(spark, sf, "companies"), bind(spark, sf, "queue"), AS_OF_EVENTS)
    return ag.run_summary(routed)


# queue with some domains that are companies, some repeats, some without a domain
_QUEUE = """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 < 3 THEN concat('customer', user_id, '.com') ELSE concat('u', event_id % 300, '.net') END AS domain,
    concat('User ', user_id) AS name, event_type AS source, CASE WHEN event_id % 4 = 0 THEN concat('https://jobs.lever.co/u', user_id) END AS careers_url,
    CAST(NULL AS {s}) AS ats_type, CAST(NULL AS {s}) AS ats_identifier, CASE WHEN event_type = 'error' THEN 'completed' ELSE 'pending' END AS status,
    CAST(NULL AS {s}) AS error_message, CAST(event_id % 5 AS INT) AS retry_count, CAST(ts AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS processed_at FROM events"""


def _queue(spark, sf):
    return spark.sql(_QUEUE.format(s="STRING").replace("FROM events", "FROM {events}"), events=load(spark, sf, "events"))


_PROCESSED = cte("companies") + ", q AS (" + _QUEUE.format(s="VARCHAR") + """),
    p AS (SELECT q.*, c.company_id, row_number() OVER (PARTITION BY q.domain ORDER BY q.created_at, q.id) AS rn FROM q
          LEFT JOIN (SELECT domain, min(id) AS company_id FROM b_companies WHERE domain IS NOT NULL GROUP BY 1) c ON c.domain = q.domain WHERE status = 'pending'),
    o AS (SELECT *, CASE WHEN company_id IS NOT NULL THEN 'updated' WHEN domain IS NOT NULL THEN CASE WHEN rn = 1 THEN 'created' ELSE 'updated' END
            WHEN careers_url IS NOT NULL THEN 'created' ELSE 'review' END AS outcome FROM p)"""


@query("process_queue", _PROCESSED + """
    SELECT id, outcome, CASE WHEN outcome = 'review' THEN 'review' ELSE 'completed' END AS status,
           CASE WHEN careers_url IS NOT NULL THEN 'lever' END AS found_type FROM o""")
def process_queue(spark, sf):
    return di.process_queue(_queue(spark, sf), bind(spark, sf, "companies"), None, AS_OF_EVENTS).select("id", "outcome", "status", "found_type")


@query("apply_queue", _PROCESSED + """, f AS (SELECT company_id, arg_min(careers_url, id) AS u FROM o WHERE company_id IS NOT NULL AND careers_url IS NOT NULL GROUP BY 1)
    SELECT c.id, coalesce(nullif(c.careers_url, ''), f.u) AS careers_url, coalesce(c.ats_type, CASE WHEN f.u IS NOT NULL THEN 'lever' END) AS ats_type
    FROM b_companies c LEFT JOIN f ON f.company_id = c.id""")
def apply_queue(spark, sf):
    q, c = _queue(spark, sf), bind(spark, sf, "companies")
    _, after = di.apply_queue(q, c, di.process_queue(q, c, None, AS_OF_EVENTS))
    return after.select("id", "careers_url", "ats_type")


@query("fail_items", cte("queue") + """
    SELECT id, CASE WHEN source = 'error' THEN CASE WHEN retry_count >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status,
           (CASE WHEN source = 'error' THEN retry_count + 1 ELSE retry_count END)::BIGINT AS retry_count FROM b_queue""")
def fail_items(spark, sf):
    q = bind(spark, sf, "queue")
    bad = q.filter("source = 'error'").select("id", F.lit("boom").alias("error"))
    return di.fail_items(q, bad, AS_OF_EVENTS).select("id", "status", F.col("retry_count").cast("bigint").alias("retry_count"))


@query("apply_reviews", cte("queue") + """
    SELECT id, CASE WHEN id % 2 = 0 AND status = 'review' THEN 'pending' WHEN id % 7 = 1 THEN 'skipped' ELSE status END AS status,
           CASE WHEN id % 2 = 0 AND status = 'review' THEN 'https://ok.example' ELSE careers_url END AS careers_url FROM b_queue""")
def apply_reviews(spark, sf):
    q = bind(spark, sf, "queue")
    d = q.select(
        "id", F.expr("CASE WHEN id % 2 = 0 AND status = 'review' THEN 'approve' WHEN id % 7 = 1 THEN 'reject' ELSE 'wait' END").alias("decision"),
        F.lit("https://ok.example").alias("careers_url"), F.lit(None).cast("string").alias("reason"))
    return di.apply_reviews(q, d).select("id", "status", "careers_url")


@query("bulk_load", cte("companies") + """
    , n AS (SELECT s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN concat('customer', s_suppkey, '.io') ELSE concat('bulk', s_nationkey, '.com') END AS domain FROM supplier),
    k AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY name) AS rn FROM n),
    m AS (SELECT * FROM k WHERE (domain IS NULL OR rn = 1) AND (domain IS NULL OR domain NOT IN (SELECT domain FROM b_companies WHERE domain IS NOT NULL)))
    SELECT (SELECT count(*) FROM n) AS total, (SELECT count(*) FROM m) AS created, (SELECT count(*) FROM n) - (SELECT count(*) FROM m) AS skipped""")
def bulk_load(spark, sf):
    rows = load(spark, sf, "supplier").selectExpr(
        "s_name AS name", "CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN concat('customer', s_suppkey, '.io') ELSE concat('bulk', s_nationkey, '.com') END AS domain")
    _, counts = di.bulk_load(bind(spark, sf, "companies"), rows)
    return counts


_SEED = "SELECT concat('customer', c_custkey, '.com') AS domain, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'greenhouse' ELSE 'lever' END AS ats_type, concat('customer', c_custkey) AS ats_identifier, concat('https://www.customer', c_custkey, '.com/careers') AS careers_url FROM customer"


@query("seed_companies", cte("companies") + f""", s AS ({_SEED})
    SELECT CASE WHEN c.domain IS NULL THEN 'created' WHEN c.ats_type IS DISTINCT FROM s.ats_type OR c.ats_identifier IS DISTINCT FROM s.ats_identifier
        OR c.careers_url IS DISTINCT FROM s.careers_url THEN 'updated' ELSE 'skipped' END AS outcome, count(*) AS count
    FROM s LEFT JOIN b_companies c ON c.domain = s.domain GROUP BY 1""")
def seed_companies(spark, sf):
    s = spark.sql(_SEED.replace("FROM customer", "FROM {customer}"), customer=load(spark, sf, "customer"))
    _, counts = di.seed_companies(bind(spark, sf, "companies"), s)
    return counts


@query("sync_candidates", """
    SELECT waitlist_id, name, CASE waitlist_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'design' ELSE 'other' END AS families, min_salary FROM (
      SELECT s_suppkey AS waitlist_id, s_name AS name, CAST(floor(s_acctbal) AS BIGINT) AS min_salary FROM supplier)""")
def sync_candidates(spark, sf):
    s = load(spark, sf, "supplier")
    wl = s.selectExpr("s_suppkey AS id", "s_name AS name", "concat(s_suppkey, '@x.example') AS email")
    det = s.selectExpr("s_suppkey AS waitlist_id", "CASE s_suppkey % 3 WHEN 0 THEN 'Data Science' WHEN 1 THEN 'UX Research' ELSE 'Knitting' END AS field",
                       "'senior' AS seniority", "CAST(floor(s_acctbal) AS BIGINT) AS expected_pay", "'US' AS country", "array('remote') AS work_type", "array('permanent') AS role_type")
    target = s.filter("s_acctbal > 3000").selectExpr("cast(s_suppkey AS STRING) AS id", "s_suppkey AS waitlist_id", "'old' AS name", "array('legal') AS role_families", "CAST(1 AS BIGINT) AS min_salary")
    return di.sync_candidates(target, wl, det, AS_OF).select("waitlist_id", "name", F.array_join("role_families", "|").alias("families"), "min_salary")


@query("link_parents", cte("companies") + """, r AS (SELECT id AS company_id, CASE WHEN id % 3 = 0 THEN 'www.customer' || (id + 1) || '.io' ELSE 'gm' || (id % 40) || '.net' END AS parent_domain FROM b_companies)
    SELECT r.company_id, p.id AS parent_company_id FROM r LEFT JOIN (SELECT domain, min(id) AS id FROM b_companies WHERE domain IS NOT NULL GROUP BY 1) p
    ON p.domain = regexp_replace(r.parent_domain, '^www\\.', '')""")
def link_parents(spark, sf):
    c = bind(spark, sf, "companies")
    r = c.select(F.col("id").alias("company_id"), F.expr("CASE WHEN id % 3 = 0 THEN concat('www.customer', id + 1, '.io') ELSE concat('gm', id % 40, '.net') END").alias("parent_domain"))
    linked, _ = jn.link_parents(c, r)
    return linked.select("company_id", "parent_company_id")


@query("parent_stubs", cte("companies") + """
    SELECT DISTINCT 'gm' || (id % 40) || '.net' AS domain, CASE WHEN length('gm' || (id % 40)) <= 3 THEN upper('gm' || (id % 40)) ELSE 'Gm' || (id % 40) END AS name FROM b_companies""")
def parent_stubs(spark, sf):
    c = bind(spark, sf, "companies")
    r = c.select(F.col("id").alias("company_id"), F.expr("concat('gm', id % 40, '.net')").alias("parent_domain"))
    _, stubs = jn.link_parents(c, r)
    return stubs.select("domain", "name")


@query("reconcile", cte("jobs", "live") + """, s AS (SELECT id, company_id, regexp_replace(lower(regexp_replace(source_url, '/+$', '')), '\\?.*$', '') AS k FROM b_jobs WHERE is_active),
    l AS (SELECT DISTINCT company_id, regexp_replace(lower(regexp_replace(source_url, '/+$', '')), '\\?.*$', '') AS k FROM b_live)
    SELECT coalesce(s.company_id, l.company_id) AS company_id, coalesce(s.k, l.k) AS listing_key, s.id AS job_id,
      CASE WHEN s.id IS NULL THEN 'new' WHEN l.k IS NULL THEN 'delist' ELSE 'verify' END AS status
    FROM s FULL JOIN l ON s.company_id = l.company_id AND s.k = l.k""")
def reconcile(spark, sf):
    return jn.reconcile(bind(spark, sf, "jobs"), bind(spark, sf, "live")).select("company_id", "listing_key", "job_id", "status")


_MAINTAIN = cte("jobs", "live", "companies") + """, ok AS (SELECT id AS company_id FROM b_companies WHERE is_active AND id % 4 <> 3
      AND (coalesce(ats_type, '') <> 'custom' OR id IN (SELECT company_id FROM b_live))),
    s AS (SELECT j.id, j.company_id, regexp_replace(lower(j.source_url), '\\?.*$', '') AS k FROM b_jobs j JOIN ok USING (company_id) WHERE is_active),
    l AS (SELECT DISTINCT company_id, regexp_replace(lower(regexp_replace(source_url, '/+$', '')), '\\?.*$', '') AS k FROM b_live JOIN ok USING (company_id)),
    r AS (SELECT coalesce(s.company_id, l.company_id) AS company_id, s.id, CASE WHEN s.id IS NULL THEN 'new' WHEN l.k IS NULL THEN 'delist' ELSE 'verify' END AS status
          FROM s FULL JOIN l ON s.company_id = l.company_id AND s.k = l.k)"""


def _status_fetches(spark, sf):
    return bind(spark, sf, "companies").select(F.col("id").alias("company_id"), F.when(F.col("id") % 4 == 3, 503).otherwise(200).alias("status"))


@query("maintain_jobs", _MAINTAIN + f"""
    SELECT j.id, j.is_active AND coalesce(r.status, '') <> 'delist' AS is_active, CASE WHEN r.status = 'delist' THEN 'removed_from_ats' ELSE j.delist_reason END AS delist_reason,
      CASE WHEN r.status = 'verify' THEN '{AS_OF}' ELSE strftime(j.last_verified_at, '%Y-%m-%d %H:%M:%S') END AS last_verified_at
    FROM b_jobs j LEFT JOIN r ON r.id = j.id""")
def maintain_jobs(spark, sf):
    out, _, _ = cr.maintain(bind(spark, sf, "jobs"), bind(spark, sf, "live"), bind(spark, sf, "companies"), _status_fetches(spark, sf), AS_OF)
    return out.select("id", "is_active", "delist_reason", iso("last_verified_at").alias("last_verified_at"))


@query("maintain_counts", _MAINTAIN + """
    SELECT company_id, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'verify') AS verified,
      count(*) FILTER (WHERE status = 'delist') AS delisted, count(*) FILTER (WHERE status = 'verify') AS unchanged FROM r GROUP BY 1""")
def maintain_counts(spark, sf):
    _, _, counts = cr.maintain(bind(spark, sf, "jobs"), bind(spark, sf, "live"), bind(spark, sf, "companies"), _status_fetches(spark, sf), AS_OF)
    return counts


@query("ingest_snapshots", cte("snapshots") + """
    SELECT id, CASE WHEN status_code <> 200 THEN 'failed' WHEN before IS NULL OR before <> html THEN 'changed' ELSE 'unchanged' END AS outcome FROM (
      SELECT * , lag(html) OVER (PARTITION BY company_id ORDER BY crawled_at, id) AS before FROM b_snapshots WHERE status_code = 200) WHERE crawled_at >= TIMESTAMP '2024-01-15'
    UNION ALL SELECT id, 'failed' FROM b_snapshots WHERE status_code <> 200 AND crawled_at >= TIMESTAMP '2024-01-15'""")
def ingest_snapshots(spark, sf):
    s = bind(spark, sf, "snapshots").withColumn("html_hash", tx.content_hash("html"))
    old = s.filter((F.col("crawled_at") < "2024-01-15") & (F.col("status_code") == 200))
    new = s.filter(F.col("crawled_at") >= "2024-01-15").withColumnRenamed("status_code", "status").withColumnRenamed("crawled_at", "fetched_at")
    c = s.select(F.col("company_id").alias("id")).distinct().withColumn("last_crawled_at", F.lit(None).cast("timestamp"))
    _, _, outcomes = cr.ingest_snapshots(new, old, c)
    return outcomes.select("id", "outcome")


# fetched careers pages of the companies: redirects, platform pages, foreign pages, nothing
_FETCH = """SELECT careers_url AS url, CASE id % 5 WHEN 0 THEN concat('https://jobs.lever.co/moved', id) WHEN 1 THEN concat('https://careers.bigparent.com/c', id) ELSE careers_url END AS final_url,
    CASE WHEN id % 5 = 4 THEN 404 ELSE 200 END AS status,
    CASE id % 5 WHEN 2 THEN '<a href="https://x.example/y">We use BambooHR.com</a>' WHEN 3 THEN concat('<a href="/jobs/one-', id, '">A</a><a href="/jobs/two-', id, '">B</a>') ELSE '<p>hello</p>' END AS html,
    CAST('2001-08-01' AS TIMESTAMP) AS fetched_at FROM companies WHERE careers_url IS NOT NULL
    UNION ALL SELECT concat('https://www.customer', id, '.com/jobs/two-', id), concat('https://boards.greenhouse.io/late', id), 200, '', CAST('2001-08-01' AS TIMESTAMP) FROM companies WHERE careers_url LIKE '%.com/careers'
    UNION ALL SELECT concat('https://', domain, '/jobs'), concat('https://jobs.ashbyhq.com/slug', id), 200, '', CAST('2001-08-01' AS TIMESTAMP) FROM companies WHERE careers_url IS NULL"""


def _fetches(spark, sf):
    return spark.sql(_FETCH.replace("FROM companies", "FROM {companies}"), companies=bind(spark, sf, "companies"))


_DETECT = cte("companies") + """, w AS (SELECT *, CASE WHEN careers_url LIKE '%/blog/%' THEN NULL ELSE careers_url END AS u, coalesce(ats_detection_attempts, 0) + 1 AS used
      FROM b_companies WHERE is_active AND ats_type IS NULL AND coalesce(ats_detection_attempts, 0) < 2),
    f AS (SELECT *, CASE
        WHEN u LIKE '%greenhouse%' THEN 'greenhouse' WHEN u LIKE '%lever%' THEN 'lever' WHEN u LIKE '%ashbyhq%' THEN 'ashby' WHEN u LIKE '%recruitee%' THEN 'recruitee' WHEN u LIKE '%icims%' THEN 'icims'
        WHEN u IS NOT NULL AND id % 5 = 0 THEN 'lever' WHEN u IS NOT NULL AND id % 5 = 2 THEN 'bamboohr' WHEN u IS NOT NULL AND id % 5 = 3 THEN 'greenhouse'
        WHEN careers_url IS NULL AND domain IS NOT NULL THEN 'ashby' END AS kind,
      CASE WHEN u LIKE '%.com/careers' AND id % 5 = 1 AND domain IS NOT NULL THEN 'bigparent.com' END AS parent FROM w)"""


@query("detect_ats", _DETECT + """
    SELECT id AS company_id, CASE WHEN kind IS NOT NULL THEN 'detected' WHEN parent IS NOT NULL THEN 'uses_parent_ats' WHEN used >= 2 THEN 'custom' ELSE 'retry' END AS outcome,
           kind AS ats_type, CASE WHEN kind IS NULL THEN parent END AS parent_domain, used::BIGINT AS attempts FROM f""")
def detect_ats(spark, sf):
    return de.detect_ats(bind(spark, sf, "companies"), _fetches(spark, sf)).select(
        "company_id", "outcome", "ats_type", "parent_domain", F.col("attempts").cast("bigint").alias("attempts"))


@query("apply_detection", _DETECT + """
    SELECT b.id, CASE WHEN f.id IS NULL THEN b.ats_type WHEN kind IS NOT NULL THEN kind WHEN parent IS NOT NULL THEN 'uses_parent_ats' WHEN used >= 2 THEN 'custom' END AS ats_type
    FROM b_companies b LEFT JOIN f ON f.id = b.id""")
def apply_detection(spark, sf):
    c = bind(spark, sf, "companies")
    return de.apply_detection(c, de.detect_ats(c, _fetches(spark, sf)), AS_OF).select("id", "ats_type")


@query("move_to_dormant", cte("companies", "dormant") + """, g AS (SELECT id FROM b_companies WHERE is_active AND coalesce(careers_url, '') = '' AND ats_type IS NULL
      AND (coalesce(website_url, '') = '' OR coalesce(ats_detection_attempts, 0) >= 2))
    SELECT 'company' AS kind, id, CASE WHEN is_active AND id NOT IN (SELECT id FROM g) THEN 'on' ELSE 'off' END AS state FROM b_companies
    UNION ALL SELECT 'dormant', CASE WHEN check_count = 0 THEN id ELSE -id END, dormant_reason FROM b_dormant
    UNION ALL SELECT 'dormant', id, 'no_careers_page' FROM g WHERE id NOT IN (SELECT id FROM b_dormant WHERE check_count = 0)""")
def move_to_dormant(spark, sf):
    c, d = de.move_to_dormant(bind(spark, sf, "companies"), bind(spark, sf, "dormant").withColumn(
        "id", F.expr("CASE WHEN check_count = 0 THEN id ELSE -id END")), "no_careers_page", AS_OF)
    a = c.select(F.lit("company").alias("kind"), "id", F.when(F.col("is_active"), "on").otherwise("off").alias("state"))
    return a.unionByName(d.select(F.lit("dormant").alias("kind"), "id", F.col("dormant_reason").alias("state")))


@query("recheck_dormant", cte("dormant", "companies") + f""", due AS (SELECT * FROM b_dormant WHERE last_checked_at IS NULL OR last_checked_at < {_T} - INTERVAL 30 DAY),
    woken AS (SELECT id FROM due WHERE dormant_reason = 'no_website')
    SELECT id, (check_count + CASE WHEN id IN (SELECT id FROM due) THEN 1 ELSE 0 END)::BIGINT AS check_count FROM b_dormant WHERE id NOT IN (SELECT id FROM woken)""")
def recheck_dormant(spark, sf):
    d = bind(spark, sf, "dormant")
    fetched = d.filter("dormant_reason = 'no_website'").select(F.concat(F.lit("https://"), "domain", F.lit("/careers")).alias("url"),
                                            F.concat(F.lit("https://jobs.lever.co/c"), "id").alias("final_url"), F.lit(200).alias("status"),
                                            F.lit("").alias("html"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"))
    _, after, _ = de.recheck_dormant(bind(spark, sf, "companies"), d, fetched, AS_OF)
    return after.select("id", F.col("check_count").cast("bigint").alias("check_count"))


@query("validate_ats", cte("companies", "jobs") + """, idle AS (SELECT * FROM b_companies c WHERE is_active AND ats_type IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM b_jobs j WHERE j.company_id = c.id AND j.is_active AND j.role_family = 'data'))
    SELECT id AS company_id, CASE WHEN id % 5 = 0 THEN 'invalid_identifier' WHEN country <> 'US' THEN 'not_crawled' WHEN location = '' THEN 'failed' ELSE 'ok' END AS verdict FROM idle""")
def validate_ats(spark, sf):
    c = bind(spark, sf, "companies").withColumn("ats_identifier", F.when(F.col("id") % 5 == 0, F.lit("${BOARD}")).otherwise(F.col("ats_identifier")))
    jobs = bind(spark, sf, "jobs").withColumn("is_active", F.expr("is_active AND role_family = 'data'"))
    outcomes = c.filter("country = 'US'").select(F.col("id").alias("company_id"), (F.col("location") != "").alias("success"), F.lit("http_404").alias("reason"))
    _, checked, _ = de.validate_ats(c, jobs, outcomes, AS_OF)
    return checked.select("company_id", "verdict")


@query("analytics_delisted", cte("jobs") + f"""
    SELECT strftime(updated_at, '%Y-%m-%d') AS date, count(*) AS value FROM b_jobs WHERE NOT is_active AND updated_at <> created_at
      AND updated_at >= {_T} - INTERVAL 90 DAY GROUP BY 1""")
def analytics_delisted(spark, sf):
    out = an.analytics(bind(spark, sf, "companies"), bind(spark, sf, "jobs"), bind(spark, sf, "snapshots"), AS_OF, days=90)
    return out["delisted_jobs_per_day"].withColumn("date", F.col("date").cast("string"))
