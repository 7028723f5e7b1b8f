"""Upsert, update, delete and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, AS_OF_EVENTS, bind, cte, load
from ..functions.core import iso
from ..operators import filters as fl, joins as jn, keyed as kt, sets as st, upserts as up
from ..session import new_folder
from . import ORACLES, query

_TS = "'%Y-%m-%d %H:%M:%S'"

_CHANGES = """
    SELECT o_custkey AS company_id, CASE WHEN o_totalprice < 150000
             THEN concat('https://boards.greenhouse.io/customer', o_custkey, '/jobs/', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '?gh_src=x' ELSE '' END)
             ELSE concat('https://new.example/', o_orderkey) END AS source_url,
           concat('Updated ', o_orderkey) AS title, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE CAST(7 AS BIGINT) END AS max_salary
    FROM orders"""
# every order is changed once, some twice: the later change has to win and nothing may land twice
_CHANGES = f"""
    SELECT company_id, source_url, title, max_salary, 1 AS version FROM ({_CHANGES}) AS first_changes
    UNION ALL SELECT company_id, source_url, concat(title, ' again'), CAST(11 AS BIGINT), 2 FROM ({_CHANGES}) AS second_changes WHERE company_id % 3 = 0"""
_LAST = f"SELECT company_id, source_url, arg_max(title, version) AS title, arg_max(struct_pack(v := max_salary), version).v AS max_salary FROM ({_CHANGES}) GROUP BY 1, 2"


def _changes(spark, sf):
    return spark.sql(_CHANGES.replace("FROM orders", "FROM {orders}"), orders=load(spark, sf, "orders"))


@query("upsert_jobs", cte("jobs") + f", u AS ({_LAST})" + f"""
    SELECT coalesce(j.company_id, u.company_id) AS company_id, coalesce(j.source_url, u.source_url) AS source_url,
           CASE WHEN u.title IS NOT NULL THEN u.title ELSE j.title END AS title,
           CASE WHEN u.title IS NOT NULL THEN u.max_salary ELSE j.max_salary END AS max_salary,
           CASE WHEN u.title IS NOT NULL THEN NULL ELSE j.role_family END AS role_family,
           j.delist_reason, CASE WHEN u.title IS NOT NULL THEN '{AS_OF}' ELSE strftime(j.updated_at, {_TS}) END AS updated_at
    FROM b_jobs j FULL JOIN u ON j.company_id = u.company_id AND j.source_url = u.source_url""")
def upsert_jobs(spark, sf):
    out = up.upsert_jobs(bind(spark, sf, "jobs"), _changes(spark, sf), AS_OF, order=["version"])
    return out.select("company_id", "source_url", "title", "max_salary", "role_family", "delist_reason",
                      iso("updated_at").alias("updated_at"))


@query("keyed_upsert_jobs", f"SELECT *, 1 AS version FROM ({ORACLES['upsert_jobs']})")
def keyed_upsert_jobs(spark, sf):
    # written in buckets, changed, and changed once more by the same rows, which makes no new version
    table = kt.KeyedTable.create(bind(spark, sf, "jobs"), new_folder(spark, "keyed"), ["company_id", "source_url"], rows_per_bucket=2000)
    for _ in range(2):
        table = table.apply(lambda rows, u: up.upsert_jobs(rows, u, AS_OF, order=["version"]), _changes(spark, sf))
    return table.read().select("company_id", "source_url", "title", "max_salary", "role_family", "delist_reason",
                               iso("updated_at").alias("updated_at"), F.lit(table.version).alias("version"))


@query("upsert_jobs_raw", cte("jobs_raw") + f", u AS ({_LAST})" + """
    SELECT coalesce(j.company_id, u.company_id) AS company_id, coalesce(j.source_url, u.source_url) AS source_url,
           CASE WHEN u.title IS NOT NULL THEN u.title ELSE j.title_raw END AS title_raw, j.id,
           CASE WHEN u.title IS NOT NULL THEN NULL ELSE j.salary_raw END AS salary_raw
    FROM b_jobs_raw j FULL JOIN u ON j.company_id = u.company_id AND j.source_url = u.source_url""")
def upsert_jobs_raw(spark, sf):
    u = _changes(spark, sf).withColumnRenamed("title", "title_raw")
    return up.upsert_jobs_raw(bind(spark, sf, "jobs_raw"), u, order=["version"]).select("company_id", "source_url", "title_raw", "id", "salary_raw")


@query("upsert_matches", cte("matches") + """, u AS (SELECT * FROM (SELECT CASE WHEN l_quantity < 10 THEN l_suppkey ELSE -l_suppkey END AS candidate_id, l_orderkey AS job_id, l_tax AS score,
      row_number() OVER (PARTITION BY CASE WHEN l_quantity < 10 THEN l_suppkey ELSE -l_suppkey END, l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem) WHERE rn = 1)
    SELECT coalesce(m.candidate_id, u.candidate_id) AS candidate_id, coalesce(m.job_id, u.job_id) AS job_id, round(CASE WHEN u.job_id IS NOT NULL THEN u.score ELSE m.score END, 6) AS score,
           strftime(m.shown_at, '%Y-%m-%d %H:%M:%S') AS shown_at
    FROM b_matches m FULL JOIN u ON m.candidate_id = u.candidate_id AND m.job_id = u.job_id""")
def upsert_matches(spark, sf):
    u = load(spark, sf, "lineitem").selectExpr(
        "CASE WHEN l_quantity < 10 THEN l_suppkey ELSE -l_suppkey END AS candidate_id", "l_orderkey AS job_id", "l_tax AS score", "TRUE AS hard_match", "l_shipdate AS at", "l_linenumber AS n")
    from ..operators.windows import latest_per

    target = bind(spark, sf, "matches").withColumn("match_reasons", F.create_map().cast("map<string,string>"))
    u = latest_per(u, ["candidate_id", "job_id"], "at", "n")
    return up.upsert_matches(target, u).select("candidate_id", "job_id", F.round("score", 6).alias("score"), iso("shown_at").alias("shown_at"))


@query("upsert_listings", cte("listings") + """, u AS (SELECT job_id, 'A' AS board, NOT found AS found FROM b_listings WHERE board = 'N')
    SELECT coalesce(l.job_id, u.job_id) AS job_id, coalesce(l.board, u.board) AS board, CASE WHEN u.job_id IS NOT NULL THEN u.found ELSE l.found END AS found
    FROM b_listings l FULL JOIN u ON l.job_id = u.job_id AND l.board = u.board""")
def upsert_listings(spark, sf):
    l = bind(spark, sf, "listings")
    u = l.filter("board = 'N'").select("job_id", F.lit("A").alias("board"), (~F.col("found")).alias("found"))
    return up.upsert_listings(l, u).select("job_id", "board", "found")


@query("insert_ignore", cte("dormant", "companies") + """
    SELECT id, dormant_reason FROM b_dormant
    UNION ALL SELECT id, 'moved 1' FROM b_companies WHERE id NOT IN (SELECT id FROM b_dormant)
    UNION ALL SELECT -id, 'moved 1' FROM b_companies WHERE id <> 0""")
def insert_ignore(spark, sf):
    # every company arrives twice; of two rows with one key only the first is added
    d = bind(spark, sf, "dormant").select("id", "dormant_reason")
    new = bind(spark, sf, "companies").select(F.explode(F.array(F.col("id"), -F.col("id"))).alias("id"))
    twice = new.select("id", F.explode(F.array(F.lit("moved 2"), F.lit("moved 1"))).alias("dormant_reason"))
    return up.insert_ignore(d, twice, ["id"], order=["dormant_reason"])


@query("crawl_metric_rows", cte("metrics") + """
    SELECT 'crawl_result' AS name, CASE WHEN name <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value, id::VARCHAR AS company FROM b_metrics
    UNION ALL SELECT 'jobs_found', (k % 3)::DOUBLE, id::VARCHAR FROM b_metrics WHERE name <> 'error' AND k % 3 > 0""")
def crawl_metric_rows(spark, sf):
    r = bind(spark, sf, "metrics").select(F.col("id").alias("company_id"), F.lit("lever").alias("ats_type"),
                                          (F.col("name") != "error").alias("success"), (F.col("k") % 3).alias("jobs_found"))
    return up.crawl_metrics_rows(r, AS_OF_EVENTS).select("name", "value", F.col("labels")["company_id"].alias("company"))


@query("update_where", cte("companies") + """
    SELECT id, CASE WHEN is_active AND ats_type IS NULL AND ats_detection_attempts >= 2 THEN 'custom' ELSE ats_type END AS ats_type FROM b_companies""")
def update_where(spark, sf):
    from ..plans.detect import mark_custom

    return mark_custom(bind(spark, sf, "companies")).select("id", "ats_type")


@query("delete_where", cte("queue") + """
    SELECT source, count(*) AS n FROM b_queue WHERE NOT coalesce(careers_url LIKE '%lever%', FALSE) GROUP BY 1""")
def delete_where(spark, sf):
    return up.delete_where(bind(spark, sf, "queue"), F.col("careers_url").contains("lever")).groupBy("source").agg(F.count("*").alias("n"))


@query("cascade_delete", cte("companies", "jobs", "matches") + """, gone AS (SELECT id FROM b_companies WHERE country = 'GB')
    SELECT 'companies' AS name, count(*) AS n FROM b_companies WHERE id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'jobs', count(*) FROM b_jobs WHERE company_id NOT IN (SELECT id FROM gone)
    UNION ALL SELECT 'matches', count(*) FROM b_matches WHERE job_id NOT IN (SELECT id FROM b_jobs WHERE company_id IN (SELECT id FROM gone))""")
def cascade_delete(spark, sf):
    c = bind(spark, sf, "companies")
    out = up.cascade_delete({"companies": c, "jobs": bind(spark, sf, "jobs"), "matches": bind(spark, sf, "matches")},
                            c.filter("country = 'GB'").select(F.col("id").alias("company_id")))
    count = lambda n: out[n].agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return count("companies").unionByName(count("jobs")).unionByName(count("matches"))


@query("match_events", cte("matches") + """, e AS (
      SELECT l_suppkey, l_orderkey, min(l_shipdate) FILTER (WHERE l_linenumber % 2 = 0) AS s, max(l_shipdate) FILTER (WHERE l_linenumber % 2 = 1) AS k FROM lineitem GROUP BY 1, 2)
    SELECT m.candidate_id, m.job_id, strftime(coalesce(m.shown_at, e.s), '%Y-%m-%d %H:%M:%S') AS shown_at, strftime(e.k, '%Y-%m-%d %H:%M:%S') AS clicked_at
    FROM b_matches m LEFT JOIN e ON m.candidate_id = e.l_suppkey AND m.job_id = e.l_orderkey""")
def match_events(spark, sf):
    ev = load(spark, sf, "lineitem").selectExpr(
        "l_suppkey AS candidate_id", "l_orderkey AS job_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'shown' ELSE 'clicked' END AS kind",
        "CAST(l_shipdate AS TIMESTAMP) AS at")
    m = bind(spark, sf, "matches").withColumn("clicked_at", F.lit(None).cast("timestamp"))
    return up.apply_match_events(m, ev).select("candidate_id", "job_id", iso("shown_at").alias("shown_at"), iso("clicked_at").alias("clicked_at"))


@query("fill_missing", cte("companies") + """, i AS (SELECT c_custkey AS id, concat('https://found.example/', c_custkey) AS careers_url, 'Paris' AS location FROM customer WHERE c_acctbal > 2000)
    SELECT c.id, coalesce(nullif(c.careers_url, ''), i.careers_url) AS careers_url, coalesce(nullif(c.location, ''), i.location) AS location
    FROM b_companies c LEFT JOIN i ON i.id = c.id""")
def fill_missing(spark, sf):
    i = load(spark, sf, "customer").filter("c_acctbal > 2000").selectExpr(
        "c_custkey AS id", "concat('https://found.example/', c_custkey) AS careers_url", "'Paris' AS location")
    return jn.fill_missing(bind(spark, sf, "companies"), i, "id", ["careers_url", "location"]).select("id", "careers_url", "location")


@query("set_operations", """
    SELECT 'stored_only' AS kind, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'both', count(*) FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_operations(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    a, b = o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'P'")
    count = lambda d, n: d.agg(F.lit(n).alias("kind"), F.count("*").alias("n"))
    return count(st.difference(a, b, ["k"]), "stored_only").unionByName(count(st.intersection(a, b, ["k"]), "both"))


@query("union_sources", """
    SELECT source_rank::BIGINT AS source_rank, count(*) AS n, count(location) AS with_location FROM (
      SELECT 0 AS source_rank, c_name AS name, NULL AS location FROM customer UNION ALL SELECT 1, s_name, 'US' FROM supplier) GROUP BY 1""")
def union_sources(spark, sf):
    a = load(spark, sf, "customer").select(F.col("c_name").alias("name"))
    b = load(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("US").alias("location"))
    return st.union_sources(a, b).groupBy(F.col("source_rank").cast("bigint").alias("source_rank")).agg(
        F.count("*").alias("n"), F.count("location").alias("with_location"))


@query("known_domains", cte("companies", "queue") + """
    SELECT lower(domain) AS domain FROM b_companies WHERE domain IS NOT NULL UNION SELECT lower(domain) FROM b_queue WHERE status IN ('pending', 'processing')""")
def known_domains(spark, sf):
    return st.known_domains(bind(spark, sf, "companies"), bind(spark, sf, "queue"))


@query("new_custom_jobs", cte("jobs", "live") + """
    SELECT l.company_id, l.source_url FROM (SELECT company_id, lower(rtrim(source_url, '/')) AS source_url, title FROM b_live) l
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT company_id, lower(source_url) AS source_url, title FROM b_jobs) j
      WHERE j.company_id = l.company_id AND (j.source_url = l.source_url OR j.title = l.title))""")
def new_custom_jobs(spark, sf):
    found = bind(spark, sf, "live").withColumn("source_url", F.lower(F.regexp_replace("source_url", "/+$", "")))
    jobs = bind(spark, sf, "jobs").withColumn("source_url", F.lower("source_url"))
    return jn.new_custom_jobs(jobs, found).select("company_id", "source_url")


@query("jobs_needing_verification", cte("jobs", "companies", "listings") + """
    SELECT j.id AS job_id, c.name AS company_name, strftime(coalesce((SELECT max(verified_at) FROM b_listings l WHERE l.job_id = j.id),
      TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS last_verified_at
    FROM b_jobs j JOIN b_companies c ON j.company_id = c.id WHERE j.is_active""")
def jobs_needing_verification(spark, sf):
    return jn.jobs_needing_verification(bind(spark, sf, "jobs"), bind(spark, sf, "companies"), bind(spark, sf, "listings")).select(
        "job_id", "company_name", iso("last_verified_at").alias("last_verified_at"))
