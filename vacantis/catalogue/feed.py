"""Job feed, paging, visibility and work-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, bind, cte
from ..functions.core import iso
from ..operators import filters as fl, joins as jn, ordering as od
from . import query

_T = f"TIMESTAMP '{AS_OF}'"


def _iso(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query("job_feed", cte("jobs", "companies") + f"""
    SELECT j.id, j.title, j.seniority, c.name AS company_name, {_iso('j.posted_at')} AS posted_at
    FROM b_jobs j JOIN b_companies c ON j.company_id = c.id
    WHERE j.is_active AND c.is_active AND j.seniority = 'senior'""")
def job_feed(spark, sf):
    feed = jn.job_feed(bind(spark, sf, "jobs"), bind(spark, sf, "companies"))
    return fl.where_opt(feed, seniority="senior", location_type=None).select(
        "id", "title", "seniority", "company_name", iso("posted_at").alias("posted_at"))


@query("job_page", cte("jobs") + f"""
    SELECT id, title, {_iso('posted_at')} AS posted_at FROM b_jobs WHERE is_active AND role_family = 'data'
    ORDER BY b_jobs.posted_at DESC NULLS LAST, created_at DESC, id LIMIT 20 OFFSET 20""")
def job_page(spark, sf):
    jobs = fl.where_opt(fl.active(bind(spark, sf, "jobs")), role_family="data")
    return od.page(jobs, 2, 20, *od.job_order()).select("id", "title", iso("posted_at").alias("posted_at"))


@query("job_page_after", cte("jobs") + f"""
    SELECT id, title, {_iso('posted_at')} AS posted_at FROM b_jobs WHERE is_active AND role_family = 'data'
    ORDER BY b_jobs.posted_at DESC NULLS LAST, created_at DESC, id LIMIT 20 OFFSET 60""")
def job_page_after(spark, sf):
    # three pages are turned by their cursors
    jobs, cursor = fl.where_opt(fl.active(bind(spark, sf, "jobs")), role_family="data"), None
    for _ in range(3):
        cursor = od.cursor_of(od.page_after(jobs, 20, cursor)) or cursor
    return od.page_after(jobs, 20, cursor).select("id", "title", iso("posted_at").alias("posted_at"))


@query("job_page_totals", cte("jobs") + """
    SELECT count(*) FILTER (WHERE is_active) AS total_active,
           count(*) FILTER (WHERE is_active AND role_family = 'data') AS total_filtered,
           count(*) FILTER (WHERE is_active AND role_family = 'data') > 40 AS has_more FROM b_jobs""")
def job_page_totals(spark, sf):
    jobs = fl.active(bind(spark, sf, "jobs"))
    return od.page_totals(jobs, fl.where_opt(jobs, role_family="data"), 2, 20)


@query("job_response", cte("jobs", "companies") + """
    SELECT j.id, j.title, array_to_string(j.skills, '|') AS skills, c.name AS company_name,
           c.domain AS company_domain, j.min_salary, j.max_salary
    FROM b_jobs j JOIN b_companies c ON j.company_id = c.id""")
def job_response(spark, sf):
    return fl.job_response(bind(spark, sf, "jobs"), bind(spark, sf, "companies")).select(
        "id", "title", F.array_join("skills", "|").alias("skills"),
        F.col("company.name").alias("company_name"), F.col("company.domain").alias("company_domain"),
        "min_salary", "max_salary")


@query("candidate_matches", cte("matches", "jobs", "companies") + f"""
    SELECT m.candidate_id, m.job_id, round(m.score, 6) AS score, j.title, c.name AS company_name,
           {_iso('j.posted_at')} AS posted_at
    FROM b_matches m JOIN b_jobs j ON m.job_id = j.id JOIN b_companies c ON j.company_id = c.id
    WHERE j.is_active""")
def candidate_matches(spark, sf):
    return jn.candidate_matches(bind(spark, sf, "matches"), bind(spark, sf, "jobs"),
                                bind(spark, sf, "companies")).select(
        "candidate_id", "job_id", F.round("score", 6).alias("score"), "title", "company_name",
        iso("posted_at").alias("posted_at"))


@query("ownership_filter", cte("matches", "candidates") + """
    SELECT candidate_id, job_id, round(score, 6) AS score FROM b_matches
    WHERE candidate_id IN (SELECT id FROM b_candidates WHERE email = 's7@mail.example')""")
def ownership_filter(spark, sf):
    return fl.own_matches(bind(spark, sf, "matches"), bind(spark, sf, "candidates"), "s7@mail.example").select(
        "candidate_id", "job_id", F.round("score", 6).alias("score"))


@query("changed_after_creation", cte("jobs") + """
    SELECT id, company_id FROM b_jobs WHERE updated_at <> created_at""")
def changed_after_creation(spark, sf):
    return fl.changed_after_creation(bind(spark, sf, "jobs")).select("id", "company_id")


@query("quality_gate", cte("matches") + """
    SELECT CASE WHEN score BETWEEN 0 AND 1 THEN '' ELSE 'score_range' END AS violations, count(*) AS n
    FROM (SELECT score * 1.2 AS score FROM b_matches) GROUP BY 1""")
def quality_gate(spark, sf):
    ok, bad = fl.check(bind(spark, sf, "matches").withColumn("score", F.col("score") * 1.2), "matches")
    both = (ok.select(F.lit("").alias("violations"))
            .unionByName(bad.select(F.array_join("violations", "|").alias("violations"))))
    return both.groupBy("violations").agg(F.count("*").alias("n"))


@query("jobs_to_embed", cte("jobs") + """
    SELECT j.id FROM b_jobs j LEFT JOIN embeddings e ON e.vec_id = j.id
    WHERE j.is_active AND e.vec_id IS NULL AND coalesce(j.description, '') <> ''""")
def jobs_to_embed(spark, sf):
    from .vectors import jobs_with_vectors

    return fl.jobs_to_embed(jobs_with_vectors(spark, sf)).select("id")


@query("companies_to_detect", cte("companies") + """
    SELECT id, coalesce(ats_detection_attempts, 0)::BIGINT AS attempts FROM b_companies
    WHERE is_active AND ats_type IS NULL AND coalesce(ats_detection_attempts, 0) < 2""")
def companies_to_detect(spark, sf):
    return fl.companies_to_detect(bind(spark, sf, "companies")).select(
        "id", F.coalesce("ats_detection_attempts", F.lit(0)).cast("bigint").alias("attempts"))


@query("custom_work", cte("companies", "jobs") + """
    SELECT 'company' AS kind, id FROM b_companies
    WHERE is_active AND ats_type = 'custom' AND last_crawled_at IS NULL AND careers_url IS NOT NULL
    UNION ALL
    SELECT 'job', j.id FROM b_jobs j JOIN b_companies c ON c.id = j.company_id
    WHERE j.is_active AND coalesce(j.description, '') = '' AND c.ats_type = 'custom'""")
def custom_work(spark, sf):
    companies, jobs = bind(spark, sf, "companies"), bind(spark, sf, "jobs")
    a = fl.custom_companies_to_crawl(companies).select(F.lit("company").alias("kind"), "id")
    return a.unionByName(fl.custom_jobs_to_enrich(jobs, companies).select(F.lit("job").alias("kind"), "id"))


@query("network_seeds", cte("companies") + """
    SELECT id, domain FROM b_companies
    WHERE is_active AND domain IS NOT NULL AND last_crawled_for_network IS NULL""")
def network_seeds(spark, sf):
    return fl.network_seeds(bind(spark, sf, "companies")).select("id", "domain")


@query("dormant_candidates", cte("companies") + """
    SELECT id FROM b_companies WHERE is_active AND coalesce(careers_url, '') = '' AND ats_type IS NULL
    AND (coalesce(website_url, '') = '' OR coalesce(ats_detection_attempts, 0) >= 2)""")
def dormant_candidates(spark, sf):
    return fl.dormant_candidates(bind(spark, sf, "companies")).select("id")


@query("crawl_frontier", cte("companies") + """
    SELECT id, crawl_priority::BIGINT AS crawl_priority FROM b_companies
    WHERE is_active AND careers_url IS NOT NULL
    ORDER BY ats_type IS NULL, b_companies.crawl_priority DESC, last_crawled_at ASC NULLS FIRST, id LIMIT 50""")
def crawl_frontier(spark, sf):
    return od.crawl_frontier(bind(spark, sf, "companies"), 50).select(
        "id", F.col("crawl_priority").cast("bigint").alias("crawl_priority"))


@query("stalest_companies", cte("companies") + """
    SELECT id FROM b_companies WHERE is_active ORDER BY last_maintenance_at ASC NULLS FIRST, id LIMIT 40""")
def stalest_companies(spark, sf):
    return od.stalest(fl.active(bind(spark, sf, "companies")), "last_maintenance_at", 40).select("id")


@query("queue_claim", cte("queue") + """
    SELECT CASE WHEN k.id IS NOT NULL THEN 'processing' ELSE q.status END AS status, count(*) AS n
    FROM b_queue q LEFT JOIN (SELECT id FROM b_queue WHERE status = 'pending' ORDER BY created_at, id LIMIT 100) k
    ON k.id = q.id GROUP BY 1""")
def queue_claim(spark, sf):
    _, after = od.claim(bind(spark, sf, "queue"), 100, AS_OF)
    return after.groupBy("status").agg(F.count("*").alias("n"))


@query("recent_runs", cte("runs") + f"""
    SELECT id, stage, {_iso('started_at')} AS started_at FROM b_runs WHERE status = 'failed'
    ORDER BY b_runs.started_at DESC, id DESC LIMIT 20""")
def recent_runs(spark, sf):
    return od.recent_runs(bind(spark, sf, "runs"), 20, "failed").select(
        "id", "stage", iso("started_at").alias("started_at"))


@query("companies_without_jobs", cte("companies", "jobs") + """
    SELECT id, ats_type FROM b_companies c WHERE is_active AND ats_type IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM b_jobs j WHERE j.company_id = c.id AND j.is_active AND j.role_family = 'data')""")
def companies_without_jobs(spark, sf):
    jobs = bind(spark, sf, "jobs").withColumn("is_active", F.col("is_active") & (F.col("role_family") == "data"))
    return jn.companies_without_jobs(bind(spark, sf, "companies"), jobs).select("id", "ats_type")
