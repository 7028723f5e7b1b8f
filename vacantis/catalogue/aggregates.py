"""Counts, rates, funnels, time series and health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, AS_OF_EVENTS, bind, cte
from ..functions.core import iso
from ..operators import aggregates as ag
from . import query

_T = f"TIMESTAMP '{AS_OF}'"
_E = f"TIMESTAMP '{AS_OF_EVENTS}'"
_START = "2001-06-01 00:00:00"


def _vec_jobs(spark, sf):
    from .vectors import jobs_with_vectors

    return jobs_with_vectors(spark, sf)


_VJ = "(SELECT j.*, e.embedding FROM b_jobs j LEFT JOIN embeddings e ON e.vec_id = j.id)"


@query("system_metrics", cte("companies", "jobs", "candidates", "matches") + f"""
    SELECT c.*, j.*, k.*, m.* FROM
    (SELECT count(*) AS total_companies, count(*) FILTER (WHERE is_active) AS active_companies FROM b_companies) c,
    (SELECT count(*) AS total_jobs, count(*) FILTER (WHERE is_active) AS active_jobs,
            count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 1 DAY) AS jobs_last_24h,
            count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 7 DAY) AS jobs_last_7d FROM b_jobs) j,
    (SELECT count(*) AS total_candidates, count(*) FILTER (WHERE is_active) AS active_candidates FROM b_candidates) k,
    (SELECT count(*) AS total_matches, count(*) FILTER (WHERE created_at >= {_T} - INTERVAL 1 DAY) AS matches_last_24h,
            round(avg(score), 6) AS avg_match_score FROM b_matches) m""")
def system_metrics(spark, sf):
    out = ag.system_metrics(*[bind(spark, sf, n) for n in ("companies", "jobs", "candidates", "matches")], AS_OF)
    return out.withColumn("avg_match_score", F.round("avg_match_score", 6))


@query("count_by_ats", cte("companies") + """
    SELECT ats_type, count(*) AS count FROM b_companies GROUP BY 1""")
def count_by_ats(spark, sf):
    return ag.count_by(bind(spark, sf, "companies"), "ats_type")


@query("ats_stats", cte("companies") + """
    SELECT count(ats_type) AS total_with_ats, count(*) - count(ats_type) AS total_without_ats,
           count(*) FILTER (WHERE ats_type IS NULL AND careers_url IS NOT NULL AND is_active) AS needs_discovery
    FROM b_companies""")
def ats_stats(spark, sf):
    return ag.ats_stats(bind(spark, sf, "companies"))


@query("ats_companies_and_jobs", cte("companies", "jobs") + """
    SELECT c.ats_type, c.n AS companies, coalesce(j.n, 0) AS jobs FROM
    (SELECT ats_type, count(*) AS n FROM b_companies WHERE is_active AND ats_type IS NOT NULL GROUP BY 1) c
    LEFT JOIN (SELECT b.ats_type, count(*) AS n FROM b_jobs a JOIN b_companies b ON a.company_id = b.id
               WHERE a.is_active GROUP BY 1) j ON c.ats_type = j.ats_type""")
def ats_companies_and_jobs(spark, sf):
    return ag.ats_companies_and_jobs(bind(spark, sf, "companies"), bind(spark, sf, "jobs"))


@query("ats_funnel", cte("companies") + """
    SELECT count(*) FILTER (WHERE is_active AND ats_type IS NULL AND coalesce(ats_detection_attempts, 0) = 0) AS never_tried,
           count(*) FILTER (WHERE is_active AND ats_type IS NULL AND ats_detection_attempts = 1) AS tried_pending,
           count(*) FILTER (WHERE is_active AND ats_type IS NULL AND ats_detection_attempts >= 2) AS exhausted,
           count(*) FILTER (WHERE is_active AND ats_type IS NOT NULL) AS detected,
           count(*) FILTER (WHERE is_active AND ats_type = 'custom') AS custom,
           count(*) FILTER (WHERE is_active AND ats_type = 'uses_parent_ats') AS uses_parent FROM b_companies""")
def ats_funnel(spark, sf):
    return ag.ats_funnel(bind(spark, sf, "companies"))


@query("crawl_stats", cte("companies") + """
    SELECT coalesce(ats_type, 'unknown') AS ats_type, count(*) AS total, count(careers_url) AS with_careers,
           count(last_crawled_at) AS crawled FROM b_companies GROUP BY 1""")
def crawl_stats(spark, sf):
    return ag.crawl_stats(bind(spark, sf, "companies"))


@query("crawl_stage", cte("companies") + f"""
    SELECT ats_type, count(*) AS total,
           count(*) FILTER (WHERE last_crawled_at > {_T} - INTERVAL 24 HOUR) AS crawled_today,
           count(*) FILTER (WHERE last_crawled_at IS NULL OR last_crawled_at < {_T} - INTERVAL 24 HOUR) AS needs_crawl
    FROM b_companies WHERE is_active AND ats_type IS NOT NULL GROUP BY 1""")
def crawl_stage(spark, sf):
    return ag.crawl_stage(bind(spark, sf, "companies"), AS_OF)


@query("job_changes", cte("jobs") + f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE created_at > {_T} - INTERVAL 24 HOUR) AS added_today,
           count(*) FILTER (WHERE updated_at > {_T} - INTERVAL 24 HOUR) AS updated_today FROM b_jobs""")
def job_changes(spark, sf):
    return ag.job_changes(bind(spark, sf, "jobs"), AS_OF)


@query("enrich_stage", cte("companies", "jobs") + f"""
    SELECT coalesce(c.ats_type, 'unknown') AS ats_type, count(*) AS total, count(j.description) AS with_description,
           count(*) - count(j.description) AS needs_enrichment,
           count(*) FILTER (WHERE j.updated_at > {_T} - INTERVAL 1 HOUR) AS enriched_recently,
           round(100.0 * count(j.description) / count(*), 1)::DOUBLE AS percent_complete
    FROM b_jobs j JOIN b_companies c ON j.company_id = c.id WHERE j.is_active GROUP BY 1""")
def enrich_stage(spark, sf):
    return ag.enrich_stage(bind(spark, sf, "jobs"), bind(spark, sf, "companies"), AS_OF)


@query("embedding_stage", cte("jobs") + f"""
    SELECT count(*) AS total_jobs, count(embedding) AS with_embeddings, count(*) - count(embedding) AS without_embeddings,
           count(*) FILTER (WHERE is_active AND embedding IS NULL) AS active_without_embeddings,
           count(*) FILTER (WHERE NOT is_active AND embedding IS NULL) AS inactive_without_embeddings,
           round(100.0 * count(embedding) FILTER (WHERE is_active) / count(*) FILTER (WHERE is_active), 1)::DOUBLE AS percent_complete
    FROM {_VJ}""")
def embedding_stage(spark, sf):
    return ag.embedding_stage(_vec_jobs(spark, sf))


@query("pipeline_stats", cte("companies", "jobs") + f"""
    SELECT c.*, j.* FROM (SELECT
      count(*) FILTER (WHERE is_active AND ats_type IS NOT NULL AND (last_crawled_at IS NULL OR last_crawled_at < {_T} - INTERVAL 24 HOUR)) AS companies_ready_to_crawl,
      count(*) FILTER (WHERE is_active AND ats_type IS NULL AND coalesce(ats_detection_attempts, 0) < 2) AS companies_pending_ats,
      count(*) FILTER (WHERE is_active AND ats_type IS NULL AND coalesce(ats_detection_attempts, 0) = 0) AS ats_never_tried,
      count(*) FILTER (WHERE is_active AND ats_type IS NULL AND ats_detection_attempts = 1) AS ats_tried_pending,
      count(*) FILTER (WHERE is_active AND ats_type IS NULL AND ats_detection_attempts >= 2) AS ats_exhausted
      FROM b_companies) c, (SELECT
      count(*) FILTER (WHERE is_active AND coalesce(description, '') = '') AS jobs_missing_description,
      count(*) FILTER (WHERE is_active AND embedding IS NULL) AS jobs_missing_embeddings FROM {_VJ}) j""")
def pipeline_stats(spark, sf):
    return ag.pipeline_stats(bind(spark, sf, "companies"), _vec_jobs(spark, sf), AS_OF)


@query("maintenance_by_ats", cte("companies", "jobs") + f"""
    SELECT coalesce(c.ats_type, 'unknown') AS ats_type, count(DISTINCT c.id) AS companies, count(j.id) AS total_jobs,
           count(j.id) FILTER (WHERE j.is_active) AS active_jobs,
           count(j.id) FILTER (WHERE NOT j.is_active AND j.delisted_at IS NOT NULL) AS delisted_jobs,
           count(j.id) FILTER (WHERE j.is_active AND (j.last_verified_at IS NULL OR j.last_verified_at < {_T} - INTERVAL 7 DAY)) AS pending_verification,
           round(avg(trunc(date_diff('second', j.last_verified_at, {_T}) / 86400.0)), 6)::DOUBLE AS avg_days_since_verified
    FROM b_companies c LEFT JOIN b_jobs j ON j.company_id = c.id
    WHERE c.is_active AND c.careers_url IS NOT NULL GROUP BY 1""")
def maintenance_by_ats(spark, sf):
    return ag.maintenance_by_ats(bind(spark, sf, "companies"), bind(spark, sf, "jobs"), AS_OF).withColumn(
        "avg_days_since_verified", F.round("avg_days_since_verified", 6))


@query("maintenance_totals", cte("companies", "jobs") + f"""
    SELECT * FROM (SELECT count(*) AS jobs_pending_verification FROM b_jobs j JOIN b_companies c ON j.company_id = c.id
      WHERE j.is_active AND c.is_active AND c.careers_url IS NOT NULL
      AND (j.last_verified_at IS NULL OR j.last_verified_at < {_T} - INTERVAL 7 DAY)),
    (SELECT count(*) FILTER (WHERE last_verified_at > {_T} - INTERVAL 24 HOUR) AS jobs_verified_24h,
            count(*) FILTER (WHERE NOT is_active AND delisted_at > {_T} - INTERVAL 7 DAY) AS jobs_delisted_7d FROM b_jobs),
    (SELECT count(*) FILTER (WHERE is_active AND careers_url IS NOT NULL AND (last_maintenance_at IS NULL OR last_maintenance_at < {_T} - INTERVAL 7 DAY)) AS companies_pending_maintenance,
            count(*) FILTER (WHERE last_maintenance_at > {_T} - INTERVAL 24 HOUR) AS companies_maintained_24h FROM b_companies)""")
def maintenance_totals(spark, sf):
    return ag.maintenance_totals(bind(spark, sf, "companies"), bind(spark, sf, "jobs"), AS_OF)


_SUP = "('greenhouse', 'lever', 'ashby', 'workable', 'jobvite', 'workday')"


@query("supported_two_level", cte("companies", "jobs") + f"""
    SELECT CASE WHEN c.ats_type IN {_SUP} THEN 'supported' ELSE 'unsupported' END AS category,
           count(*) AS total_jobs, count(j.description) AS with_description,
           count(*) - count(j.description) AS needs_enrichment, count(j.embedding) AS with_embeddings,
           round(100.0 * count(j.description) / count(*), 1)::DOUBLE AS percent_enriched,
           round(100.0 * count(j.embedding) / count(*), 1)::DOUBLE AS percent_embedded
    FROM {_VJ} j JOIN b_companies c ON j.company_id = c.id WHERE j.is_active GROUP BY 1""")
def supported_two_level(spark, sf):
    return ag.supported_summary(_vec_jobs(spark, sf), bind(spark, sf, "companies"))


@query("supported_by_ats", cte("companies", "jobs") + f"""
    SELECT j.*, coalesce(r.n, 0) AS ready_to_crawl FROM (
      SELECT c.ats_type, count(*) AS total_jobs, count(j.description) AS with_description,
             count(*) - count(j.description) AS needs_enrichment, count(j.embedding) AS with_embeddings,
             round(100.0 * count(j.description) / count(*), 1)::DOUBLE AS percent_enriched
      FROM {_VJ} j JOIN b_companies c ON j.company_id = c.id
      WHERE j.is_active AND c.ats_type IN {_SUP} GROUP BY 1) j
    LEFT JOIN (SELECT ats_type, count(*) AS n FROM b_companies WHERE is_active AND ats_type IN {_SUP}
               AND (last_crawled_at IS NULL OR last_crawled_at < {_T} - INTERVAL 24 HOUR) GROUP BY 1) r
    ON r.ats_type = j.ats_type""")
def supported_by_ats(spark, sf):
    return ag.supported_by_ats(_vec_jobs(spark, sf), bind(spark, sf, "companies"), AS_OF)


@query("discovery_stats", cte("queue") + """
    SELECT source, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed,
           count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM b_queue GROUP BY 1""")
def discovery_stats(spark, sf):
    return ag.discovery_stats(bind(spark, sf, "queue"))


@query("queue_by_status", cte("queue") + """
    SELECT s AS status, count(q.id) AS count
    FROM (SELECT unnest(['pending', 'processing', 'completed', 'review', 'failed']) AS s) t
    LEFT JOIN b_queue q ON q.status = t.s GROUP BY 1""")
def queue_by_status(spark, sf):
    return ag.queue_by_status(bind(spark, sf, "queue"))


@query("recent_by_source", cte("queue") + f"""
    SELECT source, count(*) AS count FROM b_queue WHERE created_at > {_E} - INTERVAL 24 HOUR GROUP BY 1""")
def recent_by_source(spark, sf):
    return ag.recent_by_source(bind(spark, sf, "queue"), AS_OF_EVENTS)


@query("company_additions", cte("companies") + f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE created_at > {_T} - INTERVAL 24 HOUR) AS added_today,
           count(ats_type) AS with_ats FROM b_companies""")
def company_additions(spark, sf):
    return ag.company_additions(bind(spark, sf, "companies"), AS_OF)


@query("dormant_stats", cte("dormant") + f"""
    SELECT dormant_reason AS reason, count(*) AS count, count(*) FILTER (WHERE last_checked_at IS NULL) AS never_checked,
           count(*) FILTER (WHERE last_checked_at < {_T} - INTERVAL 30 DAY) AS stale FROM b_dormant GROUP BY 1""")
def dormant_stats(spark, sf):
    return ag.dormant_stats(bind(spark, sf, "dormant"), AS_OF)


@query("verification_stats", cte("listings") + """
    SELECT board, count(*) AS total_verified, count(*) FILTER (WHERE found) AS found_on_board,
           count(*) FILTER (WHERE NOT found) AS unique_to_us,
           round(100.0 * count(*) FILTER (WHERE NOT found) / count(*), 2)::DOUBLE AS uniqueness_rate_percent,
           strftime(max(verified_at), '%Y-%m-%d %H:%M:%S') AS last_verified_at FROM b_listings GROUP BY 1""")
def verification_stats(spark, sf):
    return ag.verification_stats(bind(spark, sf, "listings")).withColumn("last_verified_at", iso("last_verified_at"))


@query("verification_summary", cte("jobs", "listings") + """
    SELECT b.*, t.total_jobs, round(100.0 * unique_jobs / verified_jobs, 2)::DOUBLE AS uniqueness_rate,
           round(100.0 * verified_jobs / total_jobs, 2)::DOUBLE AS coverage_rate FROM
    (SELECT l.board, count(*) AS verified_jobs, count(*) FILTER (WHERE NOT found) AS unique_jobs,
            count(*) FILTER (WHERE found) AS found_jobs
     FROM b_listings l JOIN b_jobs j ON l.job_id = j.id WHERE j.is_active GROUP BY 1) b,
    (SELECT count(*) AS total_jobs FROM b_jobs WHERE is_active) t""")
def verification_summary(spark, sf):
    return ag.verification_summary(bind(spark, sf, "jobs"), bind(spark, sf, "listings"))


@query("daily_counts", cte("jobs") + f"""
    SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS value FROM b_jobs
    WHERE created_at >= TIMESTAMP '{_START}' GROUP BY 1""")
def daily_counts(spark, sf):
    return ag.daily_counts(bind(spark, sf, "jobs"), "created_at", _START).withColumn(
        "date", F.col("date").cast("string"))


@query("source_breakdown", cte("companies") + """
    SELECT coalesce(discovery_source, 'seed') AS name, count(*) AS value FROM b_companies WHERE is_active GROUP BY 1""")
def source_breakdown(spark, sf):
    return ag.source_breakdown(bind(spark, sf, "companies"))


@query("returning_companies_daily", cte("jobs", "companies") + f"""
    SELECT strftime(j.created_at, '%Y-%m-%d') AS date, count(DISTINCT j.company_id) AS value
    FROM b_jobs j JOIN b_companies c ON j.company_id = c.id
    WHERE j.created_at >= TIMESTAMP '{_START}' AND c.created_at < j.created_at - INTERVAL 1 DAY GROUP BY 1""")
def returning_companies_daily(spark, sf):
    return ag.returning_companies_daily(bind(spark, sf, "jobs"), bind(spark, sf, "companies"), _START).withColumn(
        "date", F.col("date").cast("string"))


@query("distinct_companies_monthly", cte("jobs") + """
    SELECT strftime(date_trunc('month', created_at), '%Y-%m-%d') AS period, count(DISTINCT company_id) AS value FROM b_jobs GROUP BY 1""")
def distinct_companies_monthly(spark, sf):
    # days are stored in two goes, as an evening's jobs would come in, and months are read from the days
    jobs = bind(spark, sf, "jobs")
    morning, evening = (ag.daily_bitmaps(jobs.filter(w), "created_at", "company_id") for w in ("id % 2 = 0", "id % 2 = 1"))
    days = ag.merged_bitmaps(morning, evening)
    return ag.distinct_ids(days, F.date_format(F.date_trunc("month", "date"), "yyyy-MM-dd"))


@query("freshness_histogram", cte("jobs") + f"""
    SELECT t.name, count(j.id) AS value FROM
    (SELECT unnest(['Today', 'Yesterday', '2-7 days', '8-14 days', '15-30 days', '31-60 days', '60+ days', 'No date']) AS name) t
    LEFT JOIN (SELECT id, CASE WHEN posted_at IS NULL THEN 'No date'
        WHEN posted_at >= {_T} - INTERVAL 1 DAY THEN 'Today' WHEN posted_at >= {_T} - INTERVAL 2 DAY THEN 'Yesterday'
        WHEN posted_at >= {_T} - INTERVAL 7 DAY THEN '2-7 days' WHEN posted_at >= {_T} - INTERVAL 14 DAY THEN '8-14 days'
        WHEN posted_at >= {_T} - INTERVAL 30 DAY THEN '15-30 days' WHEN posted_at >= {_T} - INTERVAL 60 DAY THEN '31-60 days'
        ELSE '60+ days' END AS name FROM b_jobs WHERE is_active) j ON j.name = t.name GROUP BY 1""")
def freshness_histogram(spark, sf):
    return ag.freshness_histogram(bind(spark, sf, "jobs"), AS_OF).select("name", "value")


@query("analytics_totals", cte("companies", "jobs", "snapshots") + f"""
    SELECT * FROM (SELECT count(*) FILTER (WHERE is_active) AS total_companies,
        count(*) FILTER (WHERE created_at >= TIMESTAMP '{_START}') AS companies_added_period FROM b_companies),
    (SELECT count(*) FILTER (WHERE is_active) AS total_jobs,
        count(*) FILTER (WHERE created_at >= TIMESTAMP '{_START}') AS jobs_added_period,
        count(*) FILTER (WHERE NOT is_active AND updated_at >= TIMESTAMP '{_START}') AS jobs_delisted_period FROM b_jobs),
    (SELECT count(*) FILTER (WHERE crawled_at >= TIMESTAMP '{_START}') AS total_crawls_period FROM b_snapshots)""")
def analytics_totals(spark, sf):
    return ag.analytics_totals(bind(spark, sf, "companies"), bind(spark, sf, "jobs"),
                               bind(spark, sf, "snapshots"), _START)


@query("freshness_metrics", cte("jobs") + f"""
    SELECT round(avg(date_diff('second', posted_at, {_T}) / 86400.0), 1)::DOUBLE AS avg_job_age_days,
           count(*) FILTER (WHERE posted_at >= {_T} - INTERVAL 1 DAY) AS jobs_posted_today,
           count(*) FILTER (WHERE posted_at >= {_T} - INTERVAL 7 DAY) AS jobs_posted_week,
           count(*) FILTER (WHERE posted_at >= {_T} - INTERVAL 30 DAY) AS jobs_posted_month FROM b_jobs WHERE is_active""")
def freshness_metrics(spark, sf):
    return ag.freshness_metrics(bind(spark, sf, "jobs"), AS_OF)


_SINCE = "2024-01-15 00:00:00"


@query("system_health", cte("snapshots", "jobs_raw", "matches", "candidates", "jobs") + f"""
    SELECT CASE WHEN jobs_discovered_24h = 0 OR match_yield = 0 OR avg_job_age_days > 14 THEN 'warning'
                WHEN success_rate < 0.9 THEN 'degraded' ELSE 'healthy' END AS status,
           array_to_string(list_filter([
             CASE WHEN success_rate < 0.9 THEN 'Crawl success rate below 90%' END,
             CASE WHEN jobs_discovered_24h = 0 THEN 'No jobs discovered in last 24 hours' END,
             CASE WHEN match_yield = 0 THEN 'No matches generated' END,
             CASE WHEN avg_job_age_days > 14 THEN 'Average job age exceeds 14 days' END], lambda x: x IS NOT NULL), '|') AS issues,
           success_rate, match_yield, avg_job_age_days, avg_match_score, jobs_discovered_24h, total_crawls_24h
    FROM (SELECT round(count(*) FILTER (WHERE status_code = 200) / count(*), 3) AS success_rate, count(*) AS total_crawls_24h
          FROM b_snapshots WHERE crawled_at >= TIMESTAMP '{_SINCE}') a,
         (SELECT count(*) AS jobs_discovered_24h FROM b_jobs_raw WHERE extracted_at >= TIMESTAMP '{_SINCE}') b,
         (SELECT round(m.n / c.n, 2) AS match_yield, round(m.s, 3) AS avg_match_score FROM
           (SELECT count(*) AS n, avg(score) AS s FROM b_matches WHERE created_at >= TIMESTAMP '2001-01-01') m,
           (SELECT count(*) AS n FROM b_candidates WHERE is_active) c) d,
         (SELECT round(avg(date_diff('second', posted_at, {_T}) / 86400.0), 1)::DOUBLE AS avg_job_age_days
          FROM b_jobs WHERE is_active) e""")
def system_health(spark, sf):
    crawl = ag.crawl_metrics(bind(spark, sf, "snapshots"), bind(spark, sf, "jobs_raw"), _SINCE)
    match = ag.matching_metrics(bind(spark, sf, "matches"), bind(spark, sf, "candidates"), "2001-01-01 00:00:00")
    fresh = ag.freshness_metrics(bind(spark, sf, "jobs"), AS_OF)
    return ag.system_health(crawl, match, fresh).select(
        "status", F.array_join("issues", "|").alias("issues"), "success_rate", "match_yield",
        "avg_job_age_days", "avg_match_score", "jobs_discovered_24h", "total_crawls_24h")


@query("extraction_metrics", cte("jobs_raw", "jobs") + """
    SELECT raw_jobs_24h, normalized_jobs_24h,
           CASE WHEN raw_jobs_24h > 0 THEN round(normalized_jobs_24h / raw_jobs_24h, 3) ELSE 0.0 END AS extraction_success_rate FROM
    (SELECT count(*) AS raw_jobs_24h FROM b_jobs_raw WHERE extracted_at >= TIMESTAMP '2001-07-01'),
    (SELECT count(*) AS normalized_jobs_24h FROM b_jobs WHERE created_at >= TIMESTAMP '2001-07-01')""")
def extraction_metrics(spark, sf):
    return ag.extraction_metrics(bind(spark, sf, "jobs_raw"), bind(spark, sf, "jobs"), "2001-07-01 00:00:00")


@query("verification_run", cte("listings") + """
    SELECT board, count(*) AS jobs_checked, count(*) FILTER (WHERE found) AS jobs_found,
           count(*) FILTER (WHERE NOT found) AS jobs_unique,
           round(count(*) FILTER (WHERE NOT found) / count(*), 6) AS uniqueness_rate FROM b_listings GROUP BY 1""")
def verification_run(spark, sf):
    return ag.verification_run(bind(spark, sf, "listings")).withColumn("uniqueness_rate", F.round("uniqueness_rate", 6))


@query("failure_breakdown", """
    SELECT CASE l_returnflag WHEN 'R' THEN 'timeout' ELSE 'http_404' END AS reason, count(*) AS count
    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1""")
def failure_breakdown(spark, sf):
    from ..bindings import load

    results = load(spark, sf, "lineitem").select(
        (F.col("l_linestatus") == "O").alias("success"),
        F.when(F.col("l_returnflag") == "R", "timeout").otherwise("http_404").alias("reason"))
    return ag.failure_breakdown(results)


@query("family_availability", cte("jobs") + """
    SELECT role_family, count(*) AS jobs FROM b_jobs WHERE is_active AND created_at >= TIMESTAMP '2001-08-02' - INTERVAL 7 DAY GROUP BY 1""")
def family_availability(spark, sf):
    return ag.family_availability(bind(spark, sf, "jobs"), AS_OF)


@query("seniority_availability", cte("jobs") + """
    SELECT seniority, count(*) AS jobs FROM b_jobs WHERE is_active AND created_at >= TIMESTAMP '2001-08-02' - INTERVAL 7 DAY GROUP BY 1""")
def seniority_availability(spark, sf):
    return ag.seniority_availability(bind(spark, sf, "jobs"), AS_OF)


@query("run_summary", cte("runs") + """
    SELECT stage AS source, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS new,
           0::BIGINT AS duplicate, 0::BIGINT AS non_us, 0::BIGINT AS updated,
           count(*) FILTER (WHERE status = 'running') AS queued,
           count(*) FILTER (WHERE status = 'failed') AS error FROM b_runs GROUP BY 1""")
def run_summary(spark, sf):
    named = F.when(F.col("status") == "completed", "new").when(F.col("status") == "failed", "error").otherwise("queued")
    return ag.run_summary(bind(spark, sf, "runs").select(F.col("stage").alias("source"), named.alias("outcome")))
