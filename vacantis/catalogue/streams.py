"""Streaming queries: the events table read as a stream, checked against batch SQL.

Each query drains the files that are there (available-now) and returns the
stream's result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import _SPARK, AS_OF, AS_OF_EVENTS, bind, cte, load
from ..functions.core import iso
from ..streaming import streams as sm
from . import ORACLES, discovery, query, upserts  # noqa: F401  whose checks hold for the streams too


def _events(spark, sf):
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query("stream_crawl_series", cte("snapshots") + """
    SELECT strftime(date_trunc('day', crawled_at), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS crawls, count(*) FILTER (WHERE status_code = 200) AS successes,
      round(count(*) FILTER (WHERE status_code = 200) / count(*), 3) AS success_rate FROM b_snapshots GROUP BY 1""")
def stream_crawl_series(spark, sf):
    e = _events(spark, sf).select(F.expr("CASE WHEN event_type = 'error' THEN 500 ELSE 200 END").alias("status_code"),
                                  F.col("ts").cast("timestamp").alias("crawled_at"))
    out = sm.run_to_table(sm.crawl_series(e), "complete")
    return out.select(iso("start").alias("start"), "crawls", "successes", "success_rate")


@query("stream_changed_pages", cte("snapshots") + """
    SELECT company_id, id FROM (SELECT *, lag(html) OVER (PARTITION BY company_id ORDER BY crawled_at, id) AS before FROM b_snapshots)
    WHERE before IS NULL OR before <> html""")
def stream_changed_pages(spark, sf):
    e = _events(spark, sf).select(
        F.col("user_id").alias("company_id"), F.col("event_id").alias("id"),
        F.concat("event_type", F.get_json_object("props", "$.k").cast("bigint") % 3).alias("html"), F.col("ts").cast("timestamp").alias("crawled_at"))
    return sm.run_changes(e).select("company_id", "id")


@query("stream_first_domains", """
    SELECT 'u' || user_id || '.com' AS domain FROM events GROUP BY user_id""")
def stream_first_domains(spark, sf):
    e = _events(spark, sf).select(F.concat(F.lit("https://www.u"), "user_id", F.lit(".com/x")).alias("website_url"),
                                  F.lit(None).cast("string").alias("careers_url"), F.col("ts").cast("timestamp").alias("discovered_at"))
    return sm.run_to_table(sm.first_per_domain(e)).select("domain")


@query("stream_sessions", """
    SELECT user_id AS candidate_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS clicks FROM (
      SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
        FROM events WHERE event_type = 'click')) GROUP BY user_id, s""")
def stream_sessions(spark, sf):
    e = _events(spark, sf).filter("event_type = 'click'").select(F.col("user_id").alias("candidate_id"), F.col("ts").cast("timestamp").alias("at"))
    out = sm.run_to_table(sm.engagement_sessions(e), "complete")
    return out.select("candidate_id", iso("start").alias("start"), "clicks")


def _bound(spark, sf, name: str, table: str):
    """A product table as a stream over the one driver table it is derived from."""
    rows = spark.readStream.schema(load(spark, sf, table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)
    return spark.sql(_SPARK[name][1].replace(f"FROM {table}", "FROM {rows}"), rows=rows)


@query("stream_normalize", ORACLES["normalize_jobs"])
def stream_normalize(spark, sf):
    out = sm.run_to_table(sm.normalize_stream(_bound(spark, sf, "jobs_raw", "orders"), AS_OF))
    return out.select(F.col("raw_job_id").alias("id"), "role_family", "role_specialization", "seniority", "location_type", "employment_type",
                      "min_salary", "max_salary", iso("posted_at").alias("posted_at"), F.round("freshness_score", 6).alias("freshness"))


@query("stream_discover", ORACLES["discover_outcomes"])
def stream_discover(spark, sf):
    return sm.run_discovery(_bound(spark, sf, "discovered", "events"), bind(spark, sf, "companies"), bind(spark, sf, "queue"), AS_OF_EVENTS)


@query("stream_engagement", ORACLES["match_events"])
def stream_engagement(spark, sf):
    schema = load(spark, sf, "lineitem").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf).selectExpr(
        "l_suppkey AS candidate_id", "l_orderkey AS job_id", "CASE WHEN l_linenumber % 2 = 0 THEN 'shown' ELSE 'clicked' END AS kind", "CAST(l_shipdate AS TIMESTAMP) AS at")
    target = bind(spark, sf, "matches").withColumn("clicked_at", F.lit(None).cast("timestamp"))
    return sm.run_engagement(e, target).select("candidate_id", "job_id", iso("shown_at").alias("shown_at"), iso("clicked_at").alias("clicked_at"))


@query("stream_crawl_sliding", cte("snapshots") + """, w AS (SELECT *, unnest(range(24)) AS h FROM b_snapshots)
    SELECT strftime(date_trunc('hour', crawled_at) - to_hours(h), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS crawls, count(*) FILTER (WHERE status_code = 200) AS successes,
      round(count(*) FILTER (WHERE status_code = 200) / count(*), 3) AS success_rate FROM w GROUP BY 1""")
def stream_crawl_sliding(spark, sf):
    e = _events(spark, sf).select(F.expr("CASE WHEN event_type = 'error' THEN 500 ELSE 200 END").alias("status_code"),
                                  F.col("ts").cast("timestamp").alias("crawled_at"))
    out = sm.run_to_table(sm.crawl_series(e, "24 hours", "1 hour"), "complete")
    return out.select(iso("start").alias("start"), "crawls", "successes", "success_rate")


# views show a match, clicks may follow within two days
@query("stream_attribution", """
    WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS job FROM events)
    SELECT c.event_id AS click_id, strftime(max(v.ts), '%Y-%m-%d %H:%M:%S.%f') AS shown_at
    FROM e c LEFT JOIN e v ON v.event_type = 'view' AND v.user_id = c.user_id AND v.job = c.job AND v.ts <= c.ts AND v.ts >= c.ts - INTERVAL 2 DAY
    WHERE c.event_type = 'click' GROUP BY 1""")
def stream_attribution(spark, sf):
    e = _events(spark, sf).filter("event_type IN ('view', 'click')").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("candidate_id"), (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("job_id"),
        F.expr("CASE event_type WHEN 'view' THEN 'shown' ELSE 'clicked' END").alias("kind"), F.col("ts").cast("timestamp").alias("at"))
    return sm.run_attribution(e, "2 days").select("click_id", F.date_format("shown_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("shown_at"))
