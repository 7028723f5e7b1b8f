"""Per-key and snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import bind, cte, load
from ..functions import text as tx
from ..functions.core import iso
from ..operators import windows as wn
from . import query


def _hashed(spark, sf):
    return bind(spark, sf, "snapshots").withColumn("html_hash", tx.content_hash("html"))


@query("latest_snapshot", cte("snapshots") + """
    SELECT company_id, id, html, status_code::BIGINT AS status_code FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY crawled_at DESC, id DESC) AS rn FROM b_snapshots) WHERE rn = 1""")
def latest_snapshot(spark, sf):
    return wn.latest_per(bind(spark, sf, "snapshots"), ["company_id"], "crawled_at", "id").select(
        "company_id", "id", "html", F.col("status_code").cast("bigint").alias("status_code"))


@query("dedup_first", cte("discovered") + """
    SELECT row_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(website_url) ORDER BY source_rank, discovered_at, row_id) AS rn
      FROM b_discovered) WHERE rn = 1 OR website_url IS NULL""")
def dedup_first(spark, sf):
    d = bind(spark, sf, "discovered")
    return wn.dedup_first(d, F.col("website_url"), ["source_rank", "discovered_at", "row_id"]).select("row_id", "source")


@query("top_k_per_key", cte("matches") + """
    SELECT candidate_id, job_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) AS rank
      FROM b_matches) WHERE rank <= 10""")
def top_k_per_key(spark, sf):
    return wn.top_k(bind(spark, sf, "matches"), "candidate_id", 10, F.desc("score"), F.asc("job_id")).select(
        "candidate_id", "job_id", F.col("rank").cast("bigint").alias("rank"))


@query("changed_snapshots", cte("snapshots") + """
    SELECT company_id, id FROM (SELECT *, lag(html) OVER (PARTITION BY company_id ORDER BY crawled_at, id) AS before FROM b_snapshots)
    WHERE before IS NULL OR before <> html""")
def changed_snapshots(spark, sf):
    kept, _ = wn.changed_snapshots(_hashed(spark, sf))
    return kept.select("company_id", "id")


@query("last_crawled", cte("snapshots") + """
    SELECT company_id, strftime(max(crawled_at), '%Y-%m-%d %H:%M:%S') AS last_crawled_at FROM b_snapshots GROUP BY 1""")
def last_crawled(spark, sf):
    _, last = wn.changed_snapshots(_hashed(spark, sf))
    return last.select("company_id", iso("last_crawled_at").alias("last_crawled_at"))


@query("first_links", """
    SELECT page_id, link, rank FROM (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1)::BIGINT AS rank FROM (
      SELECT page_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:3] AS l FROM (
        SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)))""")
def first_links(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "html")
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return wn.first_links(p, links, 3).select("page_id", "link", F.col("rank").cast("bigint").alias("rank"))
