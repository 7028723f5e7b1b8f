"""Source and sink queries: what is written with declared schemas and formats is read back, whole tables at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, bind, cte, load, pick
from ..functions import classify as cl, text as tx
from ..functions.core import iso
from ..plans import analytics as an
from ..session import new_folder
from ..sources import tables as st
from . import query

_T = f"TIMESTAMP '{AS_OF}'"


@query("typed_table", cte("jobs") + """
    SELECT id::VARCHAR AS id, company_id::VARCHAR AS company_id, title, role_family, min_salary, strftime(posted_at, '%Y-%m-%d %H:%M:%S') AS posted_at,
      array_to_string(skills, '|') AS skills, NULL::VARCHAR AS enrich_failed_at FROM b_jobs""")
def typed_table(spark, sf):
    """A version of a table, read with its declared schema; a column that the files lack is null."""
    jobs = bind(spark, sf, "jobs").withColumns({c: F.col(c).cast("string") for c in ("id", "company_id")})
    path = st.write_version(jobs, new_folder(spark, "jobs"), "1")
    return st.read_table(spark, "jobs", path).select(
        "id", "company_id", "title", "role_family", "min_salary", iso("posted_at").alias("posted_at"),
        F.array_join("skills", "|").alias("skills"), iso("enrich_failed_at").alias("enrich_failed_at"))


@query("payload_files", """
    SELECT CASE s_suppkey % 2 WHEN 0 THEN 'lever' ELSE 'greenhouse' END AS ats_type, 's' || s_suppkey AS company_id, unnest(['Engineer ' || s_name, 'Designer ' || s_suppkey]) AS title FROM supplier""")
def payload_files(spark, sf):
    """One JSON document per board under its platform's and its own folder."""
    from ..operators.extract import extract_payload_jobs

    docs = load(spark, sf, "supplier").select(
        F.expr("CASE s_suppkey % 2 WHEN 0 THEN 'lever' ELSE 'greenhouse' END").alias("ats_type"), F.concat(F.lit("s"), "s_suppkey").alias("ats_identifier"),
        F.expr("""CASE s_suppkey % 2 WHEN 0 THEN concat('[{"text":"Engineer ', s_name, '"},{"text":"Designer ', s_suppkey, '"}]')
                  ELSE concat('{"jobs":[{"title":"Engineer ', s_name, '"},{"title":"Designer ', s_suppkey, '"}]}') END""").alias("value"))
    path = new_folder(spark, "payloads")
    st.write_payload_files(docs, path)
    return extract_payload_jobs(st.read_payload_files(spark, path)).select("ats_type", "company_id", "title")


@query("payload_table", """
    SELECT o_orderkey::VARCHAR AS company_id, CASE o_orderkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS ats_type, '{"jobs":"' || o_orderpriority || '"}' AS body FROM orders""")
def payload_table(spark, sf):
    """Fetched documents as a table."""
    path = new_folder(spark, "payload-table")
    load(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS company_id", "CASE o_orderkey % 2 WHEN 0 THEN 'lever' ELSE 'ashby' END AS ats_type",
                                         """concat('{"jobs":"', o_orderpriority, '"}') AS body""").write.parquet(path)
    return st.read_payloads(spark, path).select("company_id", "ats_type", "body")


@query("page_table", "SELECT page_id::VARCHAR AS page_id, url, md5(html) AS digest FROM pages")
def page_table(spark, sf):
    """S3: page snapshots with their declared schema."""
    path = new_folder(spark, "pages")
    load(spark, sf, "pages").withColumn("page_id", F.col("page_id").cast("string")).write.parquet(path)
    return st.read_pages(spark, path).select("page_id", "url", F.md5("html").alias("digest"))


@query("feed_items", """
    SELECT s_name AS title, 'https://news.example/' || s_suppkey AS link, CASE WHEN s_suppkey % 2 = 0 THEN s_comment_or_name END AS description,
      CASE WHEN s_suppkey % 2 = 0 THEN 'Fri, 05 Jan 2024 08:00:00 +0000' ELSE '2024-01-05T08:00:00Z' END AS pub_date, CASE WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'atom' END AS feed_name
    FROM (SELECT *, s_name || ' & co' AS s_comment_or_name FROM supplier)""")
def feed_items(spark, sf):
    """RSS items with a link as text, Atom entries with a link as an attribute beside a link to the feed itself."""
    s = load(spark, sf, "supplier")
    url = F.concat(F.lit("https://news.example/"), "s_suppkey")
    rss = s.filter("s_suppkey % 2 = 0").select(F.col("s_name").alias("title"), url.alias("link"), F.concat("s_name", F.lit(" & co")).alias("description"),
                                               F.lit("Fri, 05 Jan 2024 08:00:00 +0000").alias("pubDate"))
    own, page = (F.struct(F.lit(None).cast("string").alias("_VALUE"), h.alias("_href"), r.alias("_rel")) for h, r in (
        (F.lit("https://news.example/feed"), F.lit("self")), (url, F.lit(None).cast("string"))))
    atom = s.filter("s_suppkey % 2 = 1").select(F.col("s_name").alias("title"), F.array(own, page).alias("link"), F.lit("2024-01-05T08:00:00Z").alias("published"))
    path = new_folder(spark, "feeds")
    rss.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(f"{path}/rss")
    atom.write.format("xml").option("rowTag", "entry").option("rootTag", "feed").save(f"{path}/atom")
    return st.read_feed_items(spark, f"{path}/rss", "rss").unionByName(st.read_feed_items(spark, f"{path}/atom", "atom", "entry")).select(
        "title", "link", "description", "pub_date", "feed_name")


@query("report_rows", cte("companies") + """
    SELECT 'failures' AS part, id::BIGINT AS id, NULL::BIGINT AS n FROM b_companies WHERE NOT is_active
    UNION ALL SELECT 'summary', NULL, count(*) FROM b_companies""")
def report_rows(spark, sf):
    """The report's two folders, read back."""
    c, path = bind(spark, sf, "companies").select("id", "is_active"), new_folder(spark, "report")
    st.write_report(c.filter("NOT is_active"), c.agg(F.count("*").alias("n")), path)
    failures = spark.read.schema("id bigint").json(f"{path}/failures").select(F.lit("failures").alias("part"), "id", F.lit(None).cast("bigint").alias("n"))
    return failures.unionByName(spark.read.schema("n bigint").json(f"{path}/summary").select(
        F.lit("summary").alias("part"), F.lit(None).cast("bigint").alias("id"), "n"))


@query("us_domain", """
    SELECT c_custkey AS id, c_custkey % 4 < 2 AS is_us FROM customer""")
def us_domain(spark, sf):
    """L18."""
    d = F.expr("concat('c', c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.us' WHEN 1 THEN '.ca.us' WHEN 2 THEN '.com' END)")
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), cl.is_us_domain(d).alias("is_us"))


@query("in_or_unconstrained", cte("candidates") + """
    SELECT id, len(location_types) = 0 OR coalesce(v, '') = '' OR list_contains(location_types, v) AS passes
    FROM (SELECT *, CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN '' END AS v FROM b_candidates)""")
def in_or_unconstrained(spark, sf):
    """a value in the row's own list, or no constraint."""
    v = F.expr("CASE id % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'onsite' WHEN 2 THEN '' END")
    return bind(spark, sf, "candidates").select("id", tx.in_or_unconstrained(v, "location_types").alias("passes"))


_START = "2001-05-04 00:00:00"
_DAY = "strftime({c}, '%Y-%m-%d')"


def _daily(frame: str, table: str, at: str, where: str = "TRUE") -> str:
    return f"SELECT '{frame}' AS frame, {_DAY.format(c=at)} AS name, count(*) AS value FROM {table} WHERE {at} >= TIMESTAMP '{_START}' AND {where} GROUP BY 2"


_AGES = [("Today", 1), ("Yesterday", 2), ("2-7 days", 7), ("8-14 days", 14), ("15-30 days", 30), ("31-60 days", 60)]


@query("analytics_bundle", cte("companies", "jobs", "snapshots") + " SELECT * FROM (" + " UNION ALL ".join([
    _daily("crawls_per_day", "b_snapshots", "crawled_at"), _daily("new_companies_per_day", "b_companies", "created_at"),
    _daily("new_jobs_per_day", "b_jobs", "created_at"),
    _daily("delisted_jobs_per_day", "b_jobs", "updated_at", "NOT is_active AND updated_at <> created_at"),
    f"""SELECT 'companies_with_new_jobs_per_day', {_DAY.format(c='j.created_at')}, count(DISTINCT j.company_id) FROM b_jobs j JOIN b_companies c ON j.company_id = c.id
        WHERE j.created_at >= TIMESTAMP '{_START}' AND c.created_at < j.created_at - INTERVAL 1 DAY GROUP BY 2""",
    "SELECT 'sources', coalesce(discovery_source, 'seed'), count(*) FROM b_companies WHERE is_active GROUP BY 2",
    "SELECT 'job_freshness', t.name, count(j.id) FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n, _ in _AGES) + ", '60+ days', 'No date']) AS name) t "
    "LEFT JOIN (SELECT id, CASE WHEN posted_at IS NULL THEN 'No date' " + " ".join(f"WHEN posted_at >= {_T} - INTERVAL {d} DAY THEN '{n}'" for n, d in _AGES)
    + " ELSE '60+ days' END AS name FROM b_jobs WHERE is_active) j ON j.name = t.name GROUP BY 2",
    "SELECT 'totals', 'total_companies', count(*) FROM b_companies WHERE is_active",
    f"SELECT 'totals', 'companies_added_period', count(*) FROM b_companies WHERE created_at >= TIMESTAMP '{_START}'",
    "SELECT 'totals', 'total_jobs', count(*) FROM b_jobs WHERE is_active",
    f"SELECT 'totals', 'jobs_added_period', count(*) FROM b_jobs WHERE created_at >= TIMESTAMP '{_START}'",
    f"SELECT 'totals', 'jobs_delisted_period', count(*) FROM b_jobs WHERE NOT is_active AND updated_at >= TIMESTAMP '{_START}'",
    f"SELECT 'totals', 'total_crawls_period', count(*) FROM b_snapshots WHERE crawled_at >= TIMESTAMP '{_START}'"]) + ")")
def analytics_bundle(spark, sf):
    """V6: all eight frames as (frame, name, value) rows."""
    frames = an.analytics(bind(spark, sf, "companies"), bind(spark, sf, "jobs"), bind(spark, sf, "snapshots"), AS_OF, days=90)
    out = None
    for frame, df in frames.items():
        if frame == "totals":
            df = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("value")) for c in df.columns])).alias("t")).select("t.*")
        name = F.col("date").cast("string") if "date" in df.columns else F.col("name")
        rows = df.select(F.lit(frame).alias("frame"), name.alias("name"), F.col("value").cast("bigint").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
