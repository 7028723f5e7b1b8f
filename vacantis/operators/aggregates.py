"""Counts, rates, funnels, histograms and time series (A-operators).

Each table is aggregated in one pass with conditional counts; partial
aggregation keeps the shuffle at one row per group and partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as dt, text as tx
from ..functions.core import ago, is_blank, ts
from ..rules import misc


def count_if(cond: Column) -> Column:
    """A3."""
    return F.count_if(cond)


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, as scalar subqueries."""
    spark = frames[0].sparkSession
    out = spark.range(1)
    cols = []
    for i, f in enumerate(frames):
        out = out.withColumn(f"__{i}", f.select(F.struct("*")).scalar())
        cols += [F.col(f"__{i}.{c}").alias(c) for c in f.columns]
    return out.select(*cols)


def percent(a: Column, b: Column, scale: int = 1) -> Column:
    """100 a / b rounded, zero when b is zero."""
    return F.when(b > 0, F.round(F.lit(100.0) * a / b, scale)).otherwise(F.lit(0.0))


def system_metrics(companies, jobs, candidates, matches, as_of) -> DataFrame:
    """A1."""
    day, week = ago(as_of, days=1), ago(as_of, days=7)
    return one_row(
        companies.agg(F.count("*").alias("total_companies"), count_if(F.col("is_active")).alias("active_companies")),
        jobs.agg(F.count("*").alias("total_jobs"), count_if(F.col("is_active")).alias("active_jobs"),
                 count_if(F.col("created_at") >= day).alias("jobs_last_24h"),
                 count_if(F.col("created_at") >= week).alias("jobs_last_7d")),
        candidates.agg(F.count("*").alias("total_candidates"),
                       count_if(F.col("is_active")).alias("active_candidates")),
        matches.agg(F.count("*").alias("total_matches"),
                    count_if(F.col("created_at") >= day).alias("matches_last_24h"),
                    F.avg("score").alias("avg_match_score")))


def count_by(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """A2: rows per value, largest first."""
    if not keep_null:
        df = df.filter(F.col(column).isNotNull())
    return df.groupBy(column).agg(F.count("*").alias("count")).orderBy(F.desc("count"), column)


def ats_stats(companies: DataFrame) -> DataFrame:
    """A4: companies with and without a platform, and those worth a detection run."""
    none = F.col("ats_type").isNull()
    return companies.agg(
        count_if(~none).alias("total_with_ats"), count_if(none).alias("total_without_ats"),
        count_if(none & F.col("careers_url").isNotNull() & F.col("is_active")).alias("needs_discovery"))


def ats_companies_and_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """A4: active companies and active jobs per platform.

    Jobs are counted per company before the join.
    """
    per = jobs.filter(F.col("is_active")).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    return (companies.filter(F.col("ats_type").isNotNull()).join(per, "id", "left").groupBy("ats_type")
            .agg(count_if(F.col("is_active")).alias("companies"),
                 F.coalesce(F.sum("n"), F.lit(0)).alias("jobs"))
            .filter(F.col("companies") > 0))


def ats_funnel(companies: DataFrame, max_attempts: int = 2) -> DataFrame:
    """A5: stages of platform detection over active companies."""
    live, kind, tries = F.col("is_active"), F.col("ats_type"), F.col("ats_detection_attempts")
    return companies.agg(
        count_if(live & kind.isNull() & (tries.isNull() | (tries == 0))).alias("never_tried"),
        count_if(live & kind.isNull() & (tries > 0) & (tries < max_attempts)).alias("tried_pending"),
        count_if(live & kind.isNull() & (tries >= max_attempts)).alias("exhausted"),
        count_if(live & kind.isNotNull()).alias("detected"),
        count_if(live & (kind == "custom")).alias("custom"),
        count_if(live & (kind == "uses_parent_ats")).alias("uses_parent"))


def crawl_stats(companies: DataFrame) -> DataFrame:
    """A6."""
    return (companies.groupBy(F.coalesce("ats_type", F.lit("unknown")).alias("ats_type"))
            .agg(F.count("*").alias("total"), F.count("careers_url").alias("with_careers"),
                 F.count("last_crawled_at").alias("crawled")).orderBy(F.desc("total"), "ats_type"))


def crawl_stage(companies: DataFrame, as_of) -> DataFrame:
    """Crawled and due companies per platform."""
    day = ago(as_of, hours=24)
    return (companies.filter(F.col("is_active") & F.col("ats_type").isNotNull()).groupBy("ats_type")
            .agg(F.count("*").alias("total"),
                 count_if(F.col("last_crawled_at") > day).alias("crawled_today"),
                 count_if(dt.stale("last_crawled_at", as_of, hours=24)).alias("needs_crawl"))
            .orderBy(F.desc("total"), "ats_type"))


def job_changes(jobs: DataFrame, as_of) -> DataFrame:
    """All jobs, added and updated in the last day."""
    day = ago(as_of, hours=24)
    return jobs.agg(F.count("*").alias("total"), count_if(F.col("created_at") > day).alias("added_today"),
                    count_if(F.col("updated_at") > day).alias("updated_today"))


def _jobs_with_ats(jobs: DataFrame, companies: DataFrame, *cols) -> DataFrame:
    c = companies.select(F.col("id").alias("company_id"), "ats_type")
    return jobs.filter(F.col("is_active")).select("company_id", *cols).join(c, "company_id", "inner")


def enrich_stage(jobs: DataFrame, companies: DataFrame, as_of) -> DataFrame:
    """Description coverage per platform."""
    hour = ago(as_of, hours=1)
    total, done = F.count("*"), F.count("description")
    return (_jobs_with_ats(jobs, companies, "description", "updated_at")
            .groupBy(F.coalesce("ats_type", F.lit("unknown")).alias("ats_type"))
            .agg(total.alias("total"), done.alias("with_description"),
                 (total - done).alias("needs_enrichment"),
                 count_if(F.col("updated_at") > hour).alias("enriched_recently"),
                 percent(done, total).alias("percent_complete"))
            .orderBy(F.desc("total"), "ats_type"))


def embedding_stage(jobs: DataFrame) -> DataFrame:
    """A9."""
    gone, live = F.col("embedding").isNull(), F.col("is_active")
    total, have = F.count("*"), count_if(~gone)
    return jobs.agg(total.alias("total_jobs"), have.alias("with_embeddings"),
                    count_if(gone).alias("without_embeddings"),
                    count_if(live & gone).alias("active_without_embeddings"),
                    count_if(~live & gone).alias("inactive_without_embeddings"),
                    percent(count_if(live & ~gone), count_if(live)).alias("percent_complete"))


def pipeline_stats(companies: DataFrame, jobs: DataFrame, as_of) -> DataFrame:
    """A10: backlog of every stage."""
    live, kind, tries = F.col("is_active"), F.col("ats_type"), F.col("ats_detection_attempts")
    untried = count_if(live & kind.isNull() & (tries.isNull() | (tries == 0)))
    pending = count_if(live & kind.isNull() & (tries > 0) & (tries < 2))
    return one_row(
        companies.agg(
            count_if(live & kind.isNotNull() & dt.stale("last_crawled_at", as_of, hours=24)).alias("companies_ready_to_crawl"),
            (untried + pending).alias("companies_pending_ats"), untried.alias("ats_never_tried"),
            pending.alias("ats_tried_pending"),
            count_if(live & kind.isNull() & (tries >= 2)).alias("ats_exhausted")),
        jobs.agg(count_if(live & is_blank("description")).alias("jobs_missing_description"),
                 count_if(live & F.col("embedding").isNull()).alias("jobs_missing_embeddings")))


def maintenance_by_ats(companies: DataFrame, jobs: DataFrame, as_of) -> DataFrame:
    """Listings health per platform, companies without jobs included.

    Jobs are folded to one row per company first, so the join is one to one
    and distinct companies become a plain count.
    """
    live, seen = F.col("is_active"), F.col("last_verified_at")
    per = jobs.groupBy("company_id").agg(
        F.count("*").alias("n"), count_if(live).alias("live"),
        count_if(~live & F.col("delisted_at").isNotNull()).alias("gone"),
        count_if(live & dt.stale("last_verified_at", as_of, days=7)).alias("due"),
        F.sum(dt.days_since("last_verified_at", as_of)).alias("days"), F.count(seen).alias("seen"))
    c = (companies.filter(F.col("is_active") & F.col("careers_url").isNotNull())
         .select(F.col("id").alias("company_id"), F.coalesce("ats_type", F.lit("unknown")).alias("ats_type")))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    return (c.join(per, "company_id", "left").groupBy("ats_type")
            .agg(F.count("*").alias("companies"), total("n").alias("total_jobs"),
                 total("live").alias("active_jobs"), total("gone").alias("delisted_jobs"),
                 total("due").alias("pending_verification"),
                 (F.sum("days") / F.nullif(F.sum("seen"), F.lit(0))).alias("avg_days_since_verified"))
            .orderBy(F.desc("companies"), "ats_type"))


def maintenance_totals(companies: DataFrame, jobs: DataFrame, as_of) -> DataFrame:
    """Jobs and companies due, verified and delisted."""
    live = F.col("is_active")
    listed = companies.filter(live & F.col("careers_url").isNotNull())
    due = (jobs.filter(live & dt.stale("last_verified_at", as_of, days=7))
           .join(listed.select(F.col("id").alias("company_id")), "company_id", "left_semi")
           .agg(F.count("*").alias("jobs_pending_verification")))
    return one_row(
        due,
        jobs.agg(count_if(F.col("last_verified_at") > ago(as_of, hours=24)).alias("jobs_verified_24h"),
                 count_if(~live & (F.col("delisted_at") > ago(as_of, days=7))).alias("jobs_delisted_7d")),
        companies.agg(
            count_if(live & F.col("careers_url").isNotNull()
                     & dt.stale("last_maintenance_at", as_of, days=7)).alias("companies_pending_maintenance"),
            count_if(F.col("last_maintenance_at") > ago(as_of, hours=24)).alias("companies_maintained_24h")))


def _platform_totals(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    total, done, vec = F.count("*"), F.count("description"), F.count("embedding")
    return (_jobs_with_ats(jobs, companies, "description", "embedding").groupBy("ats_type")
            .agg(total.alias("total_jobs"), done.alias("with_description"),
                 (total - done).alias("needs_enrichment"), vec.alias("with_embeddings")))


def supported_summary(jobs: DataFrame, companies: DataFrame, supported=None) -> DataFrame:
    """Per platform, then supported against the rest."""
    kind = F.when(F.col("ats_type").isin(supported or misc.SUPPORTED_PLATFORMS), F.lit("supported")).otherwise(F.lit("unsupported"))
    names = ["total_jobs", "with_description", "needs_enrichment", "with_embeddings"]
    out = (_platform_totals(jobs, companies).groupBy(kind.alias("category"))
           .agg(*[F.sum(n).alias(n) for n in names]))
    return out.withColumn("percent_enriched", percent(F.col("with_description"), F.col("total_jobs"))) \
              .withColumn("percent_embedded", percent(F.col("with_embeddings"), F.col("total_jobs")))


def supported_by_ats(jobs: DataFrame, companies: DataFrame, as_of, supported=None) -> DataFrame:
    """Per supported platform with companies ready to crawl, none = 0."""
    names = supported or misc.SUPPORTED_PLATFORMS
    ready = (companies.filter(F.col("is_active") & F.col("ats_type").isin(names)
                              & dt.stale("last_crawled_at", as_of, hours=24))
             .groupBy("ats_type").agg(F.count("*").alias("ready_to_crawl")))
    known = companies.filter(F.col("ats_type").isin(names))
    return (_platform_totals(jobs, known).join(ready, "ats_type", "left")
            .withColumn("ready_to_crawl", F.coalesce("ready_to_crawl", F.lit(0)))
            .withColumn("percent_enriched", percent(F.col("with_description"), F.col("total_jobs")))
            .orderBy(F.desc("total_jobs"), "ats_type"))


def discovery_stats(queue: DataFrame) -> DataFrame:
    """A13."""
    is_ = lambda s: count_if(F.col("status") == s)
    return queue.groupBy("source").agg(F.count("*").alias("total"), is_("completed").alias("completed"),
                                       is_("pending").alias("pending"), is_("failed").alias("failed"))


def queue_by_status(queue: DataFrame) -> DataFrame:
    """Five states, zero when empty."""
    one = queue.agg(*[count_if(F.col("status") == s).alias(s) for s in misc.QUEUE_STATUSES])
    rows = F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("count")) for s in misc.QUEUE_STATUSES])
    return one.select(F.inline(rows))


def recent_by_source(queue: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """A14."""
    return count_by(queue.filter(F.col("created_at") > ago(as_of, hours=hours)), "source")


def company_additions(companies: DataFrame, as_of) -> DataFrame:
    """A14."""
    return companies.agg(F.count("*").alias("total"),
                         count_if(F.col("created_at") > ago(as_of, hours=24)).alias("added_today"),
                         F.count("ats_type").alias("with_ats"))


def dormant_stats(dormant: DataFrame, as_of) -> DataFrame:
    """A15."""
    return dormant.groupBy(F.col("dormant_reason").alias("reason")).agg(
        F.count("*").alias("count"), count_if(F.col("last_checked_at").isNull()).alias("never_checked"),
        count_if(F.col("last_checked_at") < ago(as_of, days=30)).alias("stale"))


def verification_stats(listings: DataFrame) -> DataFrame:
    """A16."""
    n, unique = F.count("*"), count_if(~F.col("found"))
    return listings.groupBy("board").agg(
        n.alias("total_verified"), count_if(F.col("found")).alias("found_on_board"),
        unique.alias("unique_to_us"), F.round(F.lit(100.0) * unique / n, 2).alias("uniqueness_rate_percent"),
        F.max("verified_at").alias("last_verified_at"))


def daily_counts(df: DataFrame, at: str, start) -> DataFrame:
    """A17."""
    return (df.filter(F.col(at) >= ts(start)).groupBy(F.to_date(at).alias("date"))
            .agg(F.count("*").alias("value")).orderBy("date"))


def source_breakdown(companies: DataFrame) -> DataFrame:
    """A18."""
    return (companies.filter(F.col("is_active")).groupBy("discovery_source").agg(F.count("*").alias("value"))
            .select(F.coalesce("discovery_source", F.lit("seed")).alias("name"), "value")
            .orderBy(F.desc("value"), "name"))


def returning_companies_daily(jobs: DataFrame, companies: DataFrame, start) -> DataFrame:
    """Companies older than a day that posted, per day.

    Jobs fold to distinct (company, day) with the newest time first; the age
    test is monotone in that time, so the join sees each pair once.
    """
    pairs = (jobs.filter(F.col("created_at") >= ts(start))
             .groupBy("company_id", F.to_date("created_at").alias("date"))
             .agg(F.max("created_at").alias("__at")))
    c = companies.select(F.col("id").alias("company_id"), F.col("created_at").alias("__since"))
    old = F.col("__since") < F.col("__at") - F.make_interval(days=F.lit(1))
    return (pairs.join(c, "company_id", "inner").filter(old).groupBy("date")
            .agg(F.count("*").alias("value")).orderBy("date"))


def daily_bitmaps(rows: DataFrame, at: str, id_col: str) -> DataFrame:
    """(date, part, ids): which whole-number ids each day has, exactly, as bitmaps of 4 kB per 32,768 ids.

    Days can be stored and added up: see :func:`merged_bitmaps` and :func:`distinct_ids`.
    """
    n = F.col(id_col).cast("long")
    return (rows.filter(n.isNotNull() & F.col(at).isNotNull()).groupBy(F.to_date(at).alias("date"), F.bitmap_bucket_number(n).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("ids")))


def merged_bitmaps(*stored: DataFrame) -> DataFrame:
    """Stored days with further rows of the same or other days: each (date, part) once."""
    every = stored[0]
    for more in stored[1:]:
        every = every.unionByName(more)
    return every.groupBy("date", "part").agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct_ids(bitmaps: DataFrame, period: Column) -> DataFrame:
    """(period, value): distinct ids of every period of days, from the stored days alone."""
    parts = bitmaps.groupBy(period.alias("period"), "part").agg(F.bitmap_count(F.bitmap_or_agg("ids")).alias("n"))
    return parts.groupBy("period").agg(F.sum("n").alias("value"))


def freshness_histogram(jobs: DataFrame, as_of) -> DataFrame:
    """Active jobs by posting age in eight ordered buckets, empty ones included."""
    at = F.col("posted_at")
    label = F.when(at.isNull(), F.lit("No date"))
    for days, name in misc.FRESHNESS_EDGES:
        label = label.when(at >= ago(as_of, days=days), F.lit(name))
    label = label.otherwise(F.lit("60+ days"))
    live = jobs.filter(F.col("is_active")).select(label.alias("b"))
    one = live.agg(*[count_if(F.col("b") == n).alias(n) for n in misc.FRESHNESS_BUCKETS])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(f"`{n}`").alias("value"))
                     for i, n in enumerate(misc.FRESHNESS_BUCKETS)])
    return one.select(F.inline(rows))


def analytics_totals(companies: DataFrame, jobs: DataFrame, snapshots: DataFrame, start) -> DataFrame:
    """A21."""
    s = ts(start)
    return one_row(
        companies.agg(count_if(F.col("is_active")).alias("total_companies"),
                      count_if(F.col("created_at") >= s).alias("companies_added_period")),
        jobs.agg(count_if(F.col("is_active")).alias("total_jobs"),
                 count_if(F.col("created_at") >= s).alias("jobs_added_period"),
                 count_if(~F.col("is_active") & (F.col("updated_at") >= s)).alias("jobs_delisted_period")),
        snapshots.agg(count_if(F.col("crawled_at") >= s).alias("total_crawls_period")))


def crawl_metrics(snapshots: DataFrame, jobs_raw: DataFrame, since) -> DataFrame:
    """Crawls, successes, rate and raw jobs since a time."""
    s = ts(since)
    n = count_if(F.col("crawled_at") >= s)
    ok = count_if((F.col("crawled_at") >= s) & (F.col("status_code") == 200))
    return one_row(
        snapshots.agg(n.alias("total_crawls_24h"), ok.alias("successful_crawls_24h"),
                      tx.safe_ratio(ok, n, 3).alias("success_rate")),
        jobs_raw.agg(count_if(F.col("extracted_at") >= s).alias("jobs_discovered_24h")))


def extraction_metrics(jobs_raw: DataFrame, jobs: DataFrame, since) -> DataFrame:
    """A22."""
    s = ts(since)
    both = one_row(jobs_raw.agg(count_if(F.col("extracted_at") >= s).alias("raw_jobs_24h")),
                   jobs.agg(count_if(F.col("created_at") >= s).alias("normalized_jobs_24h")))
    return both.withColumn("extraction_success_rate",
                           tx.safe_ratio(F.col("normalized_jobs_24h"), F.col("raw_jobs_24h"), 3))


def matching_metrics(matches: DataFrame, candidates: DataFrame, since) -> DataFrame:
    """A22."""
    s = ts(since)
    new = F.col("created_at") >= s
    both = one_row(
        matches.agg(count_if(new).alias("matches_created_24h"),
                    F.round(F.coalesce(F.avg(F.when(new, F.col("score"))), F.lit(0.0)), 3).alias("avg_match_score")),
        candidates.agg(count_if(F.col("is_active")).alias("active_candidates")))
    return both.withColumn("match_yield", tx.safe_ratio(F.col("matches_created_24h"), F.col("active_candidates"), 2))


def freshness_metrics(jobs: DataFrame, as_of) -> DataFrame:
    """A23."""
    at = F.col("posted_at")
    age = (F.unix_micros(ts(as_of)) - F.unix_micros(at)) / F.lit(86_400_000_000.0)
    since = lambda d: count_if(at >= ago(as_of, days=d))
    return jobs.filter(F.col("is_active")).agg(
        F.round(F.coalesce(F.avg(age), F.lit(0.0)), 1).alias("avg_job_age_days"),
        since(1).alias("jobs_posted_today"), since(7).alias("jobs_posted_week"),
        since(30).alias("jobs_posted_month"))


def system_health(crawl: DataFrame, matching: DataFrame, freshness: DataFrame) -> DataFrame:
    """Issues and status; a warning replaces "degraded"."""
    rules = [
        (F.col("success_rate") < 0.9, "Crawl success rate below 90%"),
        (F.col("jobs_discovered_24h") == 0, "No jobs discovered in last 24 hours"),
        (F.col("match_yield") == 0, "No matches generated"),
        (F.col("avg_job_age_days") > 14, "Average job age exceeds 14 days"),
    ]
    status = (F.when(rules[1][0] | rules[2][0] | rules[3][0], F.lit("warning"))
              .when(rules[0][0], F.lit("degraded")).otherwise(F.lit("healthy")))
    issues = F.array_compact(F.array(*[F.when(r, F.lit(m)) for r, m in rules]))
    return one_row(crawl, matching, freshness).select(status.alias("status"), issues.alias("issues"), "*")


RUN_OUTCOMES = ["new", "duplicate", "non_us", "queued", "updated", "error"]


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One column per outcome and source."""
    return outcomes.groupBy("source").agg(
        F.count("*").alias("total"),
        *[count_if(F.col("outcome") == o).alias(o) for o in RUN_OUTCOMES])


def verification_run(results: DataFrame) -> DataFrame:
    """Checked, found, unique and uniqueness per board."""
    n, found = F.count("*"), count_if(F.col("found"))
    return results.groupBy("board").agg(n.alias("jobs_checked"), found.alias("jobs_found"),
                                        (n - found).alias("jobs_unique"),
                                        tx.safe_ratio(n - found, n).alias("uniqueness_rate"))


def failure_breakdown(results: DataFrame) -> DataFrame:
    """A27."""
    return count_by(results.filter(~F.col("success")), "reason")


def mean_pool(chunks: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Mean vector per document.

    One average per dimension combines before the shuffle, so a document sends
    one vector per input partition, not one row per chunk and dimension.
    """
    v = F.col(vector)
    return chunks.groupBy(key).agg(F.array(*[F.avg(v[i]) for i in range(dim)]).alias("vector"),
                                   F.count("*").alias("chunks"))


def family_availability(jobs: DataFrame, as_of) -> DataFrame:
    """Active jobs of the last week per family."""
    return (jobs.filter(F.col("is_active") & dt.recent("created_at", as_of, days=7))
            .groupBy("role_family").agg(F.count("*").alias("jobs")))


def seniority_availability(jobs: DataFrame, as_of) -> DataFrame:
    """Active jobs of the last week per level."""
    return (jobs.filter(F.col("is_active") & dt.recent("created_at", as_of, days=7))
            .groupBy("seniority").agg(F.count("*").alias("jobs")))


def repeated_blocks(elements: DataFrame, at_least: int = 3) -> DataFrame:
    """Elements whose page-level structure signature repeats."""
    n = elements.groupBy("page_id", "signature").agg(F.count("*").alias("n"))
    return elements.join(n.filter(F.col("n") >= at_least).select("page_id", "signature"),
                         ["page_id", "signature"], "left_semi")


def verification_summary(jobs: DataFrame, listings: DataFrame) -> DataFrame:
    """Coverage and uniqueness per board over active jobs."""
    live = jobs.filter(F.col("is_active"))
    total = live.agg(F.count("*")).scalar()
    n, unique = F.col("verified_jobs"), F.col("unique_jobs")
    stats = (listings.join(live.select(F.col("id").alias("job_id")), "job_id", "left_semi").groupBy("board")
             .agg(F.count("*").alias("verified_jobs"), count_if(~F.col("found")).alias("unique_jobs"),
                  count_if(F.col("found")).alias("found_jobs")).withColumn("total_jobs", total))
    return stats.withColumn("uniqueness_rate", F.round(F.lit(100.0) * unique / F.nullif(n, F.lit(0)), 2)) \
                .withColumn("coverage_rate", F.round(F.lit(100.0) * n / F.nullif(F.col("total_jobs"), F.lit(0)), 2)) \
                .orderBy("board")
