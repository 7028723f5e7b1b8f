"""Snapshots, listing maintenance and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as cl, dates as dt, text as tx
from ..functions.core import extract, is_blank, nz, once, spread_nulls, ts
from ..operators.joins import reconcile
from ..operators.upserts import update_where
from ..operators.windows import changed_snapshots, latest_per
from ..rules import misc


def ingest_snapshots(fetches: DataFrame, snapshots: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New snapshots, companies with their last crawl, and crawl outcomes.

    A page is kept only if its digest differs from the one before it, which
    may be the last stored snapshot.  ``fetches(id, company_id, url, html,
    status, fetched_at)``.
    """
    f = fetches.select("id", "company_id", "url", tx.content_hash("html").alias("html_hash"),
                       F.col("html").alias("html_content"), F.col("status").alias("status_code"),
                       F.col("fetched_at").alias("crawled_at"))
    good = f.filter(F.col("status_code") == 200)
    old = latest_per(snapshots.select("id", "company_id", "html_hash", "crawled_at"), ["company_id"], "crawled_at", "id")
    # the comparison needs no page text: keys and digests only
    both = (good.select("id", "company_id", "html_hash", "crawled_at", F.lit(True).alias("__new"))
            .unionByName(old.withColumn("__new", F.lit(False))))
    kept, _ = changed_snapshots(both)
    new = good.join(kept.filter("__new").select("id"), "id", "left_semi")
    last = good.groupBy(F.col("company_id").alias("id")).agg(F.max("crawled_at").alias("__at"))
    c = companies.join(last, "id", "left").withColumn(
        "last_crawled_at", F.greatest("last_crawled_at", "__at")).select(*companies.columns)
    outcomes = f.select("id", "company_id", "status_code").join(
        new.select("id", F.lit(True).alias("__kept")), "id", "left").select(
        "id", "company_id", F.when(F.col("status_code") != 200, F.lit("failed"))
        .when(F.col("__kept"), F.lit("changed")).otherwise(F.lit("unchanged")).alias("outcome"))
    return new, c, outcomes


def rediscovered_identifiers(fetches: DataFrame, companies: DataFrame) -> DataFrame:
    """Boards that answer 404 while the company's page names another identifier."""
    gone = fetches.filter(F.col("status") == 404).select("company_id").distinct()
    page = (fetches.filter(F.col("status") == 200)
            .select("company_id", cl.ats_from_html("html").alias("t"), "html")
            .select("company_id", F.col("t").alias("ats_type"), cl.ats_identifier("html", "t").alias("ats_identifier"))
            .filter(F.col("ats_identifier").isNotNull())
            .groupBy("company_id").agg(F.min(F.struct("ats_type", "ats_identifier")).alias("n")))
    c = companies.select(F.col("id").alias("company_id"), F.col("ats_identifier").alias("old_identifier"))
    return (gone.join(page, "company_id").join(c, "company_id")
            .filter(~F.col("n.ats_identifier").eqNullSafe(F.col("old_identifier")))
            .select("company_id", "old_identifier", "n.ats_type", "n.ats_identifier"))


def maintain(jobs: DataFrame, live: DataFrame, companies: DataFrame, fetches: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """P10: jobs after reconciling with live listings, new listings, counters per company.

    Only companies whose fetch succeeded are touched, and a custom page
    without a single listing never delists.  ``fetches(company_id, status)``.
    """
    good = fetches.filter(F.col("status").isin(200, 201)).select("company_id").distinct()
    some = live.select("company_id").distinct().withColumn("__some", F.lit(True))
    c = (companies.filter(F.col("is_active")).select(F.col("id").alias("company_id"), "ats_type")
         .join(good, "company_id", "left_semi").join(some, "company_id", "left")
         .filter((F.coalesce("ats_type", F.lit("")) != "custom") | F.col("__some")).select("company_id"))
    r = reconcile(jobs.join(c, "company_id", "left_semi"), live.join(c, "company_id", "left_semi"))
    known = r.filter(F.col("job_id").isNotNull()).select(F.col("job_id").alias("id"), F.col("status").alias("__s"))
    out = jobs.join(known, "id", "left")
    out = update_where(out, F.col("__s") == "delist", is_active=False, delisted_at=ts(as_of), delist_reason="removed_from_ats")
    out = update_where(out, F.col("__s") == "verify", last_verified_at=ts(as_of)).select(*jobs.columns)
    new = r.filter(F.col("status") == "new").select("company_id", "listing_key", F.col("live_title").alias("title"),
                                                    F.col("live_url").alias("source_url"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    counts = r.groupBy("company_id").agg(is_("new").alias("new"), is_("verify").alias("verified"),
                                         is_("delist").alias("delisted"), is_("verify").alias("unchanged"))
    return out, new, counts


def page_description(html, ats_type=None):
    """X11: job description in a page, as plain text.

    The JSON description first, then six kinds of container; each must be
    longer than the limit (a lower one for lever).
    """
    limit = F.lit(misc.MIN_DESCRIPTION)
    if ats_type is not None:
        limit = F.when(ats_type == "lever", F.lit(misc.MIN_DESCRIPTION_LEVER)).otherwise(limit)
    options = [tx.html_to_text(extract(html, "(?s)" + misc.DESCRIPTION_JSON))]
    options += [tx.strip_tags(extract(html, "(?is)" + p)) for p in misc.DESCRIPTION_BLOCKS]
    return F.coalesce(*[once(o, lambda t: F.when(F.length(t) > limit, t)) for o in options])


def page_posted(html):
    """Posting date in a page."""
    return F.coalesce(*[dt.parse_date(extract(html, "(?i)" + p)) for p in misc.POSTED_PATTERNS])


def enrich(jobs: DataFrame, companies: DataFrame, details: DataFrame, pages: DataFrame, as_of, run_start=None) -> tuple[DataFrame, DataFrame]:
    """Descriptions and dates for jobs that lack them.

    ``details`` are provider records by (platform, identifier, job id) and
    ``pages(url, status, html)`` are fetched job pages.  Page text is read
    before the join.  A 404, or an id missing from a fetched ashby board, delists
    the job; a failure is stamped so that the same run does not try again.
    """
    failed_before = F.col("enrich_failed_at").isNull()
    if run_start is not None:
        failed_before = failed_before | (F.col("enrich_failed_at") < ts(run_start))
    c = companies.select(F.col("id").alias("company_id"), F.col("ats_type").alias("__t"), F.col("ats_identifier").alias("__i"))
    work = (jobs.filter(F.col("is_active") & is_blank("description") & failed_before)
            .select("id", "company_id", "source_url").join(c, "company_id")
            .withColumn("__j", tx.provider_job_id("__t", "source_url")).withColumn("__k", spread_nulls("__j", "id")))
    d = details.select(F.col("ats_type").alias("__t"), F.col("ats_identifier").alias("__i"), F.col("provider_job_id").alias("__k"),
                       F.col("status").alias("__ds"), nz(tx.html_to_text("description_html")).alias("__dd"),
                       dt.parse_date("published_at").alias("__dp"))
    board_read = (details.filter((F.col("ats_type") == "ashby") & (F.col("status") == 200))
                  .select(F.col("ats_type").alias("__t"), F.col("ats_identifier").alias("__i")).distinct()
                  .withColumn("__board", F.lit(True)))
    p = (pages.select(F.col("url").alias("source_url"), F.col("status").alias("__ps"),
                      F.when(F.col("status") == 200, page_description(F.col("html"))).alias("__pd"),
                      F.when(F.col("status") == 200, page_posted(F.col("html"))).alias("__pp")))
    w = (work.join(d, ["__t", "__i", "__k"], "left").join(board_read, ["__t", "__i"], "left").join(p, "source_url", "left"))
    absent = (F.col("__t") == "ashby") & F.col("__board") & F.col("__j").isNotNull() & F.col("__ds").isNull()
    text = F.coalesce("__dd", "__pd")
    gone = F.coalesce((F.col("__ds") == 404) | absent | (F.col("__ds").isNull() & (F.col("__ps") == 404)), F.lit(False))
    o = w.select("id", F.when(gone, F.lit("delisted")).when(text.isNotNull(), F.lit("enriched")).otherwise(F.lit("failed")).alias("outcome"),
                 text.alias("__text"), F.coalesce("__dp", "__pp").alias("__at"))
    out = jobs.join(o, "id", "left")
    out = update_where(out, F.col("outcome") == "delisted", is_active=False, delisted_at=ts(as_of), delist_reason="removed_from_ats")
    out = update_where(out, F.col("outcome") == "enriched", description=F.col("__text"), posted_at=F.coalesce("__at", "posted_at"))
    out = update_where(out, F.col("outcome") == "failed", enrich_failed_at=ts(as_of))
    return out.select(*jobs.columns), o.select("id", "outcome")
