"""Joins with product meaning (J-operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..functions.core import nz, ts
from .sets import known_domains


def _company(companies: DataFrame, *cols: str) -> DataFrame:
    return companies.select(F.col("id").alias("company_id"), *[F.col(c).alias(f"company_{c}") for c in cols])


def job_feed(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Active jobs of active companies."""
    c = _company(companies.filter(F.col("is_active")), "name", "domain")
    return jobs.filter(F.col("is_active")).join(c, "company_id", "inner")


def candidate_matches(matches: DataFrame, jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Matches with their active job and its company."""
    j = jobs.filter(F.col("is_active")).select(
        F.col("id").alias("job_id"), "company_id", "title", "seniority", "role_family",
        "role_specialization", "location_type", "locations", "skills", "posted_at", "source_url")
    return matches.join(j, "job_id", "inner").join(_company(companies, "name"), "company_id", "inner")


def companies_without_jobs(companies: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active companies on a platform that have no active job."""
    live = jobs.filter(F.col("is_active")).select(F.col("company_id").alias("id"))
    return (companies.filter(F.col("is_active") & F.col("ats_type").isNotNull())
            .join(live, "id", "left_anti"))


def jobs_needing_verification(jobs: DataFrame, companies: DataFrame, listings: DataFrame) -> DataFrame:
    """Active jobs with the time of their last board check, never = epoch."""
    last = listings.groupBy("job_id").agg(F.max("verified_at").alias("__last"))
    return (jobs.filter(F.col("is_active")).withColumnRenamed("id", "job_id")
            .join(_company(companies, "name"), "company_id", "inner")
            .join(last, "job_id", "left")
            .select("job_id", "title", "source_url", "company_name", "created_at", "posted_at",
                    F.coalesce("__last", ts("1970-01-01 00:00:00")).alias("last_verified_at")))


def drop_known(discovered: DataFrame, companies: DataFrame, queue: DataFrame,
               boards_too: bool = False) -> DataFrame:
    """Discovered rows whose domain (and board, on request) is new; no domain stays."""
    known = known_domains(companies, queue).withColumnRenamed("domain", "__known")
    out = discovered.join(known, F.lower("domain") == F.col("__known"), "left_anti")
    if boards_too:
        taken = (companies.filter(F.col("ats_identifier").isNotNull())
                 .select(F.concat_ws(":", "ats_type", "ats_identifier").alias("__board")).distinct())
        key = F.when(F.col("ats_identifier").isNotNull(), F.concat_ws(":", "ats_type", "ats_identifier"))
        out = out.join(taken, key == F.col("__board"), "left_anti")
    return out


def reconcile(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """One row per stored active job or unknown live listing with its status.

    ``delist`` (stored only), ``verify`` (both) or ``new`` (live only), keyed
    by company and normalised listing key.  Repeated live listings are folded
    before the join.
    """
    stored = (jobs.filter(F.col("is_active"))
              .select(F.col("id").alias("job_id"), "company_id",
                      tx.listing_key("title", "source_url").alias("listing_key")))
    seen = (live.select("company_id", tx.listing_key("title", "source_url").alias("listing_key"),
                        "title", "source_url")
            .groupBy("company_id", "listing_key")
            .agg(F.min_by("title", F.struct("source_url", "title")).alias("live_title"),
                 F.min("source_url").alias("live_url"))
            .withColumn("__live", F.lit(True)))
    both = stored.join(seen, ["company_id", "listing_key"], "full_outer")
    status = (F.when(F.col("job_id").isNull(), F.lit("new"))
              .when(F.col("__live").isNull(), F.lit("delist")).otherwise(F.lit("verify")))
    return both.select("company_id", "listing_key", "job_id", "live_title", "live_url",
                       status.alias("status"))


def probe_boards(companies: DataFrame, boards: DataFrame) -> DataFrame:
    """First observed board whose slug and site domain fit a company.

    ``boards(ats_type, slug, site_domain, ats_rank)``.  Slugs are a handful per
    company, so the explode is bounded and the join is an equi-join.
    """
    slugs = companies.select(F.col("id").alias("company_id"), "domain",
                             F.posexplode(tx.company_slugs("name", "domain")).alias("slug_rank", "slug"))
    hits = slugs.join(boards, "slug").filter(tx.domains_match("domain", "site_domain"))
    best = F.min_by(F.struct("ats_type", "slug"), F.struct("slug_rank", "ats_rank", "ats_type"))
    return (hits.groupBy("company_id").agg(best.alias("b"))
            .select("company_id", F.col("b.ats_type").alias("ats_type"),
                    F.col("b.slug").alias("ats_identifier")))


def link_parents(companies: DataFrame, redirects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parent id per redirected company, and stub rows for unknown parents.

    ``redirects(company_id, parent_domain)``; domains compare without ``www.``.
    """
    want = redirects.withColumn("__d", tx.strip_www(F.lower("parent_domain")))
    own = (companies.filter(F.col("domain").isNotNull())
           .groupBy(tx.strip_www(F.lower("domain")).alias("__d"))
           .agg(F.min("id").alias("parent_company_id")))
    linked = want.join(own, "__d", "left").select("company_id", "parent_domain", "parent_company_id")
    stubs = (want.select("__d").distinct().join(own, "__d", "left_anti")
             .select(F.col("__d").alias("domain"), tx.parent_name("__d").alias("name")))
    return linked, stubs


def new_custom_jobs(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """Found rows that repeat neither the URL nor the title of the company's jobs.

    Two anti joins in a row instead of one with OR, which could not be hashed.
    """
    by_url = jobs.select("company_id", "source_url")
    by_title = jobs.select("company_id", "title")
    return (found.join(by_url, ["company_id", "source_url"], "left_anti")
            .join(by_title, ["company_id", "title"], "left_anti"))


def fill_missing(target: DataFrame, items: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Take the item's value only where the target has none.

    ``items`` holds one row per key.
    """
    i = items.select(key, *[F.col(c).alias(f"__i_{c}") for c in cols])
    out = target.join(i, key, "left")
    text = {n for n, t in target.dtypes if t == "string"}
    value = lambda c: F.coalesce(nz(c) if c in text else F.col(c), F.col(f"__i_{c}"))
    return out.select(*[value(c).alias(c) if c in cols else F.col(c) for c in target.columns])


def new_outbound(links: DataFrame, companies: DataFrame) -> DataFrame:
    """Linked domains that are no company yet, once each."""
    known = companies.filter(F.col("domain").isNotNull()).select(F.lower("domain").alias("domain"))
    return (links.groupBy("domain").agg(F.min_by("source", F.struct("url", "source")).alias("source"),
                                        F.min("url").alias("url"),
                                        F.count("*").alias("mentions"))
            .join(known, "domain", "left_anti"))
