"""Platform detection over fetched evidence, dormant companies and validation
(L16, P13–P15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as cl, dates as dt, text as tx
from ..functions.core import CI, nz, spread_nulls, ts
from ..operators.aggregates import failure_breakdown
from ..operators.filters import companies_to_detect, dormant_candidates
from ..operators.joins import companies_without_jobs
from ..operators.upserts import insert_ignore, update_where
from ..rules import boards

# ---------------------------------------------------------------------------
# Addresses tried for a company without a usable careers page.
# ---------------------------------------------------------------------------
CAREERS_PATHS = ["/careers", "/jobs", "/careers/", "/jobs/", "/join-us", "/join", "/work-with-us",
                 "/about/careers", "/company/careers"]
WEBSITE_PATHS = ["/careers", "/jobs"]
MIN_LINK_LENGTH = 20
DORMANT_RECHECK_DAYS = 30
# ---------------------------------------------------------------------------


def evidence(fetches: DataFrame) -> DataFrame:
    """What each fetched address says about its platform; the page text stays behind.

    All reading of page text happens here, before any join, so only small
    columns are shuffled.
    """
    job_hrefs = F.flatten(F.array(*[F.regexp_extract_all("html", F.lit(CI + p), F.lit(1))
                                    for p in boards.JOB_LINK_PATTERNS]))
    f = fetches.select(
        "url", "final_url", "status", "fetched_at", cl.ats_from_url("final_url").alias("by_final"),
        F.when(F.col("status") == 200, cl.ats_from_html("html")).alias("page_type"),
        "html", F.when(F.col("status") == 200, F.array_distinct(job_hrefs)).alias("job_hrefs"))
    f = f.withColumn("page_identifier", cl.ats_identifier("html", "page_type")).drop("html")
    small = F.struct("final_url", "status", "by_final", "page_type", "page_identifier", "job_hrefs")
    return (f.groupBy("url").agg(F.max_by(small, F.struct("fetched_at", "final_url")).alias("e"))
            .select("url", "e.*"))


def detect_ats(companies: DataFrame, fetches: DataFrame, max_attempts: int = 2) -> DataFrame:
    """One row per company without a platform, with what the evidence says.

    Tiers: the careers address, where it leads, what its page shows; else the
    usual career paths of the domain and the website; then the job links
    of the page.  Outcomes: ``detected``, ``uses_parent_ats`` (the page belongs to
    another company), ``custom`` (attempts used up) or ``retry``.
    """
    ev = evidence(fetches)
    c = companies_to_detect(companies, max_attempts).select(
        F.col("id").alias("company_id"), "domain", "website_url",
        F.when(tx.is_valid_careers_url("careers_url"), F.col("careers_url")).alias("careers_url"),
        F.coalesce("ats_detection_attempts", F.lit(0)).alias("attempts"))
    ok = ev.filter(F.col("status") == 200)
    own = ok.select(F.col("url").alias("__key"), F.struct(*[x for x in ok.columns if x != "url"]).alias("own"))
    c = c.withColumn("__key", spread_nulls("careers_url", "company_id")).join(own, "__key", "left").drop("__key")
    # usual paths, only for companies whose careers page was not read
    options = F.concat(
        F.when(nz("domain").isNotNull(), F.array(*[F.concat(F.lit("https://"), "domain", F.lit(p)) for p in CAREERS_PATHS]))
        .otherwise(F.array().cast("array<string>")),
        F.when(nz("website_url").isNotNull(), F.array(*[F.concat(F.regexp_replace("website_url", "/+$", ""), F.lit(p)) for p in WEBSITE_PATHS]))
        .otherwise(F.array().cast("array<string>")))
    tries = (c.filter(F.col("own").isNull()).select("company_id", F.posexplode(options).alias("pos", "url")))
    other = (tries.join(ok, "url").groupBy("company_id")
             .agg(F.min_by(F.struct("url", *[x for x in ok.columns if x != "url"]), "pos").alias("other")))
    c = c.join(other, "company_id", "left")
    page = F.coalesce("own.job_hrefs", "other.job_hrefs")
    base = F.coalesce("careers_url", nz("website_url"), F.concat(F.lit("https://"), "domain"))
    links = F.filter(F.transform(page, lambda h: tx.resolve_url(base, h)),
                     lambda u: (F.length(u) >= MIN_LINK_LENGTH)
                     & (F.regexp_replace(u, "/+$", "") != F.regexp_replace(base, "/+$", "")))
    follow = c.select("company_id", F.posexplode(F.array_distinct(links)).alias("pos", "url"))
    hit = F.when(F.col("by_final.ats_type").isNotNull(), F.col("by_final")).when(
        F.col("page_type").isNotNull(), F.struct(F.col("page_type").alias("ats_type"), F.col("page_identifier").alias("ats_identifier")))
    jobs = (follow.join(ev, "url").withColumn("hit", hit).filter(F.col("hit").isNotNull())
            .groupBy("company_id").agg(F.min_by("hit", "pos").alias("job_hit")))
    c = c.join(jobs, "company_id", "left").withColumn("by_url", cl.ats_from_url("careers_url"))
    tier = lambda name, s: F.when(s["ats_type"].isNotNull(),
                                  F.struct(F.lit(name).alias("tier"), s["ats_type"].alias("ats_type"), s["ats_identifier"].alias("ats_identifier")))
    shown = lambda p: F.struct(F.col(f"{p}.page_type").alias("ats_type"), F.col(f"{p}.page_identifier").alias("ats_identifier"))
    found = F.coalesce(
        tier("careers_url", F.col("by_url")), tier("final_url", F.col("own.by_final")), tier("page", shown("own")),
        tier("found_url", cl.ats_from_url("other.url")), tier("found_final_url", F.col("other.by_final")),
        tier("found_page", shown("other")), tier("job_link", F.col("job_hit")))
    c = c.withColumn("found", found).withColumn("parent_domain", tx.parent_redirect("domain", F.col("own.final_url")))
    used = F.col("attempts") + 1
    outcome = (F.when(F.col("found").isNotNull(), F.lit("detected"))
               .when(F.col("parent_domain").isNotNull(), F.lit("uses_parent_ats"))
               .when(used >= max_attempts, F.lit("custom")).otherwise(F.lit("retry")))
    return c.select("company_id", outcome.alias("outcome"), F.col("found.tier").alias("tier"),
                    F.col("found.ats_type").alias("ats_type"), F.col("found.ats_identifier").alias("ats_identifier"),
                    F.when(F.col("found").isNull(), F.col("parent_domain")).alias("parent_domain"),
                    used.alias("attempts"), F.coalesce("careers_url", "other.url").alias("careers_url"))


def apply_detection(companies: DataFrame, outcomes: DataFrame, as_of, parents: DataFrame | None = None) -> DataFrame:
    """Company table after :func:`detect_ats`; ``parents(company_id, parent_company_id)``."""
    o = outcomes.select(F.col("company_id").alias("id"), F.col("outcome").alias("__o"), F.col("ats_type").alias("__t"),
                        F.col("ats_identifier").alias("__i"), F.col("parent_domain").alias("__p"),
                        F.col("attempts").alias("__n"), F.col("careers_url").alias("__u"))
    out = companies.join(o, "id", "left")
    hit = F.col("__o").isNotNull()
    new = {
        "ats_type": F.when(F.col("__o") == "detected", F.col("__t")).when(F.col("__o") == "uses_parent_ats", F.lit("uses_parent_ats"))
        .when(F.col("__o") == "custom", F.lit("custom")).otherwise(F.col("ats_type")),
        "ats_identifier": F.when(F.col("__o") == "detected", F.col("__i")).when(F.col("__o") == "uses_parent_ats", F.col("__p"))
        .otherwise(F.col("ats_identifier")),
        "careers_url": F.when(F.col("__o") == "detected", F.coalesce("careers_url", "__u")).otherwise(F.col("careers_url")),
        "ats_detection_attempts": F.when(hit, F.col("__n")).otherwise(F.col("ats_detection_attempts")),
    }
    if "ats_detection_last_at" in companies.columns:
        new["ats_detection_last_at"] = F.when(hit, ts(as_of)).otherwise(F.col("ats_detection_last_at"))
    if parents is not None and "parent_company_id" in companies.columns:
        p = parents.select(F.col("company_id").alias("id"), F.col("parent_company_id").alias("__pid"))
        out = out.join(p, "id", "left")
        new["parent_company_id"] = F.coalesce("__pid", "parent_company_id")
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in companies.columns])


def mark_custom(companies: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Active companies with all attempts used become custom pages."""
    done = F.col("is_active") & F.col("ats_type").isNull() & (F.col("ats_detection_attempts") >= max_attempts)
    return update_where(companies, done, ats_type="custom")


def move_to_dormant(companies: DataFrame, dormant: DataFrame, reason: str, as_of) -> tuple[DataFrame, DataFrame]:
    """Companies with nothing to crawl rest in the dormant table."""
    gone = dormant_candidates(companies)
    rows = (gone.withColumn("dormant_reason", F.lit(reason)).withColumn("moved_at", ts(as_of))
            .withColumn("check_count", F.lit(0)).withColumn("original_created_at", F.col("created_at")))
    after = insert_ignore(dormant, rows, ["id"])
    marked = companies.join(gone.select("id", F.lit(True).alias("__gone")), "id", "left")
    return update_where(marked, F.col("__gone"), is_active=False).select(*companies.columns), after


def recheck_dormant(companies: DataFrame, dormant: DataFrame, fetches: DataFrame, as_of,
                    days: int = DORMANT_RECHECK_DAYS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dormant companies due for a check wake up when a career path answers.

    Returns companies, dormant table and the list of woken companies.
    """
    due = dormant.filter(dt.stale("last_checked_at", as_of, days=days) & nz("domain").isNotNull())
    ok = evidence(fetches).filter(F.col("status") == 200)
    paths = F.array(*[F.concat(F.lit("https://"), "domain", F.lit(p)) for p in CAREERS_PATHS])
    tries = due.select("id", F.posexplode(paths).alias("pos", "url"))
    hit = F.struct("final_url", "by_final", "page_type", "page_identifier")
    woken = (tries.join(ok, "url").groupBy("id").agg(F.min_by(hit, "pos").alias("e"))
             .select("id", F.col("e.final_url").alias("__u"),
                     F.coalesce("e.by_final.ats_type", "e.page_type").alias("__t"),
                     F.when(F.col("e.by_final.ats_type").isNotNull(), F.col("e.by_final.ats_identifier"))
                     .otherwise(F.col("e.page_identifier")).alias("__i")))
    c = companies.join(woken, "id", "left")
    up = F.col("__u").isNotNull()
    c = update_where(c, up, is_active=True, careers_url=F.col("__u"), ats_type=F.col("__t"),
                     ats_identifier=F.col("__i"), ats_detection_attempts=0).select(*companies.columns)
    rest = dormant.join(woken.select("id"), "id", "left_anti")
    checked = rest.join(due.select("id", F.lit(True).alias("__due")), "id", "left")
    d = update_where(checked, F.col("__due"), last_checked_at=ts(as_of),
                     check_count=F.col("check_count") + 1).select(*dormant.columns)
    return c, d, woken.select("id", F.col("__u").alias("careers_url"), F.col("__t").alias("ats_type"))


def validate_ats(companies: DataFrame, jobs: DataFrame, outcomes: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Companies on a platform without jobs: bad identifiers are cleared, failed crawls counted.

    ``outcomes(company_id, success, reason)``.  Returns companies, the rows
    checked with their verdict, and the failure reasons by size.
    """
    idle = companies_without_jobs(companies, jobs)
    v = (idle.select(F.col("id").alias("company_id"), "ats_type",
                     tx.is_invalid_identifier("ats_identifier").alias("bad_identifier"))
         .join(outcomes.select("company_id", "success", "reason"), "company_id", "left"))
    failed = ~F.col("bad_identifier") & (F.col("success") == F.lit(False))
    verdict = (F.when(F.col("bad_identifier"), F.lit("invalid_identifier")).when(failed, F.lit("failed"))
               .when(F.col("success"), F.lit("ok")).otherwise(F.lit("not_crawled")))
    v = v.withColumn("verdict", verdict)
    out = companies.join(v.select(F.col("company_id").alias("id"), F.col("verdict").alias("__v")), "id", "left")
    out = update_where(out, F.col("__v") == "invalid_identifier", ats_identifier=F.lit(None).cast("string"))
    out = update_where(out, F.col("__v") == "failed", last_maintenance_at=ts(as_of),
                       ats_detection_attempts=F.coalesce("ats_detection_attempts", F.lit(0)) + 1)
    reasons = failure_breakdown(v.filter(F.col("verdict") == "failed").withColumn("success", F.lit(False)))
    return out.select(*companies.columns), v, reasons
