"""Filters, work sets, quality gate and projections (F-operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import is_blank
from ..schemas import RULES
from .ordering import first_rows


def active(df: DataFrame) -> DataFrame:
    """F1."""
    return df.filter(F.col("is_active"))


def where_opt(df: DataFrame, **equals) -> DataFrame:
    """equality filters for the arguments that are given."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def changed_after_creation(df: DataFrame) -> DataFrame:
    """F16."""
    return df.filter(F.col("updated_at") != F.col("created_at"))


def own_profile(candidates: DataFrame, email: str) -> DataFrame:
    """a user's own profile."""
    return candidates.filter(F.col("email") == email)


def own_matches(matches: DataFrame, candidates: DataFrame, email: str) -> DataFrame:
    """matches of the user's own profile."""
    mine = own_profile(candidates, email).select(F.col("id").alias("candidate_id"))
    return matches.join(mine, "candidate_id", "left_semi")


def _rule(column: str, kind: str, arg) -> Column:
    c = F.col(column)
    if kind == "in":
        return c.isin(arg)
    if kind == "range":
        return c.between(*arg)
    if kind == "length":
        return F.length(c) == arg
    return F.size(F.array_except(c, F.array(*[F.lit(v) for v in arg]))) == 0


def check(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """rows that keep every value rule, and the others with the broken rules.

    A null value keeps every rule.  One pass computes the list of broken rules.
    """
    broken = [F.when(~F.coalesce(_rule(column, kind, arg), F.lit(True)), F.lit(name))
              for name, column, kind, arg in RULES.get(table, []) if column in df.columns]
    if not broken:
        return df, df.withColumn("violations", F.array().cast("array<string>")).limit(0)
    marked = df.withColumn("violations", F.array_compact(F.array(*broken)))
    ok = marked.filter(F.size("violations") == 0).drop("violations")
    return ok, marked.filter(F.size("violations") > 0)


def job_response(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """response shape with a nested company."""
    c = companies.select(F.col("id").alias("company_id"),
                         F.struct("id", "name", "domain").alias("company"))
    return jobs.join(c, "company_id", "inner").select(
        "id", "title", "description", "role_family", "role_specialization", "seniority",
        "location_type", "locations", "skills", "min_salary", "max_salary", "posted_at",
        "source_url", "company")


def jobs_to_embed(jobs: DataFrame) -> DataFrame:
    """active jobs with a description and no vector yet."""
    return jobs.filter(F.col("is_active") & F.col("embedding").isNull() & ~is_blank("description"))


def companies_to_detect(companies: DataFrame, max_attempts: int = 2,
                        include_retries: bool = True, n: int | None = None) -> DataFrame:
    """active companies without a platform and with attempts left; the ``n`` least tried, or all, unsorted."""
    tries = F.coalesce(F.col("ats_detection_attempts"), F.lit(0))
    left = tries < max_attempts if include_retries else tries == 0
    return first_rows(companies.filter(F.col("is_active") & F.col("ats_type").isNull() & left), n,
                      tries.asc(), F.col("created_at").desc(), F.col("id"))


def custom_companies_to_crawl(companies: DataFrame, n: int | None = None) -> DataFrame:
    """custom career pages that were never crawled; the ``n`` oldest, or all, unsorted."""
    return first_rows(companies.filter(F.col("is_active") & (F.col("ats_type") == "custom")
                                       & F.col("last_crawled_at").isNull() & F.col("careers_url").isNotNull()), n, "created_at", "id")


def custom_jobs_to_enrich(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """active jobs of custom companies that lack a description."""
    custom = companies.filter(F.col("ats_type") == "custom").select(F.col("id").alias("company_id"))
    return (jobs.filter(F.col("is_active") & is_blank("description"))
            .join(custom, "company_id", "left_semi"))


def network_seeds(companies: DataFrame, force: bool = False, n: int | None = None) -> DataFrame:
    """companies whose pages may name further companies; the first ``n``, never crawled ones first, or all, unsorted."""
    out = companies.filter(F.col("is_active") & F.col("domain").isNotNull())
    if not force:
        out = out.filter(F.col("last_crawled_for_network").isNull())
    return first_rows(out, n, F.col("last_crawled_for_network").asc_nulls_first(), F.col("id"))


def dormant_candidates(companies: DataFrame) -> DataFrame:
    """nothing to crawl and nothing left to try."""
    tries = F.coalesce(F.col("ats_detection_attempts"), F.lit(0))
    return companies.filter(F.col("is_active") & is_blank("careers_url") & F.col("ats_type").isNull()
                            & (is_blank("website_url") | (tries >= 2)))
