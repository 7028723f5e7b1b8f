"""Raw postings to normalised jobs, one projection of native expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as cl, dates as dt, text as tx
from ..functions.core import nz


def normalize_jobs(jobs_raw: DataFrame, as_of, half_life: float = 7.0) -> DataFrame:
    """Classify, parse and score every raw posting; no shuffle and no Python."""
    base = jobs_raw.withColumn("__salary", tx.parse_salary(nz("salary_raw"))).withColumn(
        "posted_at", dt.parse_date("posted_at_raw"))
    return base.select(
        F.col("id").alias("raw_job_id"), "company_id", "source_url", F.col("title_raw").alias("title"),
        F.col("description_raw").alias("description"),
        cl.role_family("title_raw").alias("role_family"),
        cl.role_specialization("title_raw").alias("role_specialization"),
        cl.seniority("title_raw", "description_raw").alias("seniority"),
        cl.location_type("location_raw").alias("location_type"),
        cl.locations("location_raw").alias("locations"),
        cl.skills("title_raw", "description_raw").alias("skills"),
        F.col("__salary.min_salary").alias("min_salary"), F.col("__salary.max_salary").alias("max_salary"),
        cl.employment_type("employment_type_raw").alias("employment_type"), "posted_at",
        dt.freshness("posted_at", as_of, half_life).alias("freshness_score"))


def embedding_text(jobs: DataFrame):
    """Text that stands for a job: title with level, description, skills, role, work type."""
    from ..functions.core import has_items

    title = F.concat_ws(" ", F.initcap(nz("seniority")), F.coalesce("title", F.lit("")))
    tag = lambda label, c: F.concat(F.lit(label), nz(c))
    listed = F.when(has_items("skills"), F.concat(F.lit("Skills: "), F.array_join("skills", ", ")))
    return jobs.withColumn("embedding_text", F.concat_ws(
        " ", title, nz("description"), listed, tag("Role: ", "role_family"),
        tag("Specialization: ", "role_specialization"), tag("Work type: ", "location_type")))
