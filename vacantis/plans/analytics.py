"""V6: the dashboard bundle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame

from ..operators import aggregates as ag, filters as fl


def analytics(companies: DataFrame, jobs: DataFrame, snapshots: DataFrame, as_of: str, days: int = 30) -> dict[str, DataFrame]:
    """All dashboard frames for the last ``days`` days before ``as_of``."""
    start = str(datetime.fromisoformat(as_of) - timedelta(days=days))
    gone = fl.changed_after_creation(jobs.filter("NOT is_active"))
    return {
        "crawls_per_day": ag.daily_counts(snapshots, "crawled_at", start),
        "new_companies_per_day": ag.daily_counts(companies, "created_at", start),
        "new_jobs_per_day": ag.daily_counts(jobs, "created_at", start),
        "delisted_jobs_per_day": ag.daily_counts(gone, "updated_at", start),
        "companies_with_new_jobs_per_day": ag.returning_companies_daily(jobs, companies, start),
        "sources": ag.source_breakdown(companies),
        "job_freshness": ag.freshness_histogram(jobs, as_of),
        "totals": ag.analytics_totals(companies, jobs, snapshots, start),
    }
