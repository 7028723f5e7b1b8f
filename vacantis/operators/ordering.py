"""Sorting, paging and work-queue order (T-operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import ts
from .upserts import update_where


def job_order() -> list[Column]:
    """Newest posting first, undated last."""
    return [F.col("posted_at").desc_nulls_last(), F.col("created_at").desc(), F.col("id").asc()]


def first_rows(df: DataFrame, n: int | None, *order: Column | str) -> DataFrame:
    """The first ``n`` rows in an order, as a distributed top-n; all rows, unsorted, when there is no limit."""
    return df if n is None else df.orderBy(*order).limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page; planned as a distributed top-n, not a full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: The job order as (column, way); a null comes last in every column.
JOB_KEYS = (("posted_at", "desc"), ("created_at", "desc"), ("id", "asc"))


def _key_order(keys) -> list[Column]:
    return [F.col(c).desc_nulls_last() if way == "desc" else F.col(c).asc_nulls_last() for c, way in keys]


def after_key(cursor: dict, keys=JOB_KEYS) -> Column:
    """The rows that come after the one with these key values.

    The first key's range is said by itself too, so that it reaches the scan.
    """
    beyond, tie = F.lit(False), F.lit(True)
    for name, way in keys:
        c, v = F.col(name), cursor[name]
        if v is None:
            further, same = F.lit(False), c.isNull()
        else:
            further = (c < F.lit(v) if way == "desc" else c > F.lit(v)) | c.isNull()
            same = c.eqNullSafe(F.lit(v))
        beyond, tie = beyond | (tie & further), tie & same
    name, way = keys[0]
    first, v = F.col(name), cursor[name]
    if v is None:
        reach = first.isNull()
    else:
        reach = (first <= F.lit(v) if way == "desc" else first >= F.lit(v)) | first.isNull()
    return reach & beyond


def page_after(df: DataFrame, size: int, cursor: dict | None = None, keys=JOB_KEYS) -> DataFrame:
    """The page behind a cursor (the first one without), at the cost of one page however deep it is.

    ``keys`` must tell rows apart; the cursor is the key of the last row seen, see :func:`cursor_of`.
    """
    rest = df if cursor is None else df.filter(after_key(cursor, keys))
    return rest.orderBy(*_key_order(keys)).limit(size)


def cursor_of(page: DataFrame, keys=JOB_KEYS) -> dict | None:
    """The key of a page's last row, null after the last page."""
    names = [c for c, _ in keys]
    rows = page.select(*names).collect()  # one page
    return rows[-1].asDict() if rows else None


def page_totals(all_rows: DataFrame, filtered: DataFrame, number: int, size: int) -> DataFrame:
    """Totals with and without the optional filters, and whether more pages follow."""
    seen = number * size
    return (filtered.agg(F.count("*").alias("total_filtered"))
            .select(all_rows.agg(F.count("*")).scalar().alias("total_active"), "total_filtered",
                    (F.col("total_filtered") > seen).alias("has_more")))


def crawl_frontier(companies: DataFrame, n: int) -> DataFrame:
    """Companies on a known platform first, then priority, then the longest unseen."""
    ready = companies.filter(F.col("is_active") & F.col("careers_url").isNotNull())
    return ready.orderBy(F.col("ats_type").isNull().asc(), F.col("crawl_priority").desc(),
                         F.col("last_crawled_at").asc_nulls_first(), F.col("id")).limit(n)


def stalest(df: DataFrame, column: str, n: int) -> DataFrame:
    """T4."""
    return df.orderBy(F.col(column).asc_nulls_first(), F.col("id")).limit(n)


def claim(queue: DataFrame, n: int, as_of) -> tuple[DataFrame, DataFrame]:
    """The oldest ``n`` pending rows, and the queue with them marked as processing."""
    batch = (queue.filter(F.col("status") == "pending")
             .orderBy("created_at", "id").limit(n))
    marked = queue.join(batch.select("id").withColumn("__claimed", F.lit(True)), "id", "left")
    after = update_where(marked, F.col("__claimed"), status="processing")
    return batch.withColumn("status", F.lit("processing")).withColumn(
        "claimed_at", ts(as_of)), after.select(*queue.columns)


def recent_runs(runs: DataFrame, n: int, status: str | None = None) -> DataFrame:
    """Filter first, then the newest ``n``."""
    if status:
        runs = runs.filter(F.col("status") == status)
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def with_similarity(jobs: DataFrame, target: Column) -> DataFrame:
    """Cosine similarity of every job vector with one target vector."""
    from ..functions.scoring import cosine

    # the target is one value for all rows (a literal or a scalar subquery)
    return (jobs.withColumn("__target", target)
            .withColumn("similarity", cosine("embedding", "__target")).drop("__target"))


def similar_jobs(jobs: DataFrame, target: Column, k: int = 10, min_sim: float = 0.5) -> DataFrame:
    """Exact nearest active jobs; one scan, then a distributed top-n."""
    return (with_similarity(jobs.filter(F.col("is_active") & F.col("embedding").isNotNull()), target)
            .filter(F.col("similarity") >= min_sim)
            .orderBy(F.col("similarity").desc(), F.col("id")).limit(k))
