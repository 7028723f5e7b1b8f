"""Keyed writes expressed as new table versions (K-operators).

Results are new DataFrames; write them to a new version directory and swap
the path, never over the files being read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str], set_cols: Sequence[str],
           order: Sequence[str] | None = None) -> DataFrame:
    """K1: insert new keys, overwrite ``set_cols`` of known keys, keep everything else.

    A set column takes the update even when that is null.  Updates that repeat
    a key are folded into one before the join: the last in the order of the
    columns ``order`` names (nulls first), ties and a missing order decided by
    the row's own text, so that a repeated write gives the same table.  A null
    in the key is no key: such updates are all inserted.
    """
    updates = fold_keys(updates, keys, order or ())
    u = updates.select(*[F.col(c).alias(f"__u_{c}") for c in updates.columns],
                       F.lit(True).alias("__u"))
    t = target.withColumn("__t", F.lit(True))
    both = t.join(u, [F.col(k) == F.col(f"__u_{k}") for k in keys], "full_outer")
    in_t, in_u = F.col("__t").isNotNull(), F.col("__u").isNotNull()
    out = []
    for name, dtype in target.dtypes:
        new = F.col(f"__u_{name}").cast(dtype) if name in updates.columns else F.lit(None).cast(dtype)
        if name in set_cols:
            value = F.when(in_u, new).otherwise(F.col(name))
        else:
            value = F.when(in_t, F.col(name)).otherwise(new)
        out.append(value.alias(name))
    return both.select(*out)


def fold_keys(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (), last: bool = True) -> DataFrame:
    """One row per key, the last (or first) in a stated order; rows with a null in the key stay.

    The fold is an aggregate that combines before the shuffle.
    """
    body = F.struct(*[F.col(c) for c in rows.columns])
    rank = F.struct(*[F.col(c) for c in order], F.to_json(body))
    whole = [F.col(k).isNotNull() for k in keys]
    known = whole[0]
    for w in whole[1:]:
        known = known & w
    pick = F.max_by if last else F.min_by
    one = rows.filter(known).groupBy(*keys).agg(pick(body, rank).alias("__row")).select("__row.*")
    return one.unionByName(rows.filter(~known))


def upsert_jobs_raw(jobs_raw: DataFrame, updates: DataFrame, **kw) -> DataFrame:
    """K2."""
    return upsert(jobs_raw, updates, ["company_id", "source_url"],
                  ["title_raw", "description_raw", "location_raw", "department_raw",
                   "employment_type_raw", "salary_raw", "posted_at_raw"], **kw)


JOB_FIELDS = ["title", "description", "role_family", "role_specialization", "seniority",
              "location_type", "locations", "skills", "min_salary", "max_salary",
              "employment_type", "posted_at", "freshness_score", "embedding", "updated_at"]


def upsert_jobs(jobs: DataFrame, updates: DataFrame, as_of, **kw) -> DataFrame:
    """K3: refresh all normalised fields; touched rows get ``updated_at = as_of``.

    A row without a new vector loses its old one, so it is embedded again.
    """
    from ..functions.core import ts

    updates = updates.withColumn("updated_at", ts(as_of))
    return upsert(jobs, updates, ["company_id", "source_url"],
                  [c for c in JOB_FIELDS if c in jobs.columns], **kw)


def upsert_matches(matches: DataFrame, updates: DataFrame) -> DataFrame:
    """K4: new score, reasons; engagement times and creation time are kept."""
    return upsert(matches, updates, ["candidate_id", "job_id"],
                  ["score", "hard_match", "match_reasons"])


def upsert_listings(listings: DataFrame, updates: DataFrame) -> DataFrame:
    """K5: one row per (job, board)."""
    keys = ["job_id", "board"]
    return upsert(listings, updates, keys, [c for c in listings.columns if c not in keys])


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """K6: rows with a new key are added, others dropped; a null key is always new.

    Of several new rows with one key the first in the order of the columns
    ``order`` names is added, ties decided by the row's own text.
    """
    new = fold_keys(rows, keys, order, last=False).join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(new.select(*[c for c in target.columns if c in new.columns]),
                              allowMissingColumns=True)


def crawl_metrics_rows(results: DataFrame, as_of) -> DataFrame:
    """K7: metric rows of crawl results: the outcome, and the number of jobs when there are any."""
    from ..functions.core import ts

    ok = F.coalesce(F.col("success"), F.lit(False))
    rows = F.array_compact(F.array(
        F.struct(F.lit("crawl_result").alias("name"), ok.cast("double").alias("value")),
        F.when(ok & (F.col("jobs_found") > 0),
               F.struct(F.lit("jobs_found").alias("name"),
                        F.col("jobs_found").cast("double").alias("value")))))
    labels = F.create_map(F.lit("company_id"), F.col("company_id").cast("string"),
                          F.lit("ats_type"), F.col("ats_type"))
    return (results.select(labels.alias("labels"), F.explode(rows).alias("m"))
            .select("m.name", "m.value", "labels", ts(as_of).alias("recorded_at")))


def update_where(df: DataFrame, predicate: Column, **values) -> DataFrame:
    """K8: new values where the predicate is true; null means no change."""
    out = []
    for name in df.columns:
        if name in values:
            v = values[name]
            v = v if isinstance(v, Column) else F.lit(v)
            out.append(F.when(predicate, v).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """K9: rows for which the predicate is not true."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def cascade_delete(tables: dict[str, DataFrame], company_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove companies with their snapshots, jobs, matches and listings.

    Children go with their parent; the queue only loses its reference.
    ``company_ids`` has one column ``company_id``.
    """
    gone = company_ids.select("company_id").distinct()
    out = dict(tables)
    out["companies"] = tables["companies"].join(
        gone.withColumnRenamed("company_id", "id"), "id", "left_anti")
    for name in ("crawl_snapshots", "jobs_raw", "jobs"):
        if name in tables:
            out[name] = tables[name].join(gone, "company_id", "left_anti")
    if "jobs" in tables:
        lost = tables["jobs"].join(gone, "company_id", "left_semi").select(F.col("id").alias("job_id"))
        for name in ("matches", "job_board_listings"):
            if name in tables:
                out[name] = tables[name].join(lost, "job_id", "left_anti")
    if "discovery_queue" in tables:
        q = tables["discovery_queue"]
        mark = gone.withColumn("__gone", F.lit(True))
        out["discovery_queue"] = (q.join(mark, "company_id", "left")
                                  .withColumn("company_id", F.when(F.col("__gone").isNull(), F.col("company_id")))
                                  .select(*q.columns))
    return out


def fold_match_events(events: DataFrame) -> DataFrame:
    """Events ``(candidate_id, job_id, kind, at)`` as first time shown and last time clicked per match."""
    return events.groupBy("candidate_id", "job_id").agg(
        F.min(F.when(F.col("kind") == "shown", F.col("at"))).alias("shown_at"),
        F.max(F.when(F.col("kind") == "clicked", F.col("at"))).alias("clicked_at"))


def apply_match_folds(matches: DataFrame, folds: DataFrame) -> DataFrame:
    """First time shown (an older mark stays) and last time clicked, from any number of folds per match."""
    e = folds.groupBy("candidate_id", "job_id").agg(F.min("shown_at").alias("__shown"), F.max("clicked_at").alias("__clicked"))
    return (matches.join(e, ["candidate_id", "job_id"], "left")
            .withColumn("shown_at", F.coalesce("shown_at", "__shown"))
            .withColumn("clicked_at", F.coalesce("__clicked", "clicked_at"))
            .select(*matches.columns))


def apply_match_events(matches: DataFrame, events: DataFrame) -> DataFrame:
    """K12 in one step; events are aggregated before the join."""
    return apply_match_folds(matches, fold_match_events(events))
