"""Streams that keep product tables current.

The batch operators do the work; streams add watermarks, state and versions.
Every writer takes ``available_now`` (R6): process what is there, then stop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as tx
from ..operators.upserts import apply_match_folds, fold_match_events
from ..plans.discover import discover
from ..plans.normalize import normalize_jobs
from ..session import new_folder
from . import state


def start(df: DataFrame, checkpoint: str, mode: str = "append", available_now: bool = True,
          every: str = "1 minute", batch: Callable[[DataFrame, int], None] | None = None,
          path: str | None = None) -> StreamingQuery:
    """Start a stream into Parquet or a batch function."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)
    if batch is not None:
        return w.foreachBatch(batch).start()
    return w.format("parquet").option("path", path).start()


def first_per_domain(found: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows with a domain not seen within the watermark delay.

    ``found`` carries ``discovered_at``.  State is bounded by the watermark;
    older repeats are dropped later by the anti join with the company table.
    """
    f = found.withColumn("domain", F.coalesce(F.lower("domain"), tx.derive_domain("website_url", "careers_url"))
                         if "domain" in found.columns else tx.derive_domain("website_url", "careers_url"))
    return f.withWatermark("discovered_at", delay).dropDuplicatesWithinWatermark(["domain"])


def discover_batch(companies: Callable[[], DataFrame], queue: Callable[[], DataFrame],
                   save: Callable[[DataFrame, DataFrame, DataFrame, int], None], as_of) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: route a micro-batch against the current tables.

    ``companies`` and ``queue`` read the tables anew for each batch, and
    ``save`` stores new companies, queue rows and outcomes under the batch
    number, so a repeated batch overwrites itself.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        new, queued, routed = discover(batch, companies(), queue(), as_of)
        save(new, queued, routed, batch_id)
    return run


def normalize_stream(jobs_raw: DataFrame, as_of) -> DataFrame:
    """Normalisation is stateless, so the batch plan is the stream plan."""
    return normalize_jobs(jobs_raw, as_of)


def crawl_series(crawls: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Crawls, successes and rate per window; rows later than ``delay`` are dropped."""
    w = F.window("crawled_at", window, slide) if slide else F.window("crawled_at", window)
    ok = F.count_if(F.col("status_code") == 200)
    return (crawls.withWatermark("crawled_at", delay).groupBy(w.alias("w"))
            .agg(F.count("*").alias("crawls"), ok.alias("successes"), tx.safe_ratio(ok, F.count("*"), 3).alias("success_rate"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "crawls", "successes", "success_rate"))


def engagement_sessions(clicks: DataFrame, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of a candidate's clicks."""
    return (clicks.withWatermark("at", delay).groupBy(F.session_window("at", gap).alias("s"), "candidate_id")
            .agg(F.count("*").alias("clicks"))
            .select("candidate_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "clicks"))


def engagement_batch(save: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: a batch of shown and clicked events folded to one row per match.

    ``save`` appends the fold under the batch number; the match table is not
    touched.  :func:`engaged` shows matches with all folds, and a periodic job
    can write its result as a new version and drop the folds it has taken in.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        save(fold_match_events(batch), batch_id)
    return run


def engaged(matches: DataFrame, folds: DataFrame) -> DataFrame:
    """Matches with the times of their folded events."""
    return apply_match_folds(matches, folds)


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet in the shared folder and read the result back.

    Each batch writes its own folder again if it is repeated; in complete
    mode the newest result replaces the one before.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stream")

    def save(batch: DataFrame, batch_id: int) -> None:
        part = "all" if mode == "complete" else str(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/out/part={part}")

    start(df, f"{path}/checkpoint", mode, batch=save).awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def run_changes(snapshots: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drain :func:`state.changed_pages` over a snapshot stream, end it and read the kept rows back."""
    spark = snapshots.sparkSession
    path = new_folder(spark, "changes")
    slim = snapshots.select(F.col("company_id").cast("long").alias("company_id"), F.col("id").cast("long").alias("id"),
                            tx.content_hash("html").alias("html_hash"), "crawled_at")
    state.end_marker(spark).limit(0).write.parquet(f"{path}/end")
    both = slim.unionByName(spark.readStream.schema(state.SNAPSHOT).parquet(f"{path}/end"))
    kept = state.changed_pages(both, delay)
    start(kept, f"{path}/checkpoint", path=f"{path}/out").awaitTermination()
    state.end_marker(spark).write.mode("append").parquet(f"{path}/end")
    start(kept, f"{path}/checkpoint", path=f"{path}/out").awaitTermination()
    return spark.read.schema(state.SNAPSHOT).parquet(f"{path}/out")


def run_engagement(events: DataFrame, matches: DataFrame) -> DataFrame:
    """Drain :func:`engagement_batch` over an event stream and show the matches."""
    spark = events.sparkSession
    path = new_folder(spark, "engagement")
    start(events, f"{path}/checkpoint", batch=engagement_batch(
        lambda fold, i: fold.write.mode("overwrite").parquet(f"{path}/folds/part={i}"))).awaitTermination()
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = f"candidate_id {kinds['candidate_id']}, job_id {kinds['job_id']}, shown_at timestamp, clicked_at timestamp"
    return engaged(matches, spark.read.schema(schema).parquet(f"{path}/folds"))


def run_attribution(events: DataFrame, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Drain :func:`state.attributed_clicks` over an event stream (id, candidate_id, job_id, kind, at), end it and read the clicks back."""
    spark = events.sparkSession
    path = new_folder(spark, "attribution")
    schema = f"id long, candidate_id {events.schema['candidate_id'].dataType.simpleString()}, job_id {events.schema['job_id'].dataType.simpleString()}, kind string, at timestamp"
    # the marks have keys, since rows without are left out before the watermarks; nothing else is so late that it could meet them
    ends = spark.createDataFrame([(-1, "0", "0", "shown"), (-2, "0", "0", "clicked")], "id long, candidate_id string, job_id string, kind string")
    ends = ends.withColumn("at", F.lit(state.END).cast("timestamp")).select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(schema)])
    ends.limit(0).write.parquet(f"{path}/end")
    both = events.select(*[F.col(c).cast(ends.schema[c].dataType).alias(c) for c in ends.columns]).unionByName(spark.readStream.schema(ends.schema).parquet(f"{path}/end"))
    of = lambda kind, name: both.filter(F.col("kind") == kind).withColumnRenamed("at", name)
    out = state.attributed_clicks(of("shown", "shown_at"), of("clicked", "clicked_at").withColumnRenamed("id", "click_id"), within, delay)
    for _ in range(2):
        start(out, f"{path}/checkpoint", path=f"{path}/out").awaitTermination()
        ends.write.mode("append").parquet(f"{path}/end")  # the first run takes what is there, the second ends it
    return spark.read.schema(out.schema).parquet(f"{path}/out")


def run_discovery(found: DataFrame, companies: DataFrame, queue: DataFrame, as_of) -> DataFrame:
    """Drain :func:`discover_batch` over found companies and read the outcomes back: (row_id, domain, outcome)."""
    spark = found.sparkSession
    path = new_folder(spark, "discovery")

    def save(new, queued, routed, batch_id):
        routed.select("row_id", "domain", "outcome").write.mode("overwrite").parquet(f"{path}/out/part={batch_id}")

    start(found, f"{path}/checkpoint", batch=discover_batch(lambda: companies, lambda: queue, save, as_of)).awaitTermination()
    return spark.read.schema("row_id long, domain string, outcome string").parquet(f"{path}/out").drop("part")
