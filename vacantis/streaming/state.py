"""Streams with state of their own: page changes per company (R2), clicks attributed to showings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The time of the end marker.
END = "9999-01-01 00:00:00"
SNAPSHOT = "company_id long, id long, html_hash string, crawled_at timestamp"


def with_state(spark: SparkSession) -> SparkSession:
    """Arbitrary state lives in RocksDB: on the executors' disks, with changes in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class _Changes(StatefulProcessor):
    """Keeps a company's last final digest, and its snapshots that are not final yet.

    A snapshot is final once the watermark has passed it.  One timer a company
    stands at its earliest waiting snapshot; when it expires, all that is final
    is gone through in order of time, then id.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "html_hash string")
        self.waiting = handle.getListState("waiting", "at long, id long, html_hash string")
        self.timer = handle.getValueState("timer", "at long")

    def _set_timer(self, micros: int | None) -> None:
        """The timer for this waiting snapshot, in milliseconds, just behind it."""
        old = self.timer.get()[0] if self.timer.exists() else None
        new = None if micros is None else micros // 1000 + 1
        if old == new:
            return
        if old is not None:
            self.handle.deleteTimer(old)
            self.timer.clear()
        if new is not None:
            self.handle.registerTimer(new)
            self.timer.update((new,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] is None:  # only the end marker has no company
            return iter([])
        passed = timerValues.getCurrentWatermarkInMs()
        new = [(r.at, r.id, r.html_hash) for r in rows if r.at >= passed * 1000]  # the time of others is final already
        if new:  # all of a batch in one call
            self.waiting.appendList(new)
            first = min(new)[0]
            old = self.timer.get()[0] if self.timer.exists() else None
            if old is None or first // 1000 + 1 < old:
                self._set_timer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()  # the one that has expired
        waiting = {(at, id_): digest for at, id_, digest in self.waiting.get()}  # in the order they came in: the last counts
        final = sorted((*k, digest) for k, digest in waiting.items() if k[0] < passed)
        left = [(*k, digest) for k, digest in waiting.items() if k[0] >= passed]
        before = self.last.get()[0] if self.last.exists() else None
        known = self.last.exists()
        for at, id_, digest in final:
            if not known or digest != before:
                yield Row(company_id=key[0], id=id_, html_hash=digest, at=at)
            before, known = digest, True
        if final:
            self.last.update((before,))
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
        self._set_timer(min(left)[0] if left else None)


def changed_pages(snapshots: DataFrame, delay: str = "7 days") -> DataFrame:
    """R2: snapshots (company_id, id, html_hash, crawled_at) whose digest differs from the company's one before.

    A snapshot that arrives out of order within the delay is put in its place,
    so the stream gives what the batch operator gives; one that is later is
    dropped.  A snapshot comes out when a later one, of any company, has moved
    the watermark past it; :func:`end_marker` moves it past everything.  State
    is one digest per company and the snapshots within the delay.  Rows without
    company, id or time take no part; of equal ids at one time the last counts.
    """
    with_state(snapshots.sparkSession)
    s = (snapshots.select(F.col("company_id").cast("long").alias("company_id"), F.col("id").cast("long").alias("id"),
                          F.coalesce("html_hash", F.lit("")).alias("html_hash"), "crawled_at")
         .filter(F.col("id").isNotNull() & (F.col("company_id").isNotNull() & F.col("crawled_at").isNotNull() | (F.col("crawled_at") == F.lit(END).cast("timestamp"))))
         .withWatermark("crawled_at", delay).withColumn("at", F.unix_micros("crawled_at")))
    out = s.groupBy("company_id").transformWithState(_Changes(), "company_id long, id long, html_hash string, at long", "Append", "EventTime")
    return out.select("company_id", "id", "html_hash", F.timestamp_micros("at").alias("crawled_at"))


def end_marker(spark: SparkSession) -> DataFrame:
    """A snapshot of no company after all others: with it in the source, all that waits becomes final."""
    return spark.sql("SELECT CAST(NULL AS BIGINT) AS company_id, CAST(0 AS BIGINT) AS id, '' AS html_hash, CAST('" + END + "' AS TIMESTAMP) AS crawled_at")


def attributed_clicks(shown: DataFrame, clicks: DataFrame, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """(click_id, candidate_id, job_id, clicked_at, shown_at): every click with the last showing of its match before it.

    ``shown(candidate_id, job_id, shown_at)`` and ``clicks(click_id,
    candidate_id, job_id, clicked_at)`` are streams that may each be ``delay``
    late.  A showing counts up to ``within`` before the click, at the latest
    together with it; a click without one keeps a null.  Spark holds showings
    for ``within`` and the delay, clicks for the delay, and a click comes out
    once both watermarks have passed it.  A click without candidate or job has
    no showing; rows without a time take no part.
    """
    s = (shown.select(F.col("candidate_id").alias("s_candidate"), F.col("job_id").alias("s_job"), "shown_at")
         .filter(F.col("shown_at").isNotNull()).withWatermark("shown_at", delay))
    c = clicks.select("click_id", "candidate_id", "job_id", "clicked_at").filter(F.col("clicked_at").isNotNull()).withWatermark("clicked_at", delay)
    near = ((F.col("candidate_id") == F.col("s_candidate")) & (F.col("job_id") == F.col("s_job")) & (F.col("shown_at") <= F.col("clicked_at"))
            & (F.col("shown_at") >= F.col("clicked_at") - F.expr(f"INTERVAL {within}")))
    return (c.join(s, near, "left_outer").groupBy("click_id", "candidate_id", "job_id", "clicked_at").agg(F.max("shown_at").alias("shown_at")))
