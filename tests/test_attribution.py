"""Clicks attributed to showings by a stream-stream join, beside a plain search."""

import random

from pyspark.sql import functions as F

from vacantis.streaming import state, streams as sm


def test_stream_equals_a_plain_search(spark, tmp_path):
    r = random.Random(14)
    rows = []
    for i in range(400):
        who = r.choice([1, 1, 1, 2, 3, None])
        rows.append((i, who, r.choice([10, 10, 20, None]), r.choice(["shown", "clicked"]), 1_700_000_000 + 600 * i + r.randrange(3000)))
    rows += [(1000, 1, 10, "clicked", None), (1001, 1, 10, "shown", None), (1002, 1, 10, "shown", 1_700_000_000), (1003, 1, 10, "clicked", 1_700_000_000), (1004, 9, 9, "clicked", 1_700_200_000)]
    df = spark.createDataFrame(rows, "id long, candidate_id long, job_id long, kind string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    ordered = sorted(rows, key=lambda x: x[4] or 0)
    for k in range(0, len(rows), 150):
        df.filter(F.col("id").isin([x[0] for x in ordered[k:k + 150]])).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {x.click_id: x.shown_at for x in sm.run_attribution(stream, "3 hours", "2 hours").collect()}
    want = {}
    for i, c, j, kind, at in rows:
        if kind == "clicked" and at is not None:
            want[i] = max((s for _, d, k, x, s in rows if x == "shown" and s is not None and d is not None and k is not None and (d, k) == (c, j) and at - 10800 <= s <= at), default=None)
    assert {i: x and int(x.timestamp()) for i, x in got.items()} == want and any(want.values()) and None in want.values()


def test_state_is_bounded_by_the_watermarks(spark, tmp_path):
    """Showings and clicks that both watermarks have passed leave the state."""
    df = spark.range(300).select(F.col("id"), F.lit(1).cast("long").alias("candidate_id"), F.col("id").alias("job_id"),
                                 F.expr("CASE WHEN id % 2 = 0 THEN 'shown' ELSE 'clicked' END").alias("kind"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("at"))
    for k in range(3):
        df.filter(f"id >= {k * 100} AND id < {k * 100 + 100}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    of = lambda kind, name: src.filter(F.col("kind") == kind).withColumnRenamed("at", name)
    out = state.attributed_clicks(of("shown", "shown_at"), of("clicked", "clicked_at").withColumnRenamed("id", "click_id"), "5 hours", "2 hours")
    q = sm.start(out, f"{tmp_path}/cp", path=f"{tmp_path}/out")
    q.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert held and held[-1] < 40 < 300
