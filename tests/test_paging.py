"""Key-set pages against offset pages, bitmaps against distinct counts, date forms one by one."""

import random

import pytest
from pyspark.sql import functions as F

from vacantis.functions import dates as dt
from vacantis.operators import aggregates as ag, ordering as od


def test_key_set_pages_equal_offset_pages(spark, tmp_path):
    r = random.Random(6)
    day = lambda: r.choice([None, *[f"2024-01-0{d} 00:00:00" for d in range(1, 6)]])
    rows = [(i, day(), day()) for i in range(300)]
    spark.createDataFrame(rows, "id long, p string, c string").select(
        "id", F.col("p").cast("timestamp").alias("posted_at"), F.col("c").cast("timestamp").alias("created_at")).write.parquet(f"{tmp_path}/j")
    jobs = spark.read.parquet(f"{tmp_path}/j")
    cursor, seen = None, []
    for number in range(1, 12):
        page = od.page_after(jobs, 29, cursor)
        want = od.page(jobs, number, 29, F.col("posted_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("id").asc()).collect()
        assert page.collect() == want
        seen += [x.id for x in want]
        cursor = od.cursor_of(page)
    assert sorted(seen) == list(range(300)) and od.cursor_of(od.page_after(jobs, 29, cursor)) is None
    deep = od.page_after(jobs, 5, {"posted_at": __import__("datetime").datetime(2024, 1, 3), "created_at": None, "id": 7})
    plan = deep._jdf.queryExecution().executedPlan().toString()
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x).split("PushedFilters:")[1]
    assert "posted_at" in pushed and "TakeOrderedAndProject" in plan


def test_bitmaps_add_up(spark):
    r = random.Random(7)
    rows = [(r.choice([None, *range(0, 200_000, 997), 5, 5, 5]), f"2024-0{r.randrange(1, 4)}-1{r.randrange(5)}") for _ in range(800)]
    df = spark.createDataFrame(rows, "id long, d string").withColumn("at", F.col("d").cast("timestamp"))
    a, b = ag.daily_bitmaps(df.limit(400), "at", "id"), ag.daily_bitmaps(df, "at", "id")
    days = ag.merged_bitmaps(a, b)
    assert days.groupBy("date", "part").count().filter("count > 1").isEmpty()
    got = {x.period: x.value for x in ag.distinct_ids(days, F.date_format("date", "yyyy-MM")).collect()}
    want = {}
    for i, d in rows:
        if i is not None:
            want.setdefault(d[:7], set()).add(i)
    assert got == {k: len(v) for k, v in want.items()} and ag.distinct_ids(days.limit(0), F.lit(1)).collect() == []


FORMS = {
    "2024-01-05T10:00Z": "2024-01-05 10:00:00", "2024-01-05T10:00:00+0000": "2024-01-05 10:00:00", "2024-01-05T10:00:00.1234567Z": "2024-01-05 10:00:00.123456",
    "2024-01-05 10:00:00.123": "2024-01-05 10:00:00.123", "2024-01-05 10:00:00+00:00": "2024-01-05 10:00:00", "5th January 2024": "2024-01-05 00:00:00",
    "January 5th, 2024": "2024-01-05 00:00:00", "Jan 2024": "2024-01-01 00:00:00", "Sept 5, 2024": "2024-09-05 00:00:00", "Jan. 5, 2024": "2024-01-05 00:00:00",
    "Fri Jan 5 10:00:00 2024": "2024-01-05 10:00:00", "20240105": "2024-01-05 00:00:00", "5 Jan 24": "2024-01-05 00:00:00", "2024/01/05 10:00": "2024-01-05 10:00:00",
    "01/05/2024 10:00 AM": "2024-01-05 10:00:00", "2024-01-05T10:00:00-02:30": "2024-01-05 12:30:00", "  1st  March 2024 ": "2024-03-01 00:00:00", "13/05/2024": "2024-05-13 00:00:00",
    "Fri, 05 Jan 2024 10:00:00 GMT": "2024-01-05 10:00:00", "2024-13-45": None, "soon": None, "": None, "Augustus 5": None, None: None, "99999999": None, "12:30": None,
}


@pytest.mark.parametrize("text", list(FORMS))
def test_date_form(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(F.date_format(dt.parse_date("t"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("d")).first().d
    want = FORMS[text]
    assert got == (None if want is None else (want if "." in want else want + ".").ljust(26, "0"))
