"""Functions called from SQL: defaults, named parameters, null handling, and plans without Python."""

import pytest
from pyspark.sql import functions as F

from vacantis import sqlapi
from vacantis.bindings import AS_OF, bind
from vacantis.functions import dates as dt
from vacantis.operators import ordering as od
from vacantis.plans import verify as ve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    jobs = bind(spark, SF, "jobs").join(e, "id", "left")
    return jobs, sqlapi.register(spark, AS_OF, "t_", jobs=jobs, companies=bind(spark, SF, "companies"), listings=bind(spark, SF, "listings"))


def test_only_functions_whose_tables_are_there(spark, made):
    assert set(made[1]) == {"t_calculate_freshness_score", "t_cosine_similarity", "t_find_similar_jobs", "t_get_verification_summary", "t_get_jobs_for_verification"}
    assert sqlapi.register(spark, AS_OF, "u_") == ["u_calculate_freshness_score", "u_cosine_similarity"]


def test_parameters_and_defaults(spark, made):
    jobs, _ = made
    target = [float(x) for x in jobs.filter("embedding IS NOT NULL").first()["embedding"]]
    got = spark.sql("SELECT * FROM t_find_similar_jobs(:v)", {"v": target}).collect()
    want = od.similar_jobs(jobs, F.array(*[F.lit(x) for x in target])).select("id", "similarity").collect()
    assert [r.job_id for r in got] == [r.id for r in want] and len(got) <= 10
    few = spark.sql("SELECT * FROM t_find_similar_jobs(:v, min_similarity => -1D, limit_count => 3)", {"v": target})
    assert few.count() == 3
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and ("WindowGroupLimit" in plan or "TakeOrdered" in plan)
    some = spark.sql("SELECT job_id FROM t_get_jobs_for_verification('R', 5, 30)").collect()
    same = ve.jobs_for_verification(jobs, bind(spark, SF, "companies"), bind(spark, SF, "listings"), "R", AS_OF, n=5, days=30).select("job_id").collect()
    assert sorted(some) == sorted(same) and len(some) == 5


def test_nulls(spark, made):
    r = spark.sql("SELECT t_calculate_freshness_score(NULL) AS a, t_cosine_similarity(array(0D, 0D), array(1D, 2D)) AS b, t_cosine_similarity(NULL, array(1D)) AS c, "
                  "t_calculate_freshness_score(TIMESTAMP '2001-07-26 00:00:00') AS d").first()
    assert r.a == 0.5 and r.b is None and r.c is None and r.d == pytest.approx(0.5)
    d = spark.range(1).select(dt.freshness_exact(F.lit("2001-07-26").cast("timestamp"), AS_OF).alias("d")).first().d
    assert r.d == pytest.approx(d)
