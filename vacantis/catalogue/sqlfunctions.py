"""The SQL functions, called from SQL and held against the checks of the DataFrame forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sqlapi
from ..bindings import AS_OF, bind, load
from ..functions.core import iso
from . import ORACLES, aggregates, fuzzy, query, vectors  # noqa: F401  whose checks hold here too


def _registered(spark, sf):
    sqlapi.register(spark, AS_OF, "sq_", jobs=vectors.jobs_with_vectors(spark, sf), companies=bind(spark, sf, "companies"),
                    listings=bind(spark, sf, "listings"), queue=bind(spark, sf, "queue"))


@query("sql_similar_jobs", ORACLES["similar_jobs"])
def sql_similar_jobs(spark, sf):
    _registered(spark, sf)
    target = load(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").cast("array<double>")).first()[0]
    return spark.sql("SELECT job_id AS id, round(similarity, 6) AS similarity FROM sq_find_similar_jobs(:target, 25, min_similarity => 0.1D)", {"target": target})


@query("sql_discovery_stats", ORACLES["discovery_stats"])
def sql_discovery_stats(spark, sf):
    _registered(spark, sf)
    return spark.sql("SELECT * FROM sq_get_discovery_stats()")


@query("sql_verification_summary", ORACLES["verification_summary"])
def sql_verification_summary(spark, sf):
    _registered(spark, sf)
    return spark.sql("SELECT * FROM sq_get_verification_summary()")


@query("sql_jobs_for_verification", ORACLES["jobs_for_verification"])
def sql_jobs_for_verification(spark, sf):
    _registered(spark, sf)
    return spark.sql("SELECT job_id, company_name, last_verified_at FROM sq_get_jobs_for_verification('R')").select(
        "job_id", "company_name", iso("last_verified_at").alias("last_verified_at"))


@query("sql_freshness", f"""
    SELECT o_orderkey AS id, round(0.5 ** (date_diff('microsecond', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '{AS_OF}') / 86400000000.0 / 7), 9) AS a,
           round(0.5 ** (date_diff('microsecond', CAST(o_orderdate AS TIMESTAMP), TIMESTAMP '2000-01-01') / 86400000000.0 / 3000), 6) AS b FROM orders""")
def sql_freshness(spark, sf):
    _registered(spark, sf)
    return spark.sql("""SELECT o_orderkey AS id, round(sq_calculate_freshness_score(CAST(o_orderdate AS TIMESTAMP)), 9) AS a,
        round(sq_calculate_freshness_score(CAST(o_orderdate AS TIMESTAMP), 3000, TIMESTAMP '2000-01-01'), 6) AS b FROM {orders}""", orders=load(spark, sf, "orders"))
