"""Set operations (U-1 to U-4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """U-1: sources in fixed order; the position becomes ``source_rank``."""
    ranked = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)


def known_domains(companies: DataFrame, queue: DataFrame) -> DataFrame:
    """U-2: domains of companies and of open queue entries."""
    open_q = queue.filter(F.col("status").isin("pending", "processing"))
    return (companies.select(F.lower("domain").alias("domain"))
            .union(open_q.select(F.lower("domain").alias("domain")))
            .filter(F.col("domain").isNotNull()).distinct())


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U-3: distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """U-4: distinct keys of both."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_semi")
