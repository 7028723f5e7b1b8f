"""The product's functions as Spark SQL: callable with parameters from any query of the session.

:func:`register` makes temporary views of the tables and temporary functions over
them; bodies are plain SQL, so calls are inlined and optimised with the query
around them, and Python is not involved.  Reference times are a parameter with the
default given at registration, never the clock.

| function | result |
|---|---|
| ``calculate_freshness_score(posted, half_life_days, as_of)`` | score (D3) |
| ``cosine_similarity(a, b)`` | similarity, null for a missing or zero vector (M3) |
| ``find_similar_jobs(target_embedding, limit_count, min_similarity)`` | (job_id, similarity) of active jobs (T9) |
| ``get_discovery_stats()`` | (source, total, completed, pending, failed) (A13) |
| ``get_verification_summary()`` | per board: jobs, verified, unique, found, rates (V5) |
| ``get_jobs_for_verification(p_board, p_limit, p_reverify_after_days, as_of)`` | the work list of a board (V3) |

Views: ``jobs``, ``companies``, ``listings``, ``queue``, each with the prefix that
:func:`register` is given; a function is only made if its tables are there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT, DEFAULT_SIMILARITY, DEFAULT_BATCH, DEFAULT_DAYS, DEFAULT_HALF_LIFE = 10, 0.5, 100, 7, 7


def _functions(p: str, as_of: str, kinds: dict[str, str]) -> dict[str, tuple[set[str], str]]:
    """name → (tables it reads, definition)."""
    job_id = kinds.get("job_id", "BIGINT")
    now = f"as_of TIMESTAMP DEFAULT TIMESTAMP '{as_of}'"
    return {
        "calculate_freshness_score": (set(), f"""(posted TIMESTAMP, half_life_days DOUBLE DEFAULT {DEFAULT_HALF_LIFE}, {now}) RETURNS DOUBLE
            RETURN coalesce(power(0.5D, (unix_micros(as_of) - unix_micros(posted)) / 86400000000D / half_life_days), 0.5D)"""),
        "cosine_similarity": (set(), """(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE
            RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v)
              / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)"""),
        "find_similar_jobs": ({"jobs"}, f"""(target_embedding ARRAY<DOUBLE>, limit_count INT DEFAULT {DEFAULT_LIMIT}, min_similarity DOUBLE DEFAULT {DEFAULT_SIMILARITY}D)
            RETURNS TABLE (job_id {job_id}, similarity DOUBLE)
            RETURN SELECT id, similarity FROM (
              SELECT id, similarity, row_number() OVER (ORDER BY similarity DESC, id) AS place FROM (
                SELECT id, {p}cosine_similarity(CAST(embedding AS ARRAY<DOUBLE>), target_embedding) AS similarity FROM {p}jobs
                WHERE is_active AND embedding IS NOT NULL) AS every WHERE similarity >= min_similarity) AS placed WHERE place <= limit_count"""),
        "get_discovery_stats": ({"queue"}, f"""() RETURNS TABLE (source STRING, total BIGINT, completed BIGINT, pending BIGINT, failed BIGINT)
            RETURN SELECT source, count(*), count_if(status = 'completed'), count_if(status = 'pending'), count_if(status = 'failed') FROM {p}queue GROUP BY source"""),
        "get_verification_summary": ({"jobs", "listings"}, f"""() RETURNS TABLE (board STRING, total_jobs BIGINT, verified_jobs BIGINT, unique_jobs BIGINT, found_jobs BIGINT,
              uniqueness_rate DOUBLE, coverage_rate DOUBLE)
            RETURN SELECT board, total, verified, apart, found, round(100D * apart / nullif(verified, 0), 2), round(100D * verified / nullif(total, 0), 2)
              FROM (SELECT board, count(*) AS verified, count_if(NOT l.found) AS apart, count_if(l.found) AS found, (SELECT count(*) FROM {p}jobs WHERE is_active) AS total
                    FROM {p}listings AS l LEFT SEMI JOIN (SELECT id FROM {p}jobs WHERE is_active) AS j ON l.job_id = j.id GROUP BY board) AS per_board"""),
        "get_jobs_for_verification": ({"jobs", "companies", "listings"}, f"""(p_board STRING, p_limit INT DEFAULT {DEFAULT_BATCH}, p_reverify_after_days INT DEFAULT {DEFAULT_DAYS}, {now})
            RETURNS TABLE (job_id {job_id}, title STRING, company_name STRING, source_url STRING, last_verified_at TIMESTAMP)
            RETURN SELECT id, title, company_name, source_url, seen FROM (
              SELECT j.id, j.title, c.name AS company_name, j.source_url, l.seen,
                     row_number() OVER (ORDER BY l.seen ASC NULLS FIRST, j.created_at DESC, j.id) AS place
              FROM {p}jobs AS j JOIN {p}companies AS c ON j.company_id = c.id
              LEFT JOIN (SELECT job_id, max(verified_at) AS seen FROM {p}listings WHERE board = p_board GROUP BY job_id) AS l ON l.job_id = j.id
              WHERE j.is_active AND (l.seen IS NULL OR l.seen < as_of - make_dt_interval(p_reverify_after_days))) AS placed WHERE place <= p_limit"""),
    }


def register(spark: SparkSession, as_of: str, prefix: str = "", **tables: DataFrame) -> list[str]:
    """Make the views and functions that these tables (jobs, companies, listings, queue) allow; the functions' names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    kinds = {"job_id": tables["jobs"].schema["id"].dataType.simpleString()} if "jobs" in tables else {}
    made = []
    for name, (needs, body) in _functions(prefix, as_of, kinds).items():
        if needs <= set(tables):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{body}")
            made.append(f"{prefix}{name}")
    return made
