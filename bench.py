"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "top_k_matches", "match_pairs", "weekly_digest", "explain_no_matches", "job_feed", "job_page", "candidate_matches",
    "system_metrics", "maintenance_by_ats", "supported_by_ats", "returning_companies_daily", "freshness_histogram",
    "verification_summary", "pipeline_stats", "normalize_jobs", "skills_text", "role_family_text", "location_type_text",
    "upsert_jobs", "reconcile", "discover_outcomes", "changed_snapshots", "latest_snapshot", "top_k_per_key",
    "match_board", "similar_jobs", "mean_pool", "payload_jobs", "jsonld_jobs", "generic_jobs", "chunk_text",
    "html_to_text", "sig_words", "select_elements", "similar_jobs_many", "match_cards_by_text", "keyed_upsert_jobs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from vacantis import catalogue
    from vacantis.session import build_session

    catalogue.load_all()
    spark = build_session(f"local[{cpus}]", cpus, os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the workers
    times = {}
    for name in names:
        begin = time.perf_counter()
        # every row is computed and dropped, so the sink costs nothing
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
