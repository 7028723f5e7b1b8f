"""Table schemas and the value rules that belong to them."""

from __future__ import annotations

from pyspark.sql import types as T

from .rules import roles

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS, _AS, _V = T.TimestampType(), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())
_MAP = T.MapType(_S, _S)
_LOGS = T.ArrayType(T.StructType([T.StructField("ts", _TS), T.StructField("level", _S),
                                  T.StructField("msg", _S), T.StructField("run_id", _S),
                                  T.StructField("data", _MAP)]))


def _table(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


TABLES = {
    "companies": _table(
        id=_S, name=_S, domain=_S, careers_url=_S, website_url=_S, ats_type=_S, ats_identifier=_S,
        crawl_priority=_I, last_crawled_at=_TS, is_active=_B, created_at=_TS, discovery_source=_S,
        discovered_at=_TS, country=_S, location=_S, description=_S, industry=_S, employee_count=_I,
        funding_stage=_S, ats_detection_attempts=_I, ats_detection_last_at=_TS, parent_company_id=_S,
        last_maintenance_at=_TS, last_crawled_for_network=_TS, crawl_attempts=_I),
    "crawl_snapshots": _table(id=_S, company_id=_S, url=_S, html_hash=_S, html_content=_S,
                              status_code=_I, rendered=_B, crawled_at=_TS),
    "jobs_raw": _table(id=_S, company_id=_S, source_url=_S, title_raw=_S, description_raw=_S,
                       location_raw=_S, department_raw=_S, employment_type_raw=_S,
                       posted_at_raw=_S, salary_raw=_S, extracted_at=_TS),
    "jobs": _table(
        id=_S, company_id=_S, raw_job_id=_S, source_url=_S, title=_S, description=_S, role_family=_S,
        role_specialization=_S, seniority=_S, location_type=_S, locations=_AS, skills=_AS,
        min_salary=_L, max_salary=_L, employment_type=_S, posted_at=_TS, freshness_score=_D,
        embedding=_V, is_active=_B, created_at=_TS, updated_at=_TS, last_verified_at=_TS,
        delisted_at=_TS, delist_reason=_S, enrich_failed_at=_TS),
    "candidate_profiles": _table(
        id=_S, waitlist_id=_S, email=_S, name=_S, role_families=_AS, seniority=_S, min_salary=_L,
        locations=_AS, location_types=_AS, role_types=_AS, skills=_AS, exclusions=_AS, embedding=_V,
        last_matched_at=_TS, last_notified_at=_TS, is_active=_B, created_at=_TS, updated_at=_TS),
    "matches": _table(candidate_id=_S, job_id=_S, score=_D, hard_match=_B, match_reasons=_MAP,
                      shown_at=_TS, clicked_at=_TS, applied_at=_TS, dismissed_at=_TS, created_at=_TS),
    "metrics": _table(id=_S, name=_S, value=_D, labels=_MAP, recorded_at=_TS),
    "discovery_queue": _table(
        id=_S, name=_S, domain=_S, careers_url=_S, website_url=_S, source=_S, source_url=_S,
        location=_S, country=_S, description=_S, industry=_S, employee_count=_I, funding_stage=_S,
        ats_type=_S, ats_identifier=_S, status=_S, error_message=_S, retry_count=_I, created_at=_TS,
        processed_at=_TS, company_id=_S),
    "discovery_runs": _table(
        id=_S, source=_S, status=_S, total_discovered=_I, new_companies=_I, updated_companies=_I,
        skipped_duplicates=_I, filtered_non_us=_I, errors=_I, logs=_LOGS, current_step=_S,
        progress_count=_I, progress_total=_I, started_at=_TS, completed_at=_TS),
    "job_board_listings": _table(job_id=_S, board=_S, found=_B, confidence=_D, listing_url=_S,
                                 search_query=_S, search_result_count=_I, verified_at=_TS),
    "verification_runs": _table(id=_S, board=_S, status=_S, jobs_checked=_I, jobs_found=_I,
                                jobs_unique=_I, uniqueness_rate=_D, started_at=_TS, completed_at=_TS),
    "maintenance_runs": _table(id=_S, run_type=_S, ats_type=_S, status=_S, companies_checked=_I,
                               jobs_verified=_I, new_jobs=_I, delisted_jobs=_I, unchanged_jobs=_I,
                               errors=_I, logs=_LOGS, started_at=_TS, completed_at=_TS),
    "pipeline_runs": _table(id=_S, stage=_S, status=_S, started_at=_TS, completed_at=_TS,
                            processed=_I, failed=_I, error=_S, current_step=_S, cascade=_B, logs=_LOGS),
    "companies_dormant": _table(id=_S, name=_S, domain=_S, careers_url=_S, website_url=_S,
                                dormant_reason=_S, last_checked_at=_TS, check_count=_I, moved_at=_TS,
                                original_created_at=_TS),
    "waitlist": _table(id=_S, name=_S, email=_S, created_at=_TS),
    "waitlist_details": _table(id=_S, waitlist_id=_S, field=_S, seniority=_S, expected_pay=_I,
                               country=_S, work_type=_AS, role_type=_AS),
    # landing tables written by fetchers outside this library
    "payloads": _table(company_id=_S, ats_type=_S, ats_identifier=_S, url=_S, body=_S),
    "fetches": _table(url=_S, final_url=_S, status=_I, html=_S, fetched_at=_TS),
    "pages": _table(page_id=_S, company_id=_S, url=_S, html=_S, status_code=_I, crawled_at=_TS),
    "feed_items": _table(title=_S, description=_S, link=_S, pub_date=_S, feed_name=_S),
    "board_cards": _table(job_id=_S, board=_S, rank=_I, card_company=_S, card_title=_S, href=_S),
    "search_hits": _table(job_id=_S, site=_S, rank=_I, href=_S, text=_S),
    "job_details": _table(ats_type=_S, ats_identifier=_S, provider_job_id=_S, status=_I,
                          description_html=_S, published_at=_S),
}

# ---------------------------------------------------------------------------
# Allowed values and ranges.
# ---------------------------------------------------------------------------
WORK_PLACES = ["remote", "hybrid", "onsite"]
EMPLOYMENT = ["full_time", "part_time", "contract", "freelance", "internship"]
QUEUE_STATES = ["pending", "processing", "completed", "failed", "skipped", "review"]

# table → (rule name, column, kind, values); every rule passes on null
RULES = {
    "companies": [("crawl_priority_range", "crawl_priority", "range", (0, 100)),
                  ("country_two_letters", "country", "length", 2)],
    "jobs": [("role_family_known", "role_family", "in", roles.ALL_ROLE_FAMILIES),
             ("seniority_known", "seniority", "in", roles.SENIORITY_LEVELS),
             ("location_type_known", "location_type", "in", WORK_PLACES),
             ("employment_type_known", "employment_type", "in", EMPLOYMENT),
             ("freshness_range", "freshness_score", "range", (0.0, 1.0))],
    "candidate_profiles": [("seniority_known", "seniority", "in", roles.SENIORITY_LEVELS),
                           ("location_types_known", "location_types", "subset", WORK_PLACES),
                           ("role_types_known", "role_types", "subset",
                            ["permanent", "contract", "freelance"])],
    "matches": [("score_range", "score", "range", (0.0, 1.0))],
    "discovery_queue": [("status_known", "status", "in", QUEUE_STATES)],
    "job_board_listings": [("confidence_range", "confidence", "range", (0.0, 1.0))],
    "verification_runs": [("uniqueness_range", "uniqueness_rate", "range", (0.0, 1.0))],
}
# ---------------------------------------------------------------------------
