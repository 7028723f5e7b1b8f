"""The driver's tables seen as the product's tables.

Each binding is one SELECT over one or two driver tables, written once and
rendered for Spark or for the SQL engine that checks the results.  Nothing
is sampled or capped: every binding row comes from one driver row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2001-08-02 00:00:00"       # reference time of the job tables
AS_OF_EVENTS = "2024-01-31 00:00:00"  # reference time of the event tables

LEVELS = ["Senior ", "", "Sr. ", "Junior ", "", "Staff ", "Principal ", "Head of ", "VP, ", "Lead ", "Intern, "]
TITLES = [
    "Software Engineer", "Backend Developer", "Frontend Engineer (React)", "iOS Engineer",
    "DevOps Engineer", "Site Reliability Engineer", "Platform Engineer", "Data Engineer",
    "Machine Learning Engineer", "Data Analyst", "Product Manager", "UX Designer",
    "Engineering Manager", "Solutions Engineer", "Account Executive", "Growth Marketing Manager",
    "Customer Success Manager", "Operations Associate", "Technical Recruiter", "Financial Controller",
    "Legal Counsel", "Cloud Security Engineer", "Chef",
]
PLACES = [
    "San Francisco, CA", "Remote - US", "New York or hybrid", "London, UK", "Austin, TX", "",
    "Berlin, Germany", "Work from home", "Based in Springfield area", "2 days in office, Chicago",
    "Toronto, Canada", "Onsite Munich", "Atlanta",
]
KINDS = ["Full-time", "Part time", "Contractor", "Freelance", "Internship", "Permanent", ""]
STACKS = [
    "We use Python, Django and PostgreSQL on AWS. 5+ years of experience required.",
    "React and TypeScript front ends; Node.js services. 2-4 years in a similar role.",
    "Kubernetes, Docker and Terraform on Google Cloud Platform. 10 years experience.",
    "",
    "Spark, Kafka and Airflow pipelines in Scala or Java. 1 yr exp is enough.",
    "Ruby on Rails with Redis and CI/CD; GitHub Actions.",
    "You will talk to customers all day.",
    "PyTorch or TensorFlow models, 12+ yrs of experience with C++ and CUDA.",
]
FAMILIES = ["software_engineering", "infrastructure", "data", "product", "design",
            "engineering_management", "sales", "marketing", "customer_success", "operations",
            "people", "finance", "legal", "other"]
SENIORITIES = ["intern", "junior", "mid", "senior", "staff", "principal", "director", "vp", "c_level"]


class _Spark:
    string = "STRING"

    @staticmethod
    def arr(*items):
        return "array(" + ", ".join(items) + ")"

    @staticmethod
    def days(ts, n):
        return f"({ts} + make_interval(0, 0, 0, {n}))"

    @staticmethod
    def empty():
        return "CAST(array() AS array<string>)"

    @staticmethod
    def words(sql, sep):
        return f"split({sql}, '{sep}')"

    @staticmethod
    def json_int(c, key):
        return f"CAST(get_json_object({c}, '$.{key}') AS BIGINT)"


class _Duck:
    string = "VARCHAR"

    @staticmethod
    def arr(*items):
        return "[" + ", ".join(items) + "]"

    @staticmethod
    def days(ts, n):
        return f"({ts} + to_days(CAST({n} AS INTEGER)))"

    @staticmethod
    def empty():
        return "CAST([] AS VARCHAR[])"

    @staticmethod
    def words(sql, sep):
        return f"string_split({sql}, '{sep}')"

    @staticmethod
    def json_int(c, key):
        return f"CAST(json_extract_string({c}, '$.{key}') AS BIGINT)"


def pick(index: str, values: list[str]) -> str:
    """SQL: the value at ``index`` modulo the list length."""
    quoted = [v.replace("'", "''") for v in values]
    body = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(quoted))
    return f"(CASE ({index}) % {len(values)} {body} END)"


def _sql(d) -> dict[str, tuple[list[str], str]]:
    """name → (driver tables, SELECT)."""
    day0 = "CAST('1995-01-01' AS TIMESTAMP)"
    ats = ("CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'greenhouse' WHEN 'BUILDING' THEN 'lever' "
           "WHEN 'HOUSEHOLD' THEN 'ashby' WHEN 'MACHINERY' THEN 'custom' END")
    out = {}
    out["companies"] = (["customer"], f"""
        SELECT c_custkey AS id,
               concat('Customer ', c_custkey, {pick('c_custkey', [' Inc.', ' Technologies', ' LLC', '', ' Corp', ' Labs'])}) AS name,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('customer', c_custkey, {pick('c_custkey', ['.com', '.io', '.co.uk'])}) END AS domain,
               CASE c_custkey % 8 WHEN 0 THEN NULL
                    WHEN 1 THEN concat('https://boards.greenhouse.io/customer', c_custkey)
                    WHEN 2 THEN concat('https://jobs.lever.co/customer', c_custkey, '/all')
                    WHEN 3 THEN concat('https://www.customer', c_custkey, '.com/careers')
                    WHEN 4 THEN concat('https://jobs.ashbyhq.com/customer', c_custkey)
                    WHEN 5 THEN concat('https://customer', c_custkey, '.recruitee.com')
                    WHEN 6 THEN concat('https://example.org/blog/customer', c_custkey)
                    ELSE concat('https://careers-customer', c_custkey, '.icims.com/jobs') END AS careers_url,
               CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://www.customer', c_custkey, '.com/about') END AS website_url,
               {ats} AS ats_type,
               CASE WHEN {ats} IS NOT NULL THEN concat('customer', c_custkey) END AS ats_identifier,
               CAST(c_custkey % 101 AS INT) AS crawl_priority,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE {d.days("CAST('2001-07-01' AS TIMESTAMP)", 'c_custkey % 40')} END AS last_crawled_at,
               CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE {d.days("CAST('2001-07-05' AS TIMESTAMP)", 'c_custkey % 35')} END AS last_maintenance_at,
               c_acctbal > 0 AS is_active,
               {d.days(day0, 'c_custkey % 2404')} AS created_at,
               CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'yc' WHEN 2 THEN 'github' ELSE 'news' END AS discovery_source,
               CASE WHEN c_nationkey < 12 THEN 'US' ELSE 'GB' END AS country,
               CASE WHEN c_custkey % 6 = 0 THEN '' ELSE {pick('c_custkey', PLACES)} END AS location,
               CAST(CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE c_custkey % 4 END AS INT) AS ats_detection_attempts,
               CASE WHEN c_custkey % 13 = 5 THEN {d.days("CAST('2001-06-01' AS TIMESTAMP)", 'c_custkey % 9')} END AS last_crawled_for_network
        FROM customer""")
    out["jobs_raw"] = (["orders"], f"""
        SELECT o_orderkey AS id, o_custkey AS company_id,
               concat('https://boards.greenhouse.io/customer', o_custkey, '/jobs/', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '?gh_src=x' ELSE '' END) AS source_url,
               concat({pick('o_orderkey', LEVELS)}, {pick('o_orderkey * 7 + o_custkey', TITLES)}) AS title_raw,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {pick('o_orderkey + o_custkey', STACKS)} END AS description_raw,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE {pick('o_custkey + o_orderkey', PLACES)} END AS location_raw,
               o_orderpriority AS department_raw,
               {pick('o_orderkey', KINDS)} AS employment_type_raw,
               CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('$', CAST(floor(o_totalprice / 1000) AS BIGINT), 'k - $', CAST(floor(o_totalprice / 800) AS BIGINT), 'k')
                    WHEN 2 THEN concat('€', CAST(floor(o_totalprice) AS BIGINT)) ELSE 'competitive' END AS salary_raw,
               concat(substr(concat('', CAST(o_orderdate AS DATE)), 1, 10), CASE WHEN o_orderkey % 2 = 0 THEN 'T09:30:00Z' ELSE '' END) AS posted_at_raw,
               CAST(o_orderdate AS TIMESTAMP) AS extracted_at
        FROM orders""")
    out["jobs"] = (["orders"], f"""
        SELECT o_orderkey AS id, o_custkey AS company_id,
               concat('https://boards.greenhouse.io/customer', o_custkey, '/jobs/', o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '?gh_src=x' ELSE '' END) AS source_url,
               concat({pick('o_orderkey', LEVELS)}, {pick('o_orderkey * 7 + o_custkey', TITLES)}) AS title,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {pick('o_orderkey + o_custkey', STACKS)} END AS description,
               {pick('o_orderkey + o_custkey', FAMILIES)} AS role_family,
               CASE WHEN o_orderkey % 3 = 1 THEN 'backend' WHEN o_orderkey % 3 = 2 THEN 'mobile' END AS role_specialization,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'staff' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'mid' WHEN '4-NOT SPECIFIED' THEN 'junior' ELSE 'director' END AS seniority,
               CASE o_orderkey % 4 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'onsite' END AS location_type,
               CASE o_custkey % 4 WHEN 0 THEN {d.arr("'San Francisco, CA'")} WHEN 1 THEN {d.arr("'New York, NY'", "'US'")} WHEN 2 THEN {d.arr("'Berlin, Germany'")} ELSE {d.empty()} END AS locations,
               CASE o_orderkey % 6 WHEN 0 THEN {d.arr("'python'", "'sql'", "'aws'")} WHEN 1 THEN {d.arr("'react'", "'typescript'")} WHEN 2 THEN {d.arr("'java'", "'spark'", "'kafka'", "'scala'")} WHEN 3 THEN {d.empty()} WHEN 4 THEN {d.arr("'python'", "'pandas'")} ELSE {d.arr("'golang'", "'docker'", "'kubernetes'")} END AS skills,
               CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE floor(o_totalprice * 0.8) END AS BIGINT) AS min_salary,
               CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE floor(o_totalprice) END AS BIGINT) AS max_salary,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS posted_at,
               CAST((o_orderkey % 100) / 100.0 AS DOUBLE) AS freshness_score,
               o_orderstatus <> 'F' AS is_active,
               CAST(o_orderdate AS TIMESTAMP) AS created_at,
               {d.days('CAST(o_orderdate AS TIMESTAMP)', 'o_orderkey % 3')} AS updated_at,
               CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE {d.days('CAST(o_orderdate AS TIMESTAMP)', 'o_custkey % 50')} END AS last_verified_at,
               CASE WHEN o_orderstatus = 'F' THEN {d.days('CAST(o_orderdate AS TIMESTAMP)', '30')} END AS delisted_at,
               CASE WHEN o_orderstatus = 'F' THEN 'removed_from_ats' END AS delist_reason
        FROM orders""")
    out["candidates"] = (["supplier"], f"""
        SELECT s_suppkey AS id, concat('s', s_suppkey, '@mail.example') AS email, s_name AS name,
               CASE WHEN s_suppkey % 10 = 0 THEN {d.empty()}
                    ELSE {d.arr(pick('s_suppkey', FAMILIES), pick('s_suppkey * 3 + 1', FAMILIES))} END AS role_families,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE {pick('s_suppkey', SENIORITIES)} END AS seniority,
               CAST(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE floor(abs(s_acctbal) * 20) END AS BIGINT) AS min_salary,
               CASE s_suppkey % 3 WHEN 0 THEN {d.empty()} WHEN 1 THEN {d.arr("'new york'")} ELSE {d.arr("'Berlin, Germany'", "'san francisco, ca'")} END AS locations,
               CASE s_suppkey % 5 WHEN 0 THEN {d.empty()} WHEN 1 THEN {d.arr("'remote'")} WHEN 2 THEN {d.arr("'remote'", "'hybrid'")} WHEN 3 THEN {d.arr("'onsite'", "'hybrid'")} ELSE {d.arr("'remote'", "'hybrid'", "'onsite'")} END AS location_types,
               CASE s_suppkey % 4 WHEN 0 THEN {d.arr("'Python'", "'sql'")} WHEN 1 THEN {d.arr("'react'", "'typescript'", "'css'")} WHEN 2 THEN {d.empty()} ELSE {d.arr("'java'", "'kafka'", "'docker'")} END AS skills,
               CASE s_suppkey % 3 WHEN 1 THEN {d.arr("'Chef'")} WHEN 2 THEN {d.arr("'scala'", "'counsel'")} ELSE {d.empty()} END AS exclusions,
               s_suppkey % 8 <> 0 AS is_active,
               CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE {d.days("CAST('2001-07-20' AS TIMESTAMP)", 's_suppkey % 13')} END AS last_notified_at
        FROM supplier""")
    # one match per (supplier, order): the smallest line number wins
    out["matches"] = (["lineitem"], f"""
        SELECT l_suppkey AS candidate_id, l_orderkey AS job_id,
               max(l_discount) * 10 AS score, TRUE AS hard_match,
               {d.days('max(CAST(l_shipdate AS TIMESTAMP))', '0')} AS created_at,
               CASE WHEN min(l_linestatus) = 'F' THEN max(CAST(l_shipdate AS TIMESTAMP)) END AS shown_at
        FROM lineitem GROUP BY l_suppkey, l_orderkey""")
    out["listings"] = (["lineitem"], """
        SELECT l_orderkey AS job_id, l_returnflag AS board, min(l_linestatus) = 'F' AS found,
               max(l_discount) * 10 AS confidence,
               concat('https://board.example/', l_orderkey) AS listing_url,
               max(CAST(l_shipdate AS TIMESTAMP)) AS verified_at
        FROM lineitem GROUP BY l_orderkey, l_returnflag""")
    out["queue"] = (["events"], f"""
        SELECT event_id AS id, event_type AS source, concat('u', user_id, '.com') AS domain,
               concat('User ', user_id) AS name,
               CASE event_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' WHEN 3 THEN 'pending' WHEN 4 THEN 'review' ELSE 'skipped' END AS status,
               CASE WHEN event_id % 4 = 0 THEN concat('https://jobs.lever.co/u', user_id) WHEN event_id % 4 = 1 THEN concat('https://u', user_id, '.com/jobs') END AS careers_url,
               CAST(event_id % 5 AS INT) AS retry_count,
               CAST(ts AS TIMESTAMP) AS created_at
        FROM events""")
    out["dormant"] = (["customer"], f"""
        SELECT c_custkey AS id, concat('Customer ', c_custkey) AS name, concat('customer', c_custkey, '.com') AS domain,
               CASE c_custkey % 3 WHEN 0 THEN 'no_careers_page' WHEN 1 THEN 'no_website' ELSE 'exhausted' END AS dormant_reason,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {d.days("CAST('2001-05-20' AS TIMESTAMP)", 'c_custkey % 70')} END AS last_checked_at,
               {d.days("CAST('2001-04-01' AS TIMESTAMP)", 'c_custkey % 60')} AS moved_at,
               CAST(c_custkey % 3 AS INT) AS check_count
        FROM customer""")
    out["snapshots"] = (["events"], f"""
        SELECT event_id AS id, user_id AS company_id, concat('https://u', user_id, '.com/jobs') AS url,
               concat(event_type, CAST({d.json_int('props', 'k')} % 3 AS BIGINT)) AS html,
               CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
               CAST(ts AS TIMESTAMP) AS crawled_at
        FROM events""")
    out["metrics"] = (["events"], f"""
        SELECT event_id AS id, event_type AS name, value, {d.json_int('props', 'k')} AS k, CAST(ts AS TIMESTAMP) AS recorded_at
        FROM events""")
    out["runs"] = (["events"], f"""
        SELECT event_id AS id, event_type AS stage,
               CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'running' END AS status,
               {d.json_int('props', 'k')} AS processed, CAST(floor(value) AS BIGINT) AS failed,
               CAST(ts AS TIMESTAMP) AS started_at
        FROM events""")
    # live listings: two of three stored jobs are still there, plus one new one per seventh order
    out["live"] = (["orders"], """
        SELECT o_custkey AS company_id,
               concat('HTTPS://Boards.greenhouse.io/customer', o_custkey, '/jobs/', o_orderkey, '/') AS source_url,
               'still open' AS title
        FROM orders WHERE o_totalprice < 300000
        UNION ALL
        SELECT o_custkey, concat('https://boards.greenhouse.io/customer', o_custkey, '/jobs/n', o_orderkey), 'new post'
        FROM orders WHERE o_totalprice >= 300000""")
    out["discovered"] = (["events"], f"""
        SELECT event_id AS row_id, concat('User ', user_id) AS name,
               CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 7 = 3 THEN concat('https://fresh', user_id, '.com') ELSE concat('https://www.U', user_id, '.com/home?x=1') END AS website_url,
               CASE WHEN event_id % 9 = 0 AND event_id % 2 = 0 THEN concat('https://boards.greenhouse.io/u', user_id)
                    WHEN event_id % 9 = 0 THEN concat('https://jobs.u', user_id, '.net/open') END AS careers_url,
               event_type AS source,
               CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS source_rank,
               CASE WHEN event_id % 5 = 0 THEN 'US' WHEN event_id % 5 = 1 THEN 'GB' END AS country,
               {pick('event_id', PLACES)} AS location,
               CAST(ts AS TIMESTAMP) AS discovered_at
        FROM events""")
    return out


_SPARK, _DUCK = _sql(_Spark), _sql(_Duck)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; times become UTC instants."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bind(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A product table as a lazy DataFrame over driver tables."""
    tables, sql = _SPARK[name]
    frames = {t: load(spark, sf_dir, t) for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **frames)


def cte(*names: str) -> str:
    """``WITH b_x AS (...)`` for the checking engine."""
    return "WITH " + ", ".join(f"b_{n} AS ({_DUCK[n][1]})" for n in names)
