"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..bindings import AS_OF, AS_OF_EVENTS, bind, cte, load
from ..functions import dates as dt, scoring as sc, text as tx
from ..functions.core import iso
from ..rules import boards, misc
from . import query, rx

_T = f"TIMESTAMP '{AS_OF}'"


@query("freshness", f"""
    SELECT id, round(CASE WHEN posted_at IS NULL THEN 0.5 ELSE pow(0.5, greatest(0, floor(date_diff('second', posted_at, {_T}) / 86400.0)) / 7.0) END, 9)::DOUBLE AS freshness,
           round(CASE WHEN posted_at IS NULL THEN 0.5 ELSE pow(0.5, (date_diff('second', posted_at, {_T}) / 86400.0) / 7.0) END, 9)::DOUBLE AS exact
    FROM ({cte('jobs')} SELECT id, posted_at FROM b_jobs)""")
def freshness(spark, sf):
    return bind(spark, sf, "jobs").select(
        "id", F.round(dt.freshness("posted_at", AS_OF), 9).alias("freshness"),
        F.round(dt.freshness_exact("posted_at", AS_OF), 9).alias("exact"))


@query("ages", f"""
    SELECT event_id AS id, floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_EVENTS}') / 86400000000.0)::BIGINT AS days,
           round(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_EVENTS}') / 1000000.0, 3)::DOUBLE AS seconds,
           CASE floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_EVENTS}') / 86400000000.0)::BIGINT WHEN 0 THEN 'Posted today' WHEN 1 THEN 'Posted yesterday'
             ELSE CASE WHEN floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_EVENTS}') / 86400000000.0) < 7
               THEN 'Posted ' || floor(date_diff('microsecond', ts, TIMESTAMP '{AS_OF_EVENTS}') / 86400000000.0)::BIGINT || ' days ago' END END AS phrase,
           ts < TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AS stale, ts >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 3 DAY AS recent FROM events""")
def ages(spark, sf):
    at = F.col("ts").cast("timestamp")
    return load(spark, sf, "events").withColumn("at", at).select(
        F.col("event_id").alias("id"), dt.days_since("at", AS_OF_EVENTS).alias("days"),
        F.round(dt.duration_s("at", F.lit(AS_OF_EVENTS).cast("timestamp")), 3).alias("seconds"),
        dt.posted_phrase("at", AS_OF_EVENTS).alias("phrase"), dt.stale("at", AS_OF_EVENTS, days=7).alias("stale"),
        dt.recent("at", AS_OF_EVENTS, days=3).alias("recent"))


@query("parse_date", """
    SELECT id, strftime(p, '%Y-%m-%d %H:%M:%S') AS parsed, coalesce(p > TIMESTAMP '2024-01-01', TRUE) AS recent FROM (
      SELECT event_id AS id, CASE WHEN event_id % 11 = 5 THEN NULL WHEN event_id % 11 IN (1, 4, 6, 8, 10) THEN date_trunc('day', ts)
        WHEN event_id % 11 IN (7, 9) THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS p FROM events)""")
def parse_date(spark, sf):
    # the same instants printed in several notations, then read back
    at = F.col("ts").cast("timestamp")
    n = F.col("event_id") % 11
    text = (F.when(n == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(n == 1, F.date_format(at, "yyyy-MM-dd"))
            .when(n == 2, F.concat(F.date_format(at, "E, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
            .when(n == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
            .when(n == 4, F.date_format(at, "MMMM d, yyyy"))
            .when(n == 6, F.date_format(at, "MMM d yyyy")).when(n == 7, F.date_format(at, "d MMMM yyyy HH:mm"))
            .when(n == 8, F.date_format(at, "yyyy/MM/dd")).when(n == 9, F.lower(F.date_format(at, "MMMM d, yyyy h:mm a")))
            .when(n == 10, F.date_format(at, "MM-dd-yyyy"))
            .otherwise(F.lit("some time ago")))
    return load(spark, sf, "events").select(
        F.col("event_id").alias("id"), iso(dt.parse_date(text)).alias("parsed"),
        dt.feed_recent(text, AS_OF_EVENTS, 30).alias("recent"))


# the same instant in further notations: (text, what of the instant it keeps)
_FORMS = [("yyyy-MM-dd'T'HH:mm'Z'", "minute"), ("yyyy-MM-dd'T'HH:mm:ss'+0000'", "second"), ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'0Z'", "microsecond"), ("yyyy-MM-dd HH:mm:ss.SSS", "millisecond"),
          ("yyyy-MM-dd HH:mm:ss'+00:00'", "second"), ("d'th' MMMM yyyy", "day"), ("MMMM d'th', yyyy", "day"), ("MMM yyyy", "month"), ("MMM'.' d, yyyy", "day"),
          ("E MMM d HH:mm:ss yyyy", "second"), ("yyyyMMdd", "day"), ("d MMM yy", "day"), ("yyyy/MM/dd HH:mm", "minute"), ("MM/dd/yyyy hh:mm a", "minute"), ("MMMM yyyy", "month"),
          ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "second")]


@query("parse_date_forms", "SELECT event_id AS id, strftime(CASE event_id % 16 " + " ".join(
    f"WHEN {i} THEN date_trunc('{part}', ts)" + (" - INTERVAL 2 HOUR" if "02:00" in form else "") for i, (form, part) in enumerate(_FORMS)) + " END, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM events")
def parse_date_forms(spark, sf):
    at, n = F.col("ts").cast("timestamp"), F.col("event_id") % 16
    text = F.coalesce(*[F.when(n == i, F.date_format(at, form)) for i, (form, _) in enumerate(_FORMS)])
    return load(spark, sf, "events").select(F.col("event_id").alias("id"), F.date_format(dt.parse_date(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query("parse_salary", f"""
    SELECT id, CASE WHEN s LIKE '$%' THEN least(a, b) * 1000 WHEN s LIKE '€%' THEN a END AS min_salary,
           CASE WHEN s LIKE '$%' THEN greatest(a, b) * 1000 WHEN s LIKE '€%' THEN a END AS max_salary,
           CASE WHEN s LIKE '$%' THEN split_part(s, 'k', 1) WHEN s LIKE '€%' THEN s END AS snippet
    FROM ({cte('jobs_raw')} SELECT id, salary_raw AS s, TRY_CAST(regexp_extract(salary_raw, '(\\d+)', 1) AS BIGINT) AS a,
       TRY_CAST(regexp_extract(salary_raw, '\\d+\\D+(\\d+)', 1) AS BIGINT) AS b FROM b_jobs_raw)""")
def parse_salary(spark, sf):
    j = bind(spark, sf, "jobs_raw").withColumn("p", tx.parse_salary("salary_raw"))
    return j.select("id", "p.min_salary", "p.max_salary", tx.salary_snippet("salary_raw").alias("snippet"))


@query("salary_snippet_text", f"""
    SELECT doc_id, coalesce({', '.join(f"nullif(regexp_extract(text, {rx.lit('(?i)' + p.replace(chr(92) + 's', '[' + chr(92) + 's]'))}, 0), '')" for p in misc.SALARY_SNIPPETS)}) AS snippet FROM documents""")
def salary_snippet_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.salary_snippet("text").alias("snippet"))


@query("jsonld_salary", """
    SELECT p_partkey AS id, CASE WHEN lo > 0 AND hi > 0 THEN cur || ' ' || format('{:,}', lo) || ' - ' || format('{:,}', hi)
        WHEN lo > 0 THEN cur || ' ' || format('{:,}', lo) || '+' WHEN hi > 0 THEN 'Up to ' || cur || ' ' || format('{:,}', hi) END AS salary
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE floor(p_retailprice * 100)::BIGINT END AS lo,
                 CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE floor(p_retailprice * 130)::BIGINT END AS hi,
                 CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS cur FROM part)""")
def jsonld_salary(spark, sf):
    p = load(spark, sf, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE cast(floor(p_retailprice * 100) AS BIGINT) END AS lo",
        "CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE cast(floor(p_retailprice * 130) AS BIGINT) END AS hi",
        "CASE WHEN p_partkey % 2 = 0 THEN 'EUR' END AS cur")
    return p.select("id", tx.jsonld_salary("cur", "lo", "hi").alias("salary"))


@query("normalize_url", """
    SELECT page_id, lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\?.*$', '')) AS url_key,
           CASE WHEN page_id % 3 = 0 THEN lower(trim(url)) ELSE lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\?.*$', '')) END AS listing_key
    FROM pages""")
def normalize_url(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url")
    return p.select("page_id", tx.normalize_url("url").alias("url_key"),
                    tx.listing_key("url", F.when(F.col("page_id") % 3 != 0, F.col("url"))).alias("listing_key"))


_HOST = "regexp_extract({u}, '^[a-z]+://([^/?#:]+)', 1)"


@query("domains", f"""
    SELECT page_id, regexp_replace(h, '^www\\.', '') AS domain, regexp_extract(h, '([^.]*\\.[^.]*)$', 1) AS base,
           CASE page_id % 3 WHEN 0 THEN regexp_replace(h, '^www\\.', '') WHEN 1 THEN NULL ELSE 'jobs.acme.io' END AS derived,
           CASE WHEN page_id % 2 = 0 THEN NULL ELSE regexp_extract(h, '([^.]*\\.[^.]*)$', 1) END AS moved_to,
           NOT contains(h, '.org') AND NOT contains(h, 'api.') AND NOT contains(h, 'static.') AND NOT contains(h, 'cdn.') AND NOT contains(h, 'docs.') AS candidate
    FROM (SELECT page_id, {_HOST.format(u='lower(url)')} AS h FROM pages)""")
def domains(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url")
    website = F.when(F.col("page_id") % 3 == 0, F.col("url"))
    careers = F.when(F.col("page_id") % 3 == 1, F.lit("https://boards.greenhouse.io/acme")).otherwise(F.lit("https://jobs.acme.io/x"))
    own = F.when(F.col("page_id") % 2 == 0, tx.host_of("url")).otherwise(F.lit("acme.dev"))
    return p.select("page_id", tx.strip_www(tx.host_of("url")).alias("domain"), tx.base_domain(tx.host_of("url")).alias("base"),
                    tx.derive_domain(website, careers).alias("derived"), tx.parent_redirect(own, "url").alias("moved_to"),
                    tx.is_candidate_domain(tx.host_of("url")).alias("candidate"))


@query("careers_urls", f"""
    SELECT id, coalesce(u <> '' AND NOT regexp_matches(u, {rx.lit('(?i)(?:' + '|'.join(boards.BAD_CAREERS_URL) + ')')}), FALSE) AS valid,
      coalesce((regexp_extract(h, '([^.]*\\.[^.]*)$', 1) = regexp_extract(d, '([^.]*\\.[^.]*)$', 1)
        OR {' OR '.join(f"h LIKE '%{s}'" for s in boards.PLATFORM_HOSTS)} OR contains(lower(u), split_part(d, '.', 1))), FALSE) AS belongs
    FROM (SELECT id, domain AS d, careers_url AS u, {_HOST.format(u='lower(careers_url)')} AS h FROM ({cte('companies')} SELECT * FROM b_companies))""")
def careers_urls(spark, sf):
    c = bind(spark, sf, "companies")
    return c.select("id", tx.is_valid_careers_url("careers_url").alias("valid"),
                    F.coalesce(tx.url_belongs_to("careers_url", "domain"), F.lit(False)).alias("belongs"))


@query("domains_match", f"""
    SELECT id, coalesce(a = b OR suffix(a, '.' || b) OR suffix(b, '.' || a)
        OR (split_part(a, '.', 1) = split_part(b, '.', 1) AND length(split_part(a, '.', 1)) > 3), FALSE) AS same
    FROM (SELECT id, replace(lower(domain), 'www.', '') AS a, replace(CASE id % 4 WHEN 0 THEN 'WWW.customer' || id || '.com' WHEN 1 THEN 'jobs.' || domain
          WHEN 2 THEN 'customer' || id || '.dev' ELSE 'other' || id || '.com' END, 'WWW.', '') AS b FROM ({cte('companies')} SELECT * FROM b_companies))""")
def domains_match(spark, sf):
    other = F.expr("""CASE id % 4 WHEN 0 THEN concat('WWW.customer', id, '.com') WHEN 1 THEN concat('jobs.', domain)
                      WHEN 2 THEN concat('customer', id, '.dev') ELSE concat('other', id, '.com') END""")
    return bind(spark, sf, "companies").select("id", tx.domains_match("domain", other).alias("same"))


@query("company_names", f"""
    SELECT id, array_to_string(list_sort(list_distinct(list_filter([lower(split_part(domain, '.', 1)),
        array_to_string(w, ''), array_to_string(w, '-'), w[1]], lambda x: x IS NOT NULL AND x <> ''))), '|') AS slugs,
      regexp_replace(regexp_replace(lower(name), {rx.lit(misc.COMPANY_SUFFIX)}, ''), '[^\\w\\s]', '', 'g') AS norm,
      regexp_replace(regexp_replace(regexp_replace(lower(name), {rx.lit(misc.SLUG_SUFFIX)}, ''), '\\s+', '', 'g'), '[^\\w-]', '', 'g') AS slug,
      upper(split_part(domain, '.', 1)[1]) || split_part(domain, '.', 1)[2:] AS parent
    FROM (SELECT id, name, domain, string_split_regex(trim(regexp_replace(lower(name), '[^a-zA-Z0-9\\s-]', '', 'g')), '\\s+') AS w
          FROM ({cte('companies')} SELECT * FROM b_companies))""")
def company_names(spark, sf):
    return bind(spark, sf, "companies").select(
        "id", F.array_join(F.array_sort(tx.company_slugs("name", "domain")), "|").alias("slugs"),
        tx.norm_company("name").alias("norm"), tx.company_slug("name").alias("slug"),
        tx.parent_name("domain").alias("parent"))


_STOPS = ", ".join(rx.lit(w) for w in misc.STOP_WORDS)


@query("sig_words", f"""
    SELECT doc_id, len(w) AS words, md5(array_to_string(w, ' ')) AS digest FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN_]+'),
             lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND x NOT IN ({_STOPS})) AS w FROM documents)""")
def sig_words(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", tx.sig_words("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


# references as texts show them, and what a browser makes of them; written by hand
_REFERENCES = [("It&#8217;s", "It’s"), ("&eacute;t&eacute;", "été"), ("&euro;5", "€5"), ("&reg;", "®"), ("&#x2019;", "’"), ("&#X20ac", "€"),
               ("&amp;lt;b&amp;gt;", "&lt;b&gt;"), ("&copy 2", "© 2"), ("&notit;", "¬it;"), ("&nosuch;", "&nosuch;"), ("&#150;", "–"),
               ("&#0;&#xD800;", "\ufffd\ufffd"), ("a & b &", "a & b &"), ("&NotEqualTilde;", "\u2242\u0338"), ("&nbsp;x", "\u00a0x"), ("&#128512;", "\U0001f600")]


@query("html_to_text", f"""
    SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(
      replace(replace(replace(regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')
        || ' ' || ([{', '.join(rx.lit(v) for _, v in _REFERENCES)}])[1 + page_id % {len(_REFERENCES)}] || ' end', '\\"', '"'), '\\n', ' '), '\\t', ' '), '<[^>]+>', ' ', 'g'),
      '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')) AS t FROM pages)""")
def html_to_text(spark, sf):
    shown = F.get(F.array(*[F.lit(t) for t, _ in _REFERENCES]), (F.col("page_id") % len(_REFERENCES)).cast("int"))
    p = load(spark, sf, "pages").select("page_id", tx.html_to_text(F.concat("html", F.lit(" "), shown, F.lit(" end"))).alias("t"))
    return p.select("page_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query("content_hash", "SELECT page_id, sha256(html) AS digest FROM pages")
def content_hash(spark, sf):
    return load(spark, sf, "pages").select("page_id", tx.content_hash("html").alias("digest"))


@query("truncate_text", """
    SELECT doc_id, CASE WHEN length(t) > 500 THEN t[1:497] || '...' ELSE t END AS cut
    FROM (SELECT doc_id, trim(regexp_replace(text, '<[^>]+>', '', 'g')) AS t FROM documents)""")
def truncate_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.truncate("text", 500).alias("cut"))


@query("clean_text", """
    SELECT doc_id, nullif(trim(regexp_replace(text, '[\\s\\x0b\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')), '') AS cleaned FROM documents""")
def clean_text(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


@query("board_urls", f"""
    SELECT id, CASE ats_type {' '.join(f"WHEN '{k}' THEN replace('{v}', '%s', i)" for k, v in boards.BOARD_URLS.items())} ELSE 'https://' || i END AS board_url,
           coalesce(CASE ats_type {' '.join(f"WHEN '{k}' THEN replace('{v}', '%s', i)" for k, v in boards.API_URLS.items())} END, careers_url) AS fetch_url
    FROM (SELECT id, ats_type, careers_url, ats_identifier AS i FROM ({cte('companies')} SELECT * FROM b_companies))""")
def board_urls(spark, sf):
    return bind(spark, sf, "companies").select(
        "id", tx.board_url("ats_type", "ats_identifier").alias("board_url"),
        tx.api_url("ats_type", "ats_identifier", "careers_url").alias("fetch_url"))


@query("provider_job_ids", f"""
    SELECT id, CASE id % 4 WHEN 0 THEN id::VARCHAR WHEN 1 THEN lower(to_hex(id)) || '-ab' WHEN 2 THEN 'C' || id::VARCHAR END AS job_id
    FROM ({cte('jobs')} SELECT id FROM b_jobs)""")
def provider_job_ids(spark, sf):
    kind = F.expr("CASE id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'ashby' WHEN 2 THEN 'workable' ELSE 'lever' END")
    url = F.expr("""CASE id % 4 WHEN 0 THEN CASE WHEN id % 8 = 0 THEN concat('https://x.com/careers/9?gh_jid=', id) ELSE source_url END
        WHEN 1 THEN concat('https://jobs.ashbyhq.com/acme/', lower(hex(id)), '-ab') WHEN 2 THEN concat('https://apply.workable.com/acme/j/C', id, '/') ELSE source_url END""")
    return bind(spark, sf, "jobs").select("id", tx.provider_job_id(kind, url).alias("job_id"))


@query("resolve_urls", """
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN split_part(url, ':', 1) || '://cdn.example.net/x' WHEN 1 THEN o || '/jobs/1'
        WHEN 2 THEN 'https://other.example/y' ELSE o || '/apply.html' END AS link
    FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o FROM pages)""")
def resolve_urls(spark, sf):
    href = F.expr("CASE page_id % 4 WHEN 0 THEN '//cdn.example.net/x' WHEN 1 THEN '/jobs/1' WHEN 2 THEN 'https://other.example/y' ELSE 'apply.html' END")
    return load(spark, sf, "pages").select("page_id", tx.resolve_url("url", href).alias("link"))


@query("name_from_slug", """
    SELECT page_id, array_to_string(list_transform(string_split(replace(s, '-', ' '), ' '), lambda w: upper(w[1]) || w[2:]), ' ') || ' Web3Foo''S' AS name
    FROM (SELECT page_id, regexp_extract(url, '://([^./]+)', 1) || '-board' AS s FROM pages)""")
def name_from_slug(spark, sf):
    slug = F.concat(F.regexp_extract("url", "://([^./]+)", 1), F.lit("-board_web3foo's"))
    return load(spark, sf, "pages").select("page_id", tx.name_from_slug(slug).alias("name"))


@query("identifiers", f"""
    SELECT id, coalesce(i = '' OR regexp_matches(i, {rx.lit('(?i)(?:' + '|'.join(misc.BAD_IDENTIFIER) + ')')}) OR length(i) > 100 OR i IN ('null', 'undefined', 'The'), TRUE) AS invalid
    FROM (SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'acme' WHEN 1 THEN '${{ORG}}' WHEN 2 THEN 'null' WHEN 3 THEN repeat('x', 99 + (c_custkey % 4)::INT)
          WHEN 4 THEN NULL ELSE 'a<b>c' END AS i FROM customer)""")
def identifiers(spark, sf):
    i = F.expr("""CASE c_custkey % 6 WHEN 0 THEN 'acme' WHEN 1 THEN concat('$', '{ORG}') WHEN 2 THEN 'null'
                  WHEN 3 THEN repeat('x', cast(99 + c_custkey % 4 AS INT)) WHEN 4 THEN NULL ELSE 'a<b>c' END""")
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), tx.is_invalid_identifier(i).alias("invalid"))


@query("company_like", f"""
    SELECT doc_id, NOT ({rx.contains_any('lower(text)', misc.ORG_EDU_WORDS + misc.ORG_SKIP_WORDS)}) AS company FROM documents""")
def company_like(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.is_company_like(F.lit("Acme"), "text", F.lit("https://acme.com")).alias("company"))


@query("job_titles", f"""
    SELECT id, coalesce(length(t) > 5 AND NOT regexp_matches(lower(trim(t)), {rx.lit('(?:' + '|'.join(misc.NAVIGATION_TEXT) + ')')}), FALSE) AS is_title
    FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'View all jobs' WHEN 1 THEN 'Careers' WHEN 2 THEN 'Dev' ELSE title END AS t FROM ({cte('jobs')} SELECT id, title FROM b_jobs))""")
def job_titles(spark, sf):
    t = F.expr("CASE id % 5 WHEN 0 THEN 'View all jobs' WHEN 1 THEN 'Careers' WHEN 2 THEN 'Dev' ELSE title END")
    return bind(spark, sf, "jobs").select("id", tx.is_job_title(t).alias("is_title"))


@query("join_location", """
    SELECT c_custkey AS id, coalesce(nullif(array_to_string(list_filter([CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'City' || c_nationkey END,
        CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'ST' END, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE n_name END], lambda x: x IS NOT NULL), ', '), ''), 'Anywhere') AS place
    FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def join_location(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    city = F.expr("CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('City', c_nationkey) END")
    state = F.expr("CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'ST' END")
    land = F.expr("CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE n_name END")
    return load(spark, sf, "customer").join(n, "c_nationkey").select(
        F.col("c_custkey").alias("id"), tx.join_location(city, state, land, F.lit("Anywhere")).alias("place"))


@query("safe_ratios", """
    SELECT o_custkey AS id, CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') > 0
        THEN round(count(*) / count(*) FILTER (WHERE o_orderstatus = 'F'), 3) ELSE 0.0 END AS ratio FROM orders GROUP BY 1""")
def safe_ratios(spark, sf):
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        tx.safe_ratio(F.count("*"), F.count_if(F.col("o_orderstatus") == "F"), 3).alias("ratio"))


@query("score_bands", """
    SELECT l_linenumber::BIGINT AS line, CASE WHEN s >= 0.9 THEN 'Excellent match' WHEN s >= 0.8 THEN 'Strong match' WHEN s >= 0.7 THEN 'Good match'
        WHEN s >= 0.6 THEN 'Moderate match' ELSE 'Potential match' END AS band, count(*) AS n
    FROM (SELECT l_linenumber, l_quantity / 50 AS s FROM lineitem) GROUP BY 1, 2""")
def score_bands(spark, sf):
    return load(spark, sf, "lineitem").groupBy(
        F.col("l_linenumber").cast("bigint").alias("line"), sc.score_band(F.col("l_quantity") / 50).alias("band")).agg(F.count("*").alias("n"))
