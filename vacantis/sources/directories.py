"""Company lists of other sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as cl, text as tx
from ..functions.core import CI, contains_any, extract, nz
from ..functions.payload import jarray, jget, jlist, jpath, jtext
from ..operators.extract import board_links, embedded_state
from ..rules import boards, locations as loc, misc, providers as pr


def read_directory(docs: DataFrame, status: str | None = "Active", batch: str | None = None) -> DataFrame:
    """Start-up directory records.  ``docs(url, body)``.

    JSON bodies list companies under the page state, ``companies`` or the
    root; other bodies give the names of their company links.
    """
    v = F.try_parse_json("body")
    c = docs.select("url", "body", jarray(v, "props.pageProps.companies", "companies", "$").alias("list"))
    x = c.filter(F.col("list").isNotNull()).select("url", F.explode("list").alias("v"))
    v = F.col("v")
    rows = x.select(
        jtext(v, "name").alias("name"), jget(v, "website", "url").alias("website_url"), F.col("url").alias("source_url"),
        jget(v, "location", "city").alias("location"), jget(v, "one_liner", "description").alias("description"),
        F.coalesce(jtext(v, "industry"), nz(F.array_join(F.transform(jlist(v, "tags"), lambda t: jtext(t, "$")), ", "))).alias("industry"),
        F.try_variant_get(v, "$.team_size", "int").alias("employee_count"), jtext(v, "batch").alias("funding_stage"),
        F.coalesce(jtext(v, "status"), F.lit("Active")).alias("__status"))
    rows = rows.filter(F.col("name").isNotNull())
    if status is not None:
        rows = rows.filter(F.col("__status") == status)
    if batch is not None:
        rows = rows.filter(F.coalesce("funding_stage", F.lit("")).contains(batch))
    rows = rows.withColumn("country", F.when(contains_any(F.col("location"), pr.DIRECTORY_US_MARKS), F.lit("US"))).drop("__status")
    slugs = F.regexp_extract_all("body", F.lit(pr.DIRECTORY_LINK), F.lit(1))
    names = F.regexp_extract_all("body", F.lit(pr.DIRECTORY_LINK), F.lit(2))
    links = (c.filter(F.col("list").isNull()).select("url", F.explode(F.arrays_zip(slugs.alias("slug"), names.alias("name"))).alias("m"))
             .select(F.trim("m.name").alias("name"), F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.lit("/companies/"), "m.slug").alias("source_url"))
             .filter((F.length("name") >= 2) & ~F.lower("name").isin(pr.DIRECTORY_SKIP)))
    return rows.unionByName(links, allowMissingColumns=True).withColumn("source", F.lit("yc_directory"))


def read_orgs(docs: DataFrame, min_repos: int = 3) -> DataFrame:
    """Code-host organisations with a website that look like companies.  ``docs(body)``."""
    v = F.try_parse_json("body")
    site = jtext(v, "blog")
    o = docs.select(
        F.coalesce(jtext(v, "name"), jtext(v, "login")).alias("name"),
        F.when(site.startswith("http"), site).otherwise(F.concat(F.lit("https://"), site)).alias("website_url"),
        jtext(v, "description").alias("description"), jtext(v, "location").alias("location"),
        F.coalesce(jtext(v, "html_url"), F.concat(F.lit("https://github.com/"), jtext(v, "login"))).alias("source_url"),
        F.try_variant_get(v, "$.public_members_count", "int").alias("employee_count"),
        F.coalesce(F.try_variant_get(v, "$.public_repos", "int"), F.lit(0)).alias("__repos"))
    return (o.filter((F.col("__repos") >= min_repos) & F.col("website_url").isNotNull()
                     & tx.is_company_like("name", "description", "website_url"))
            .withColumn("country", F.when(contains_any(F.lower("location"), loc.ORG_US_PLACES), F.lit("US")))
            .withColumn("source", F.lit("github_orgs")).drop("__repos"))


def read_search_results(hits: DataFrame) -> DataFrame:
    """Web results as companies, without aggregators.  ``hits(link, title, snippet)``."""
    url = F.lower("link")
    host = extract(url, r"https?://(?:www\.)?([^/]+)")
    h = hits.filter(~contains_any(url, pr.SEARCH_SKIP_HOSTS)).withColumn("domain", host).filter(F.col("domain").isNotNull())
    a = cl.ats_from_url("link")
    h = h.withColumn("a", a)
    name = F.trim(F.substring_index(F.substring_index("title", " - ", 1), " | ", 1))
    careers = contains_any(url, pr.SEARCH_CAREERS_MARKS) | F.col("a.ats_type").isNotNull()
    return h.select(name.alias("name"), "domain", F.concat(F.lit("https://"), "domain").alias("website_url"),
                    F.when(careers, F.col("link")).alias("careers_url"), F.lit("google_search").alias("source"),
                    F.col("link").alias("source_url"), F.col("a.ats_type").alias("ats_type"),
                    F.col("a.ats_identifier").alias("ats_identifier"), F.col("snippet").alias("description"))


def read_aggregator_pages(pages: DataFrame) -> DataFrame:
    """Boards linked from comment and aggregator pages."""
    return board_links(pages).withColumn("source", F.lit("job_aggregators"))


def read_embedded_state(pages: DataFrame) -> DataFrame:
    """Companies in a page's embedded state that have a board.  ``pages(page_id, html)``."""
    items = jarray(embedded_state("html"), "companies.items", "props.pageProps.companies")
    x = pages.select("page_id", F.explode(items).alias("v"))
    v = F.col("v")
    careers = jget(v, "jobsUrl", "careersUrl")
    x = x.select("page_id", F.coalesce(jtext(v, "name"), F.lit("Unknown")).alias("name"), jtext(v, "website").alias("website_url"),
                 careers.alias("careers_url"), cl.ats_from_url(careers).alias("a"))
    return (x.filter(F.col("website_url").isNotNull() & F.col("a.ats_type").isNotNull())
            .select("page_id", "name", "website_url", tx.strip_www(tx.host_of("website_url")).alias("domain"), "careers_url",
                    "a.ats_type", "a.ats_identifier", F.lit("job_aggregators_workatastartup").alias("source"), F.lit("US").alias("country")))


def harvest_boards(texts: DataFrame) -> DataFrame:
    """Board names in sitemap or robots text, once each.  ``texts(body)``."""
    found = F.explode(F.regexp_extract_all("body", F.lit(pr.HARVEST_PATTERN), F.lit(1)))
    names = texts.select(found.alias("board")).select(F.lower("board").alias("board"))
    return names.filter(~F.col("board").isin(pr.HARVEST_SKIP)).distinct()
