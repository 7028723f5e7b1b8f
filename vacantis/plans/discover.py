"""Discovery: routing of found companies, the review queue, bulk loads and sign-ups
(P6–P8, S11–S13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import classify as cl, text as tx
from ..functions.core import nz, spread_nulls, ts
from ..operators.joins import fill_missing
from ..operators.sets import known_domains
from ..operators.upserts import upsert
from ..operators.windows import dedup_first

NEW_COMPANY_PRIORITY = 30   # fixed value: crawl priority of discovered companies
MAX_RETRIES = 3             # fixed value: queue retries before giving up


def _text(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df


def route(found: DataFrame, companies: DataFrame, queue: DataFrame, us_only: bool = True) -> DataFrame:
    """Every found row with its domain and outcome.

    ``found`` carries ``row_id``, ``source_rank`` and ``discovered_at``, which
    fix the order.  A domain counts as seen from its first row on, even if that
    row fails the US gate, so later copies are duplicates.  The first row of a
    domain is found by aggregation and marked back by row id: a domain that
    holds a third of all rows is never gathered in one task.
    """
    f = _text(found, "domain", "careers_url", "website_url", "country", "location", "ats_type", "source")
    f = f.withColumn("domain", F.coalesce(F.lower(nz("domain")), tx.derive_domain("website_url", "careers_url")))
    order = F.struct("source_rank", "discovered_at", "row_id")
    firsts = (f.filter(F.col("domain").isNotNull()).groupBy("domain")
              .agg(F.min_by("row_id", order).alias("row_id")))
    known = known_domains(companies, queue)
    fresh = firsts.join(known, "domain", "left_anti").select("row_id", F.lit(True).alias("__first"))
    f = f.join(fresh, "row_id", "left")
    seen = F.col("domain").isNotNull() & F.col("__first").isNull()
    gate = cl.us_gate("country", "location", "careers_url", "ats_type", "source") if us_only else F.lit(True)
    outcome = (F.when(seen, F.lit("duplicate")).when(~gate, F.lit("non_us"))
               .when(F.col("domain").isNotNull() & nz("careers_url").isNotNull(), F.lit("new"))
               .when(nz("careers_url").isNull(), F.lit("queued")).otherwise(F.lit("duplicate")))
    return f.withColumn("outcome", outcome).drop("__first")


def discover(found: DataFrame, companies: DataFrame, queue: DataFrame, as_of,
             us_only: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New companies, new queue entries, and the outcome of every row."""
    routed = route(found, companies, queue, us_only)
    home = F.coalesce(F.col("country"), F.lit("US" if us_only else None))
    new = (routed.filter(F.col("outcome") == "new")
           .withColumn("website_url", F.coalesce(nz("website_url"), F.concat(F.lit("https://"), "domain")))
           .withColumn("country", home).withColumn("discovery_source", F.col("source"))
           .withColumn("discovered_at", ts(as_of)).withColumn("is_active", F.lit(True))
           .withColumn("crawl_priority", F.lit(NEW_COMPANY_PRIORITY)))
    queued = (routed.filter(F.col("outcome") == "queued").withColumn("country", home)
              .withColumn("status", F.lit("pending")).withColumn("created_at", ts(as_of)))
    return new, queued, routed


def detect_for_queue(items: DataFrame, fetches: DataFrame | None) -> DataFrame:
    """Platform of a queue item from its careers address, else from the fetched page."""
    i = items.withColumn("__a", cl.ats_from_url("careers_url"))
    if fetches is None:
        return i.withColumn("found_type", F.col("__a.ats_type")).withColumn(
            "found_identifier", F.col("__a.ats_identifier")).drop("__a")
    page = (fetches.filter(F.col("status") == 200)
            .withColumn("__t", cl.ats_from_html("html"))
            .groupBy(F.col("url").alias("careers_url"))
            .agg(F.max_by(F.struct("__t", cl.ats_identifier("html", "__t").alias("__i")), "fetched_at").alias("__p")))
    i = i.join(page, "careers_url", "left")
    by_url = F.col("__a.ats_type").isNotNull()
    return (i.withColumn("found_type", F.coalesce("__a.ats_type", "__p.__t"))
            .withColumn("found_identifier", F.when(by_url, F.col("__a.ats_identifier")).otherwise(F.col("__p.__i")))
            .drop("__a", "__p"))


def process_queue(queue: DataFrame, companies: DataFrame, fetches: DataFrame | None, as_of) -> DataFrame:
    """Outcome of every pending item.

    ``updated`` when the domain is a company already (or an earlier item of
    this run creates it), ``created`` when there is a domain or a careers
    page, else ``review``.
    """
    items = detect_for_queue(_text(queue.filter(F.col("status") == "pending"), "website_url", "description"), fetches)
    known = companies.filter(F.col("domain").isNotNull()).groupBy("domain").agg(F.min("id").alias("company_id"))
    first = (items.filter(F.col("domain").isNotNull()).groupBy("domain")
             .agg(F.min_by("id", F.struct("created_at", "id")).alias("__creator")))
    owner = first.join(known, "domain", "left").select("domain", "__creator", "company_id")
    i = (items.drop("company_id").withColumn("__key", spread_nulls("domain", "id"))
         .join(owner.withColumnRenamed("domain", "__key"), "__key", "left").drop("__key"))
    outcome = (F.when(F.col("company_id").isNotNull(), F.lit("updated"))
               .when(F.col("domain").isNotNull(), F.when(F.col("id") == F.col("__creator"), F.lit("created")).otherwise(F.lit("updated")))
               .when(nz("careers_url").isNotNull(), F.lit("created")).otherwise(F.lit("review")))
    key = F.sha2(F.concat_ws("|", F.coalesce("domain", F.lit("")), F.when(F.col("domain").isNull(), F.col("careers_url"))), 256)
    return (i.withColumn("outcome", outcome)
            .withColumn("status", F.when(F.col("outcome") == "review", F.lit("review")).otherwise(F.lit("completed")))
            .withColumn("error_message", F.when(F.col("outcome") == "review", F.lit("Could not find careers page automatically")))
            .withColumn("new_company_key", F.when(F.col("company_id").isNull() & (F.col("outcome") != "review"), key))
            .withColumn("processed_at", ts(as_of)).drop("__creator"))


def apply_queue(queue: DataFrame, companies: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queue and company tables after :func:`process_queue`.

    Items of one company are folded first (the earliest value wins), then only
    missing fields of the company are filled.
    """
    q = upsert(queue, outcomes, ["id"], [c for c in ("status", "error_message", "processed_at") if c in queue.columns])
    order = F.struct("created_at", "id")
    folded = (outcomes.filter(F.col("company_id").isNotNull()).groupBy("company_id")
              .agg(F.min_by("careers_url", F.when(nz("careers_url").isNotNull(), order)).alias("careers_url"),
                   F.min_by(F.struct("found_type", "found_identifier"), F.when(F.col("found_type").isNotNull(), order)).alias("p"))
              .select(F.col("company_id").alias("id"), "careers_url", F.col("p.found_type").alias("ats_type"),
                      F.col("p.found_identifier").alias("ats_identifier")))
    # the identifier belongs to its type: it is taken only together with it
    had = companies.select("id", nz("ats_type").isNotNull().alias("__had"))
    folded = folded.join(had, "id").withColumn("ats_identifier", F.when(~F.col("__had"), F.col("ats_identifier"))).drop("__had")
    c = fill_missing(companies, folded, "id", [x for x in ("careers_url", "ats_type", "ats_identifier") if x in companies.columns])
    return q, c


def fail_items(queue: DataFrame, failures: DataFrame, as_of) -> DataFrame:
    """Failed items wait again until their third retry is used up.

    ``failures(id, error)``; decided from the counter before the failure.
    """
    f = failures.select("id", F.col("error").alias("__error"))
    out = queue.join(f, "id", "left")
    hit = F.col("__error").isNotNull()
    changes = {"status": F.when(F.col("retry_count") >= MAX_RETRIES, F.lit("failed")).otherwise(F.lit("pending")),
               "retry_count": F.col("retry_count") + 1, "error_message": F.col("__error"), "processed_at": ts(as_of)}
    return out.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
                        for c in queue.columns])


def apply_reviews(queue: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decisions(id, decision, careers_url, reason)``.

    Approval needs an item in review and sends it back to pending with the
    given address; rejection skips an item in any state.
    """
    d = decisions.select("id", F.col("decision").alias("__d"), F.col("careers_url").alias("__u"), F.col("reason").alias("__r"))
    out = queue.join(d, "id", "left")
    yes = F.coalesce((F.col("__d") == "approve") & (F.col("status") == "review"), F.lit(False))
    no = F.coalesce(F.col("__d") == "reject", F.lit(False))
    new = {"status": F.when(yes, F.lit("pending")).when(no, F.lit("skipped")).otherwise(F.col("status")),
           "careers_url": F.when(yes, F.col("__u")).otherwise(F.col("careers_url"))}
    if "error_message" in queue.columns:
        new["error_message"] = (F.when(yes, F.lit(None)).when(no, F.coalesce(nz("__r"), F.lit("Manually rejected")))
                                .otherwise(F.col("error_message")))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in queue.columns])


def bulk_load(companies: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Companies plus the rows with a new domain, and the counts of both kinds.

    Repeats inside the load keep their first row (by name).
    """
    rows = rows.withColumn("__id", F.struct("name", "domain"))
    unique = dedup_first(rows, F.col("domain"), ["__id"]).drop("__id")
    known = companies.filter(F.col("domain").isNotNull()).select(F.lower("domain").alias("__known"))
    new = unique.join(known, F.lower("domain") == F.col("__known"), "left_anti")
    made = new.agg(F.count("*")).scalar()
    counts = rows.agg(F.count("*").alias("total")).withColumn("created", made).withColumn(
        "skipped", F.col("total") - F.col("created"))
    return companies.unionByName(new, allowMissingColumns=True), counts


def seed_companies(companies: DataFrame, seed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Seed rows are created, update a changed platform or address, or are skipped."""
    t = companies.select("domain", F.col("ats_type").alias("__t"), F.col("ats_identifier").alias("__i"),
                         F.col("careers_url").alias("__u"), F.lit(True).alias("__known"))
    s = seed.join(t, "domain", "left")
    changed = ~(F.col("ats_type").eqNullSafe(F.col("__t")) & F.col("ats_identifier").eqNullSafe(F.col("__i"))
                & F.col("careers_url").eqNullSafe(F.col("__u")))
    outcome = F.when(F.col("__known").isNull(), F.lit("created")).when(changed, F.lit("updated")).otherwise(F.lit("skipped"))
    s = s.withColumn("outcome", outcome)
    after = upsert(companies, s.select(*seed.columns), ["domain"],
                   [c for c in ("ats_type", "ats_identifier", "careers_url") if c in companies.columns])
    return after, s.groupBy("outcome").agg(F.count("*").alias("count"))


def sync_candidates(candidates: DataFrame, waitlist: DataFrame, details: DataFrame, as_of) -> DataFrame:
    """Sign-up details become candidate profiles, keyed by waitlist id."""
    d = details.select(
        "waitlist_id", F.when(nz("field").isNotNull(), F.array(cl.field_family("field"))).alias("role_families"),
        "seniority", F.col("expected_pay").alias("min_salary"),
        F.when(nz("country").isNotNull(), F.array("country")).alias("locations"),
        F.col("work_type").alias("location_types"), F.col("role_type").alias("role_types"))
    u = (waitlist.select(F.col("id").alias("waitlist_id"), "name", "email").join(d, "waitlist_id")
         .withColumn("id", F.sha2(F.col("waitlist_id").cast("string"), 256))
         .withColumn("is_active", F.lit(True)).withColumn("updated_at", ts(as_of)).withColumn("created_at", ts(as_of)))
    sets = ["name", "role_families", "seniority", "min_salary", "locations", "location_types", "role_types", "updated_at"]
    return upsert(candidates, u, ["waitlist_id"], [c for c in sets if c in candidates.columns])
