"""Typed tables, landing files and report output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as tx
from ..functions.core import nz
from ..schemas import TABLES


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A product table with its declared schema (missing columns are null)."""
    return spark.read.schema(TABLES[name]).parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int,
              properties: dict | None = None) -> DataFrame:
    """The same table in a database, read in parallel key ranges."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts,
                           properties=properties or {})


def write_version(df: DataFrame, root: str, version: str, *partitions: str) -> str:
    """Write a new version folder; readers switch to it after the write."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").partitionBy(*partitions).parquet(path)
    return path


def fetch_list(companies: DataFrame) -> DataFrame:
    """The address a fetcher has to read for each company."""
    return companies.filter(F.col("is_active") & F.col("careers_url").isNotNull()).select(
        F.col("id").alias("company_id"), "ats_type", "ats_identifier",
        tx.api_url("ats_type", "ats_identifier", "careers_url").alias("url"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Fetched board documents."""
    return read_table(spark, "payloads", path)


def write_payload_files(docs: DataFrame, path: str) -> None:
    """``docs(ats_type, ats_identifier, value)`` as one file per board; boards are dealt to as many tasks as a shuffle has."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, since the rows are few bytes and the files many
    docs.repartition(tasks, "ats_type", "ats_identifier").write.partitionBy("ats_type", "ats_identifier").text(path)


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file under ``ats_type=…/ats_identifier=…``."""
    return (spark.read.text(path, wholetext=True)
            .select("ats_type", "ats_identifier", F.col("ats_identifier").alias("company_id"),
                    F.col("_metadata.file_path").alias("url"), F.col("value").alias("body")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S3: page snapshots."""
    return read_table(spark, "pages", path)


def read_feed_items(spark: SparkSession, path: str, feed_name: str, row_tag: str = "item") -> DataFrame:
    """RSS ``item`` or Atom ``entry`` elements, with the description fallbacks."""
    fields = ["title string", "description string", "link array<struct<_VALUE string, _href string, _rel string>>", "pubDate string", "published string",
              "`content:encoded` string", "content string", "summary string"]
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(", ".join(fields)).load(path)
    # RSS has the address as text, Atom as an attribute of the link that is no "self", "enclosure", …
    plain = F.try_element_at(F.filter(F.transform("link", lambda x: nz(F.trim(x["_VALUE"]))), lambda t: t.isNotNull()), F.lit(1))
    pages = F.filter("link", lambda x: nz(x["_href"]).isNotNull() & (F.coalesce(nz(x["_rel"]), F.lit("alternate")) == "alternate"))
    link = F.coalesce(plain, F.trim(F.try_element_at(pages, F.lit(1))["_href"]))
    return raw.select(
        nz(F.trim("title")).alias("title"),
        F.coalesce(nz(F.trim("description")), nz(F.trim("`content:encoded`")), nz(F.trim("content")),
                   nz(F.trim("summary"))).alias("description"),
        link.alias("link"), F.coalesce(nz(F.trim("pubDate")), nz(F.trim("published"))).alias("pub_date"),
        F.lit(feed_name).alias("feed_name"))


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """One JSON folder with the summary and one with the failed rows."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/failures")
