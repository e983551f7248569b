"""A cache of fetched pages as a table: content-addressed, append-only, read by url; nothing here fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "url string, status int, fetched_at timestamp, sha256 string, body string"


def add(pages: DataFrame, path: str) -> None:
    """Append fetched pages (url, status, fetched_at, body) to the cache, each with the digest of its body."""
    body = F.coalesce("body", F.lit(""))
    pages.select("url", F.col("status").cast("int").alias("status"), "fetched_at", F.sha2(body, 256).alias("sha256"), body.alias("body")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def lookup(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, status, fetched_at, body): the newest answer of each url, good answers before others; urls without one are left out.

    An entry whose body is not what its digest says is no answer.
    """
    sound = cache.where(F.sha2("body", 256) == F.col("sha256")).join(urls.select("url").distinct(), "url", "left_semi")
    order = Window.partitionBy("url").orderBy((F.col("status") != 200), F.desc("fetched_at"), "sha256")
    return sound.withColumn("n", F.row_number().over(order)).where("n = 1").select("url", "status", "fetched_at", "body")


def misses(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """(url): what a crawl would have to fetch."""
    return urls.select("url").distinct().join(lookup(urls, cache).where("status = 200"), "url", "left_anti")
