"""Readers with declared schemas for cached listings: JSON works, XML records, CSV pages, HTML indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import html_text_column, rebuild

WORKS = "id string, doi string, title string, publication_year int, abstract_inverted_index map<string,array<int>>"
PAPERS = "id string, title string, abstract string, authors array<string>, keywords array<string>, venue string, year int, track string, status string, presentation string"


def read_records(spark: SparkSession, path: str, schema: str = PAPERS) -> DataFrame:
    """Snapshot records from JSON lines; the schema is declared, never inferred."""
    return spark.read.schema(schema).json(path)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Works with inverted-index abstracts, rebuilt to text; bare lower-case DOIs."""
    works = spark.read.schema(WORKS).json(path)
    return works.select("id", F.regexp_replace(F.lower("doi"), r"^https?://(dx\.)?doi\.org/", "").alias("doi"), "title", F.col("publication_year").alias("year"), rebuild(F.col("abstract_inverted_index")).alias("abstract"))


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Records of a large XML release, split by row tag."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def listing(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(page columns, href, label): every link of an index page with its text."""
    links = F.regexp_extract_all(html_col, F.lit(r"(?is)<a\s[^>]*href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(0))
    each = pages.select(*[c for c in pages.columns if c != html_col], F.explode(links).alias("a"))
    return each.withColumn("href", F.regexp_extract("a", r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)).withColumn("label", html_text_column(F.col("a"))).drop("a")


def page_track(pages: DataFrame, ranges: DataFrame, page_col: str = "page") -> DataFrame:
    """Range join: the track of the (lo, hi) page range that holds a start page; ranges is a small table."""
    on = (F.col(page_col) >= F.col("lo")) & (F.col(page_col) <= F.col("hi"))
    return pages.join(F.broadcast(ranges.select("lo", "hi", F.col("track").alias("range_track"))) if ranges.count() <= 10_000 else ranges, on, "left")
