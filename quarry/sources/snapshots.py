"""Snapshots of records on disk: capped, sorted, hashed, with a manifest; verified when read."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import cap_length, cap_list, cap_marks_column
from quarry.operators.snapshot import content_hash, crawl_windows, snapshot_counts

#: Characters of a title and of an abstract. Entries of a list.
MAX_TITLE, MAX_ABSTRACT = 1_000, 20_000
MAX_ENTRIES, MAX_ENTRY = 5_000, 2_000
#: Characters of an identifier or link; a longer one names nothing.
MAX_NAMES = {"doi": 1_000, "url": 2_048, "forum": 2_048, "proceedings": 2_048, "pdf": 2_048}


class SnapshotMismatch(ValueError):
    """A snapshot whose records are not those that its manifest states."""


def _cut(text: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda x: cap_length(x, most))

    long = F.octet_length(text) * 18 > most
    return F.when(long, cut(F.when(long, text))).otherwise(text)


def capped(records: DataFrame) -> DataFrame:
    """records with marks, lengths and lists bounded, and ``cuts``: the fields that lost something. A record without a title is left out by ``write``."""
    out, cuts = records, []
    for name, most in (("title", MAX_TITLE), ("abstract", MAX_ABSTRACT)):
        if name in records.columns:
            held = F.octet_length(name) != F.char_length(name)
            short = _cut(F.when(held, cap_marks_column(F.when(held, F.col(name)))).otherwise(F.col(name)), most)
            out = out.withColumn(f"_{name}", short)
            cuts.append(F.when(~F.col(f"_{name}").eqNullSafe(F.col(name)), F.lit(name)))
    lists = [name for name, kind in records.dtypes if kind.startswith("array<")]
    for name in lists:
        texts = dict(records.dtypes)[name] == "array<string>"
        short = cap_list(F.col(name), MAX_ENTRIES)
        out = out.withColumn(f"_{name}", F.transform(short, lambda x: F.left(x, F.lit(MAX_ENTRY))) if texts else short)
        long = F.exists(name, lambda x: F.char_length(x) > MAX_ENTRY) if texts else F.lit(False)
        cuts.append(F.when((F.size(name) > MAX_ENTRIES) | long, F.lit(name)))
    for name, most in MAX_NAMES.items():
        if name in records.columns:
            out = out.withColumn(f"_{name}", F.when(F.char_length(name) <= most, F.col(name)))
            cuts.append(F.when(F.char_length(name) > most, F.lit(name)))
    out = out.withColumn("cuts", F.array_compact(F.array(*cuts)) if cuts else F.array().cast("array<string>"))
    return out.select(*[F.col(f"_{c}").alias(c) if f"_{c}" in out.columns else F.col(c) for c in records.columns], "cuts")


def corpus_hash(records: DataFrame) -> str:
    """sha256 over the lines "id hash" in id order; the sorted lines stream through one task."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for batch in batches:
            for line in batch.column(0).to_pylist():
                h.update(line.encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["hash"])

    lines = records.select("id", F.concat_ws(" ", "id", "content_hash").alias("line")).orderBy("id").select("line")
    found = lines.coalesce(1).mapInArrow(digest, "hash string").first()
    return found[0] if found else hashlib.sha256().hexdigest()


def write(records: DataFrame, path: str, extra: dict | None = None) -> dict:
    """Write records (with id, title, abstract, venue, year, track, status, source) as JSON lines in id order, with a manifest; the manifest.

    Ids must be unique. An existing snapshot is never overwritten.
    """
    spark = records.sparkSession
    ready = capped(records).where("title is not null and title <> ''").withColumn("content_hash", content_hash())
    twice = ready.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['id']} stands {twice[0]['n']} times")
    seen = Observation()
    ready.orderBy("id").observe(seen, F.count("*").alias("n"), F.sum(F.size("cuts")).alias("cuts")).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/records")
    kept = spark.read.schema(ready.schema).json(f"{path}/records")
    cells = [r.asDict() for r in snapshot_counts(kept).orderBy("venue", "year", "track", "status").collect()]  # a row per cell of closed values
    manifest = {"record_count": seen.get["n"], "cuts": seen.get["cuts"] or 0, "corpus_hash": corpus_hash(kept), "schema": ready.schema.json(), "counts": cells, **(extra or {})}
    if "fetched_at" in records.columns:
        manifest["crawl_dates"] = {r["source"]: [str(r["first"]), str(r["last"])] for r in crawl_windows(kept).collect()}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The records of a snapshot; verified against the manifest: their number, each record's hash, and the hash of all."""
    from pyspark.sql.types import StructType

    stated = manifest(spark, path)
    records = spark.read.schema(StructType.fromJson(json.loads(stated["schema"]))).json(f"{path}/records")
    if verify:
        row = records.agg(F.count("*").alias("n"), F.count_if(~content_hash().eqNullSafe(F.col("content_hash"))).alias("wrong")).first()
        if row["n"] != stated["record_count"] or row["wrong"] or corpus_hash(records) != stated["corpus_hash"]:
            raise SnapshotMismatch(f"{path}: {row['n']} records, {stated['record_count']} stated, {row['wrong']} with another hash")
    return records


def report(spark: SparkSession, name: str, rows: DataFrame, path: str) -> str:
    """A report sink: rows as JSON lines and as CSV with a header, under path/name; never overwritten."""
    flat = rows.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in rows.dtypes])
    rows.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(f"{path}/{name}/json")
    flat.coalesce(1).write.mode("errorifexists").option("header", True).csv(f"{path}/{name}/csv")
    return f"{path}/{name}"
