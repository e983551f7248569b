"""The registered queries of this subpackage: contract digests over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, decontamination, htmltext, langid, mixing, secrets, simhash, substrings, urlfilter, warc
from quarry.session import fresh_path, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(_table(spark, sf_dir, "embeddings"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"), fresh_path(spark, "ledger"))
    have = F.coalesce("found", F.array().cast(secrets.FOUND))
    listed = secrets.describe(F.col("found"))
    kinds = F.transform(have, lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, F.lit(r.kind).__eq__)).cast("long").alias(f"n_{r.kind}") for r in secrets.RULES]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = langid.train(langid.sample(docs))
    judged = langid.predict(docs.select("doc_id", "text"), net)
    return judged.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "judged.lang_pred", "judged.score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return judged.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archives")
    warc.write(_table(spark, sf_dir, "pages"), path)
    return warc.resolved(materialize(warc.read(spark, path), "records"))


#: The contract's rules (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_multi_index, op2_simhash, op3_warc, op4_secrets, op5_htmltext, op6_langid, op7_mixing, op8_decontamination, op9_substrings, op10_urlfilter]
    return {f.__name__: f for f in found}
