"""A training-data pipeline over documents: each stage filters, rewrites or mixes what its predecessor kept.

Every stage works on all rows it is given and carries them whole, as one struct,
so that columns of any name come through (the last stage's counter is copy_no, or
copy_no_1 if that name is taken). Empty tables give empty tables with the same
columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, langid, mixing, secrets, simhash
from quarry.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; the network learns from the labelled documents outside the held-out fold.

    Null texts and texts without letters have no language and go; a null lang or id only keeps a row from training.
    Very long texts are read whole. Of equally likely languages the first by name counts; repeated rows fare alike.
    """
    return langid.keep_recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Null texts count as empty ones, which are alike; rows without an id stay. Of rows that share the smallest id the one
    whose text has the smallest hash stays, once. Very long texts count whole.
    """
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null texts have no words and stay; null ids do not matter; repeated rows fare alike, and so do documents that share
    an id, each by its own text. There are no ties: every window that occurs counts. Very long texts count whole.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark and n_chars follows the text.

    Null texts stay null, with n_chars as it was; null ids do not matter; repeated rows fare alike. Of findings that begin
    together or overlap all is covered by one mark. Very long texts are cut block by block.
    """
    clean = secrets.redact(docs)
    changed = F.when(F.col("text").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as the mix takes them, with copy_no.

    Null texts have no words and go; null sources are a source of their own; null ids are allowed. Repeated rows count one
    by one; where only some of them are taken, which ones is left open. Equal ranks go by id, then by hash of the text.
    A very long document counts with all its words, and may be passed over for shorter ones.
    """
    return mixing.apply_mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

#: The fingerprints and the draws are hashes that DuckDB lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
