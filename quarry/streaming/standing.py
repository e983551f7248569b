"""Standing queries and newest-claim tracking on streams of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.compile import predicate
from quarry.operators.corpus import tokenised
from quarry.plans.parse import parse


def standing_query(records: DataFrame, q: str, vocabulary=None) -> DataFrame:
    """The records of a stream that match q: the batch predicate, stateless, so it appends."""
    found = parse(q, vocabulary=vocabulary)
    if not found.ok:
        raise ValueError("; ".join(d.message for d in found.errors))
    matched = tokenised(records).where(predicate(found.effective))
    return matched.select(*records.columns)


def fresh_claims(claims: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream of claims without repeats of one (record, field, source, value) inside the watermark."""
    return claims.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["record_id", "field", "source", "value"])


def claim_rates(claims: DataFrame, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Claims per source and time window; late ones count until the watermark passes."""
    grouped = claims.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", window), "source")
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "source", "n")
