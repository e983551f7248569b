"""Operators for preparing language-model training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column ``row`` beside key columns, so that no name of docs can clash; select("row.*") gives docs back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()])
