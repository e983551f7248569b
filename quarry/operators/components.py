"""Connected components by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected graph; component is the smallest node reached.

    Every step is an aggregation and an equi-join on the node, so no component
    is ever gathered in one place. Self-loops and repeated edges are allowed;
    rows with a null end are ignored; no edges give no rows.
    """
    pairs = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    pairs = materialize(pairs, "edges")
    seen = _digest(pairs)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        pairs = materialize(_small_star(_large_star(pairs)), "edges", replaces=pairs)
        now = _digest(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    ordered = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = ordered.groupBy("u").agg(F.min("v").alias("m"))
    moved = ordered.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]
