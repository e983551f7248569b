import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def rows(n=400, seed=2):
    rng = random.Random(seed)
    sources = ["hot"] * 10 + ["a", "b", "Z", "é", None, "tiny"]
    out = []
    for i in range(n):
        s = rng.choice(sources)
        size = 2 if s == "tiny" else rng.randint(0, 80)
        out.append((i, " ".join(["w"] * size), "en", s))
    return out + [(1000, None, "en", "a"), (1001, "x y", "en", "empty"), (None, "one two three", None, "b"), (None, "one two three", None, "b"), (7, "dup dup", "en", "a"), (7, "dup dup", "en", "a")]


def test_targets_and_totals(spark, docs_of):
    data = rows()
    mixed = mixing.mix(docs_of(data), bins=16).collect()
    assert len(mixed) == len(data)
    sizes, taken, target, biggest = {}, {}, {}, {}
    for r in mixed:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        biggest[r["source"]] = max(biggest.get(r["source"], 0), r["size"])
    expected = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= max(2, biggest[s] / 2), s
    again = mixing.mix(docs_of(data[::-1]), bins=16).collect()
    key = lambda r: (str(r["id"]), str(r["source"]), r["size"], r["copies"])
    assert sorted(map(key, mixed)) == sorted(map(key, again))


def test_apply_repeats_rows(spark, docs_of):
    data = rows()
    docs = docs_of(data)
    mixed = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.apply_mix(docs)
    assert out.columns == [*docs.columns, "copy_no"]
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == mixed


def test_inclusion_follows_the_odds(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s1" if i % 2 else "s2") for i in range(2000)], "doc_id long, text string, source string")
    found = mixing.mix(docs).groupBy("source").agg(F.avg("copies").alias("r")).collect()
    assert {r["source"]: round(r["r"], 2) for r in found} == {"s1": 0.67, "s2": 1.33}


def test_empty(spark, docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert mixing.apply_mix(docs_of([])).count() == 0
    only_null = mixing.mix(docs_of([(1, None, None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only_null] == [(0, 0.0, 0)]


def test_long_documents_at_the_cut_are_passed_over(spark, docs_of):
    rng = random.Random(3)
    data = []
    for i in range(4000):
        size = 300 if i % 500 == 0 else rng.randint(1, 4)
        data.append((i, " ".join(["w"] * size), "en", "abcd"[i // 1000]))
    for seed in (1, 2, 7):
        found = mixing.mix(docs_of(data), bins=16, seed=seed).collect()
        for s in "abcd":
            mine = [r for r in found if r["source"] == s]
            assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1, (seed, s)


def brute_chances(sizes, rest):
    """min(1, factor x size) by bisection."""
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, mid * s) * s for s in sizes) < rest else (low, mid)
    return [min(1, high * s) for s in sizes]


def test_inclusion_follows_each_documents_probability(spark):
    """Many sources with the same sizes are so many draws: each size comes as often as its probability says."""
    sizes = ([1] * 8 + [2] * 4 + [3, 3, 4, 4, 12]) * 25
    rows = [(1000 * s + i, " ".join(["w"] * n), f"{s:05d}") for s in range(60) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, weights=(1, 3)).groupBy("size", (F.col("source").cast("int") % 2).alias("odd")).agg(F.avg("copies").alias("r")).collect()
    expected = dict(zip(sizes, brute_chances(sizes, sum(sizes) / 2)))
    assert expected[12] == 1 and expected[1] < 0.13
    for r in found:  # half of a source's words, and one and a half
        assert r["r"] - r["odd"] == pytest.approx(expected[r["size"]], abs=0.03), (r["odd"], r["size"])


def test_clashing_counter(spark, docs_of):
    docs = docs_of([(1, "a b", "en", "s")]).withColumn("Copy_No", F.lit(9))
    assert [(r["Copy_No"], r["copy_no_1"]) for r in mixing.apply_mix(docs).collect()] == [(9, 1)]
