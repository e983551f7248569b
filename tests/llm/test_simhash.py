import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quarry.llm import simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    ids = [i for i, _ in rows if i is not None]
    fps = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(n=60):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 300)))) for i in range(n)]
    for i in range(n, 2 * n):  # near copies of near copies
        text = rows[rng.randrange(len(rows))][1].split()
        text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    return rows


def test_fingerprint_is_the_definition(spark):
    texts = [None, "", " \t\n", "One", "Ä b\x0bc D e", "a b c d", "x " * 5000, "é" * 3000] + [t for _, t in corpus(10)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    joined = spark.createDataFrame([("a b c d",)], "s string").select(F.xxhash64("s").alias("h")).first()["h"]
    assert joined & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_no_close_pair_shares_no_key():
    rng = np.random.default_rng(0)
    keys = simhash.block_keys()
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 4, replace=False):
            b ^= 1 << int(bit)
        assert any(all(a >> s & (1 << w) - 1 == b >> s & (1 << w) - 1 for s, w in parts) for parts in keys)


def test_components_equal_brute_force(spark, docs_of):
    rows = corpus()
    docs = docs_of([(i, t, "en", "s") for i, t in rows])
    for group_rows in (50_000, 3):  # also with every group split in chunks
        found = {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs, group_rows=group_rows).collect()}
        assert found == brute_components(rows)


def test_odd_rows(spark, docs_of):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "same text here now", "en", "a"), (3, "same text here now", "en", "a"), (None, "same text here now", "en", "a"), (4, "same text here now", "en", "a")]
    found = simhash.near_duplicates(docs_of(rows)).collect()
    assert len(found) == 6
    by = {(r["id"], r["component_id"]) for r in found}
    assert by == {(1, 1), (2, 1), (3, 3), (None, None), (4, 3)}
    kept = simhash.keep_first(docs_of(rows)).select("doc_id", "text").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 1), (False, 3), (True, 0)]
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.keep_first(docs_of([])).count() == 0
