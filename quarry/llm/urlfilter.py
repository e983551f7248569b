"""URL rules by a Bloom filter cascade.

Listed keys (host and path prefix, with a verdict) are looked up for every URL
without a join. Level 0 encodes the listed keys; level 1 encodes those keys of
the corpus's complete key universe that level 0 lets through wrongly; level 2
those listed keys that level 1 lets through wrongly; and so on until a level
has no false positives. A level's bits are set in executors, in chunks of 32 KB
that reach the driver as bytes. A list that needs more than ``MAX_BITS`` is not
sent to executors: it is joined by a shuffle instead. For every key of that universe the cascade then answers
exactly. The universe is every (host suffix, path prefix) of every URL, with
the prefix lengths that occur in the rules.

Defined results:
- null url, or one without "://": host and path are empty, no rule fits, the default verdict holds;
- a path that does not start with the rule's path (an empty one, say) does not fit;
- of rules that fit, the longest host+path wins, of equal lengths the longer host; a key listed as both allow and block blocks;
- very long urls: every suffix of the host and prefix of the path that a rule may have is looked up;
- repeated rows: each is returned; null ids are kept;
- empty table or no rules: empty result, or the default verdict everywhere;
- other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 12
#: Lists whose first level needs more bits than this (256 MB) are joined rather than sent to every executor.
MAX_BITS = 1 << 31
#: 64-bit words of a chunk.
CHUNK = 4096


@dataclass
class Level:
    """One Bloom filter. Its size and its first hash differ from level to level, so keys that collide in one do not in the next."""

    bits: np.ndarray
    size: int
    hashes: int
    first: int

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h1), dtype=bool)
        for i in range(self.first, self.first + self.hashes):
            at = (h1 + i * h2) % self.size
            hit &= (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit


@dataclass
class Cascade:
    levels: list[Level]

    def test(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h1), dtype=bool)
        alive = np.arange(len(h1))
        for depth, level in enumerate(self.levels):
            alive = alive[level.test(h1[alive], h2[alive])]
            listed[alive] = depth % 2 == 0
            if not len(alive):
                break
        return listed


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two hashes of 40 bits, so that their multiples stay inside a long."""
    return F.shiftrightunsigned(F.xxhash64(key), 24), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 24)


def url_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix + path prefix) of a URL, longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.left(path, F.lit(n))) for n in lengths] or [F.lit(None).cast("string")]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.char_length(F.concat(s, p)).alias("n"), F.char_length(s).alias("h"), F.concat(s, p).alias("key")))))
    ordered = F.transform(F.sort_array(keys, asc=False), lambda x: x["key"])
    return F.when(host != "", ordered).otherwise(F.array().cast("array<string>"))


def _encode(keys: DataFrame, count: int, bits_per_key: int, depth: int) -> Level:
    room = max(256, 64 * math.ceil(count * bits_per_key / 64))
    hashes = max(1, round(bits_per_key * math.log(2)))
    size, begin = room - depth % 100, depth * hashes
    h1, h2 = key_hashes(F.col("key"))
    spots = keys.select(F.explode(F.array(*[(h1 + h2 * F.lit(i)) % F.lit(size).cast("long") for i in range(begin, begin + hashes)])).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))

    def chunk(rows: pd.DataFrame) -> pd.DataFrame:  # at most CHUNK rows
        part = np.zeros(CHUNK, np.int64)
        part[rows["word"].to_numpy() % CHUNK] = rows["bits"].to_numpy()
        return pd.DataFrame({"number": [int(rows["word"].iat[0]) // CHUNK], "data": [part.tobytes()]})

    packed = words.groupBy(F.floor(F.col("word") / CHUNK)).applyInPandas(chunk, "number long, data binary")
    bits = np.zeros(-(-room // 64 // CHUNK) * CHUNK, dtype=np.uint64)
    for number, data in packed.toLocalIterator():  # at most MAX_BITS in all
        bits[number * CHUNK : (number + 1) * CHUNK] = np.frombuffer(data, np.uint64)
    return Level(bits, size, hashes, begin)


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    sent = keys.sparkSession.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(sent.value.test(h1.to_numpy(np.int64), h2.to_numpy(np.int64)))

    return keys.where(passes(*key_hashes(F.col("key"))))


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = BITS_PER_KEY, most_levels: int = 64) -> Cascade:
    """universe and listed are frames of distinct ``key``; keys of the universe are then answered exactly."""
    levels: list[Level] = []
    inside = materialize(listed.join(universe, "key", "left_semi"), "inside")
    encoded, count = inside, inside.count()
    rivals = None
    for depth in range(most_levels):
        if not count:
            break
        level = _encode(encoded, count, bits_per_key, depth)
        levels.append(level)
        if depth == 0:
            wrong = _passing(universe, level).join(listed, "key", "left_anti")
        else:
            wrong = _passing(rivals, level)
        rivals, encoded = encoded, materialize(wrong, "wrong")
        count = encoded.count()
    else:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", bits_per_key: int = BITS_PER_KEY, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) per row. rules has (host, path, verdict); verdict is allow or block."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.col("path").alias("path"), "verdict").where("host <> '' and path is not null")
    lengths = sorted((r["n"] for r in rules.select(F.char_length("path").alias("n")).distinct().collect()), reverse=True)  # lengths, not rules
    listed = rules.select(F.concat("host", "path").alias("key"), "verdict")
    split = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    longest = lengths[0] if lengths else 0
    heads = split.select("host", F.left("path", F.lit(longest)).alias("path")).distinct()
    universe = materialize(heads.select(F.explode(url_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct(), "universe")
    sides = [listed.where(F.col("verdict") == v).select("key").distinct() for v in ("block", "allow")]
    keys = url_keys(F.col("host"), F.col("path"), lengths)
    if max(side.count() for side in sides) * bits_per_key > max_bits:
        return _joined(split, keys, listed, default)
    cascades = [build_cascade(universe, side, bits_per_key) for side in sides]
    sent = pages.sparkSession.sparkContext.broadcast(cascades)

    @F.pandas_udf("int")
    def first(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """2 x the place of the first listed key, plus 1 if it blocks; -1 if none is listed."""
        sizes = np.array([len(x) for x in h1])
        out = np.full(len(h1), -1, dtype=np.int32)
        if sizes.sum():
            a, b = np.concatenate(h1.to_list()).astype(np.int64), np.concatenate(h2.to_list()).astype(np.int64)
            block, allow = (c.test(a, b) for c in sent.value)
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            hit = np.flatnonzero(block | allow)
            rows, at = np.unique(row[hit], return_index=True)
            out[rows] = 2 * place[hit[at]] + block[hit[at]]
        return pd.Series(out)

    hashed = split.withColumn("keys", keys)
    found = hashed.withColumn("at", first(F.transform("keys", lambda k: key_hashes(k)[0]), F.transform("keys", lambda k: key_hashes(k)[1])))
    rule = F.when(F.col("at") >= 0, F.get("keys", F.shiftright("at", 1)))
    verdict = F.when(F.col("at") < 0, F.lit(default)).when(F.col("at") % 2 == 1, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _joined(split: DataFrame, keys: Column, listed: DataFrame, default: str) -> DataFrame:
    """judge for lists too large to send: the keys of each distinct host and path head are joined with the list."""
    heads = split.select("host", "path").distinct().select("host", "path", F.posexplode(keys).alias("at", "key"))
    verdicts = listed.groupBy("key").agg(F.max("verdict").alias("verdict"))  # block over allow
    best = heads.join(verdicts, "key").groupBy("host", "path").agg(F.min_by(F.struct("key", "verdict"), "at").alias("best"))
    found = split.join(best, ["host", "path"], "left")
    return found.select("id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
