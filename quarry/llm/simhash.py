"""SimHash near-duplicate groups with pigeonhole blocks.

Each text becomes a 64-bit fingerprint. The 64 bits are cut into six blocks;
two fingerprints that differ in at most four bits agree on at least two whole
blocks, so joining on every pair of blocks (15 keys of about 21 bits) misses
no link. Inside a block group the Hamming distances are verified, and only
links of a spanning forest leave the group, never all its pairs.

Defined results:
- null or word-less text: fingerprint zero, linked like any other;
- null id: the row keeps its fingerprint, takes no part in linking and has a null component;
- very long texts: every shingle counts, in time proportional to the text;
- ties: a bit set in exactly half the hashes is 0; the smallest id names a component, and of equal ids in ``keep_first`` the smallest hash of the text stays;
- repeated rows: each is returned, with the same fingerprint and component;
- empty table: empty result;
- other columns of the input are not read, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import carried
from quarry.operators.components import connected_components
from quarry.session import materialize

SEED = 42
BITS = 64
MAX_DISTANCE = 4
BLOCKS = 6
#: Fingerprints of one block group that one task verifies; larger groups are verified chunk against chunk.
GROUP_ROWS = 50_000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of one text over its word shingles, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[:n].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8", copy=False)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp long) for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            fp = pa.array(np.array(values, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def block_keys(blocks: int = BLOCKS, max_distance: int = MAX_DISTANCE) -> list[list[tuple[int, int]]]:
    """(shift, width) lists, one per choice of blocks that a close pair may share."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(blocks)]
    return [list(chosen) for chosen in combinations(parts, blocks - max_distance)]


def _key_column(number: int, parts: list[tuple[int, int]]):
    key = F.lit(number).cast("long")
    for shift, width in parts:
        piece = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        key = F.shiftleft(key, width).bitwiseOR(piece)
    return key


def _forest(fps: np.ndarray, reps: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Links (seed, member) that connect what is close, chained where needed; each member is expanded once."""
    order = np.argsort(reps, kind="stable")
    fps, reps = fps[order], reps[order]
    left = np.arange(len(fps))
    while len(left):
        seed, left = left[0], left[1:]
        frontier = np.array([seed])
        while len(frontier) and len(left):
            now, frontier = frontier[:64], frontier[64:]
            near = (np.bitwise_count(fps[now][:, None] ^ fps[left][None, :]) <= limit).any(axis=0)
            if near.any():
                for member in left[near]:
                    yield int(reps[seed]), int(reps[member])
                frontier = np.concatenate([frontier, left[near]])
                left = left[~near]


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(src, dst) between representatives: enough links to connect all fingerprints within the distance.

    ``distinct`` has one row (fp, rep) per fingerprint.
    """
    keys = [_key_column(i, parts) for i, parts in enumerate(block_keys(blocks, max_distance))]
    keyed = distinct.select("fp", "rep", F.explode(F.array(*keys)).alias("key"))
    sizes = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_rows), "hotblocks")
    if sizes.isEmpty():
        keyed = keyed.withColumn("pair", F.lit(0).cast("long"))
    else:  # a huge group is split in chunks; a row meets every chunk, one pair of chunks a task
        c = F.ceil(F.coalesce("n", F.lit(1)) / group_rows).cast("long")
        keyed = keyed.join(sizes, "key", "left").withColumn("c", c).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("c")))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda j: F.least(j, "mine") * F.col("c") + F.greatest(j, "mine"))
        keyed = keyed.select("fp", "rep", "key", F.explode(pairs).alias("pair"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def groups(table: np.ndarray) -> list[tuple[int, int]]:
            change = np.flatnonzero((table[1:, 2:] != table[:-1, 2:]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [len(table)]])
            found: list[tuple[int, int]] = []
            for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                found += _forest(table[a:b, 0].view(np.uint64), table[a:b, 1], max_distance)
            return found

        def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(rows, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
            held.append(part)
            if (part[-1, 2:] == held[0][0, 2:]).all():
                continue
            table = np.concatenate(held)
            last = np.flatnonzero((table[:, 2:] != table[-1, 2:]).any(axis=1))[-1] + 1  # the last group may go on
            yield out(groups(np.ascontiguousarray(table[:last])))
            held = [table[last:]]
        if held:
            yield out(groups(np.ascontiguousarray(np.concatenate(held))))

    return keyed.select("fp", "rep", "key", "pair").repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(verify, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = MAX_DISTANCE, blocks: int = BLOCKS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id reachable over close fingerprints."""
    each = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    distinct = materialize(each.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "distinct")
    groups = connected_components(links(distinct, max_distance, blocks, group_rows))
    named = distinct.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    joined = each.join(named, "fp", "left")
    return joined.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def hex_digits(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs with the smallest id of each near-duplicate group; of repeated rows with that id one stays.

    Rows without an id are kept.
    """
    found = near_duplicates(docs, id_col, text_col, **kwargs)
    kept = found.where("id is not null and id = component_id").select("id").distinct()
    rows = carried(docs, id=F.col(id_col).cast("long"), text=F.col(text_col))
    one = Window.partitionBy("id").orderBy(F.xxhash64("text"), "text")  # ids seldom repeat
    chosen = rows.join(kept, "id", "left_semi").withColumn("n", F.row_number().over(one)).where("n = 1")
    return chosen.select("row.*").unionByName(rows.where("id is null").select("row.*"))
