"""Approximate nearest neighbours with an inverted multi-index.

Each vector is cut in two halves, each half quantised to its nearest of ``k``
centroids (k-means in numpy on a bounded sample, by a hash of the id; k grows
with the square root of the rows); the pair of centroids is the vector's cell. A
query walks pairs of centroids in order of summed squared distance with a heap
until the cells it has taken hold the ``share`` of all entries. Every cell up to
the summed distance reached is reranked by exact Euclidean distance in double
precision on the original vectors. Unless given, the share is measured: the
smallest that reaches ``RECALL`` for a bounded number of queries against brute
force over all rows, so that it follows the data at their real number.

Every row is indexed. Equal vectors share an entry that lists its ``top + 1``
smallest distinct ids with their counts; the others cannot be among a query's
``top`` nearest, since ties go to smaller ids. Neighbouring cells are packed into
parts (a larger cell is split over several). A query is sent to a part once, with
its walk's last distance, and gets back its ``top`` best; a task holds one part's
entries and reads the queries in batches, however many they are.

Defined results:
- null or zero vectors and those with null or non-finite components take no part, nor do those whose length is not the commonest (of equally common lengths the larger);
- null ids take no part; repeated ids are separate candidates, but never of a query with that id;
- a query id that repeats with the same vector asks once, with different vectors once for each: its ranks then appear once per vector;
- ties go to the smaller id; very long vectors only cost their length;
- fewer candidates than ``top``: all that were found; empty table: empty result;
- other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import materialize

TOP = 10
KEPT = pa.list_(pa.struct([("id", pa.int64()), ("many", pa.int32())]))
#: Bounds of the sample on which centroids are fitted, and of the centroids of a half.
SAMPLE_ROWS = 20_000
MOST_CENTROIDS = 1_024
RECALL = 0.94
CALIBRATION_QUERIES = 256
#: Entries of a part: about a task's share of them, between these bounds.
PART_ROWS = (1_024, 32_768)
MOST_TASKS = 50_000


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances by expansion: only for quantising, never for the answer."""
    return (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)[None, :]


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(points[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)


def walk(first: np.ndarray, second: np.ndarray, held: np.ndarray, want: int) -> tuple[list[int], float]:
    """Cells in order of first[i] + second[j] until they hold ``want`` entries, and the sum reached. held[i, j] counts a cell's entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    one, two = first[a].tolist(), second[b].tolist()
    rows, columns, width = a.tolist(), b.tolist(), len(b)
    many: list[list[int]] = []  # of each row reached, its cells' entries in the order of the columns
    heap = [(one[0] + two[0], 0, 0)]
    taken: list[int] = []
    total, reached = 0, 0.0
    while heap and total < want:
        reached, i, j = heap[0]
        if j + 1 < width:
            heapq.heapreplace(heap, (one[i] + two[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0:  # rows are reached one after the other
            many.append(held[rows[i], b].tolist())
            if i + 1 < len(rows):
                heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
        n = many[i][j]
        if n:
            taken.append(rows[i] * width + columns[j])
            total += n
    return taken, reached


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def needed_share(entries: DataFrame, points: np.ndarray, books: tuple[np.ndarray, np.ndarray], held: np.ndarray, top: int = TOP, recall: float = RECALL) -> float:
    """The share of entries that points must see to find their nearest in ``recall`` of the cases: brute force over all entries."""
    sent = entries.sparkSession.sparkContext.broadcast(points)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, best = sent.value, None
        own = (points * points).sum(axis=1)[:, None]
        for batch in batches:
            if not batch.num_rows:
                continue
            d, cell = distances(points, _matrix(batch.column(0))), np.broadcast_to(np.asarray(batch.column(1)), (len(points), batch.num_rows))
            d = np.where(d < 1e-9 * (1 + own), np.inf, d)  # the point itself
            if best is not None:
                d, cell = np.concatenate([best[0], d], axis=1), np.concatenate([best[1], cell], axis=1)
            near = np.argsort(d, axis=1, kind="stable")[:, :top]
            best = np.take_along_axis(d, near, axis=1), np.take_along_axis(cell, near, axis=1)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(points)), best[0].shape[1])), pa.array(best[0].ravel()), pa.array(best[1].ravel())], names=["q", "d", "cell"])

    found = entries.select("v", "cell").mapInArrow(brute, "q long, d double, cell long").where("d < double('infinity')")
    place = F.row_number().over(Window.partitionBy("q").orderBy("d"))
    true = found.withColumn("n", place).where(F.col("n") <= top).groupBy("q").agg(F.collect_list("cell").alias("cells")).collect()  # CALIBRATION_QUERIES rows
    half, total, needed = books[0].shape[1], int(held.sum()), []
    for r in true:
        point = points[r["q"] : r["q"] + 1]
        sums = distances(point[:, :half], books[0])[0][:, None] + distances(point[:, half:], books[1])[0][None, :]
        needed += [held[sums <= sums.flat[c]].sum() / total for c in r["cells"]]  # what a walk has taken when it reaches the cell
    return float(np.quantile(needed, recall)) if needed else 1.0


def pack(held: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per cell the first of its parts and their number: small neighbours share a part, a large cell has several."""
    first, splits, part, room = np.zeros(held.size, np.int64), np.ones(held.size, np.int64), -1, 0
    for cell in np.flatnonzero(held):
        n = int(held.flat[cell])
        if n > part_rows:
            splits[cell] = -(-n // part_rows)
            first[cell], part, room = part + 1, part + splits[cell], 0
            continue
        if n > room:
            part, room = part + 1, part_rows
        first[cell] = part
        room -= n
    return first, splits


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 100, top: int = TOP, share: float | None = None, centroids: int | None = None, sample_rows: int = SAMPLE_ROWS, part_rows: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): the nearest found of every row whose id is divisible by query_every."""
    spark = vectors.sparkSession
    rows = materialize(valid(vectors, id_col, vector_col), "vectors")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow()  # at most sample_rows
    if not drawn.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    points = _matrix(drawn.column(0).combine_chunks())
    half = (points.shape[1] + 1) // 2

    # Entries: distinct vectors with their smallest ids. The limit per group is applied before the shuffle too.
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    counted = rows.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(top)).cast("int").alias("many"))
    few = counted.withColumn("n", place).where(F.col("n") <= top + 1).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "many"))).alias("ids"))
    few = materialize(few, "distinct")
    total = few.count()
    k = centroids or int(min(MOST_CENTROIDS, len(points), max(4, np.sqrt(total))))
    books = (kmeans(points[:, :half], k), kmeans(points[:, half:], k) if half < points.shape[1] else np.zeros((1, 0)))
    sent = spark.sparkContext.broadcast(books)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        for batch in batches:
            v = _matrix(batch.column(0))
            if len(v):
                cell = nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int64))], names=["v", "ids", "cell"])

    entries = materialize(few.mapInArrow(quantise, "v array<double>, ids array<struct<id:long,many:int>>, cell long"), "entries")
    held = np.zeros((len(books[0]), len(books[1])), np.int64)
    sizes = entries.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # a row per cell, at most MOST_CENTROIDS squared (16 MB)
    held.flat[np.asarray(sizes["cell"])] = np.asarray(sizes["n"])
    share = needed_share(entries, points[:CALIBRATION_QUERIES], books, held, top) if share is None else share
    tasks = spark.sparkContext.defaultParallelism
    part_rows = part_rows or int(min(max(total // (2 * tasks), PART_ROWS[0]), PART_ROWS[1]))
    first, splits = pack(held, part_rows)
    tables = spark.sparkContext.broadcast((held, first, splits, max(1, int(np.ceil(share * total)))))

    def place_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, first, splits, _ = tables.value
        for batch in batches:
            cell, spread = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            part = first[cell] + spread % splits[cell]
            none = pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(part), none[0], *batch.columns[:3], none[1]], names=["part", "query_id", "v", "ids", "cell", "reached"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sent.value
        held, first, splits, want = tables.value
        for batch in batches:
            v = _matrix(batch.column(1))
            for i, q in enumerate(batch.column(0).to_pylist()):
                cells, reached = walk(distances(v[i : i + 1, :half], one)[0], distances(v[i : i + 1, half:], two)[0], held, want)
                cells = np.array(cells)
                whole = cells[splits[cells] == 1]
                wanted = np.unique(np.concatenate([first[whole], *(np.arange(first[c], first[c] + splits[c]) for c in cells[splits[cells] > 1])]))
                n = len(wanted)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wanted), pa.array([q] * n, pa.int64()), pa.array([v[i]] * n, pa.list_(pa.float64())), pa.nulls(n, KEPT), pa.nulls(n, pa.int64()), pa.array([reached] * n, pa.float64())],
                    names=["part", "query_id", "v", "ids", "cell", "reached"],
                )

    schema = "part long, query_id long, v array<double>, ids array<struct<id:long,many:int>>, cell long, reached double"
    spread = F.pmod(F.xxhash64("v"), F.lit(1 << 30))
    dealt = entries.select("v", "ids", "cell", spread.alias("spread")).mapInArrow(place_entries, schema)
    asked = rows.where(F.col("id") % query_every == 0).select("id", "v").distinct().repartition(tasks)
    both = dealt.unionByName(asked.mapInArrow(probe, schema))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part's entries come first, then its queries."""
        one, two = sent.value
        part, waiting, ready = None, [], None

        def answer(queries: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal ready
            if ready is None:
                v, cell = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting])
                ready = v, cell // len(two), cell % len(two), [ids for x in waiting for ids in x[2].to_pylist()]
            entries, a, b, ids = ready
            asked = _matrix(queries.column(2))
            to_one, to_two = distances(asked[:, :half], one), distances(asked[:, half:], two)
            reached = np.asarray(queries.column(5))
            limit = reached + 1e-9 * (1 + np.abs(reached) + (asked * asked).sum(axis=1))  # rounding only lets in more
            out: list[tuple[int, int, int, float]] = []
            for i, q in enumerate(queries.column(1).to_pylist()):
                at = np.flatnonzero(to_one[i][a] + to_two[i][b] <= limit[i])
                d = np.sqrt(((entries[at] - asked[i]) ** 2).sum(axis=1))
                # One entry may hold the query alone, so one more distance is let in.
                cut = np.partition(d, top)[top] if len(d) > top + 1 else np.inf
                mark = xxhash.xxh64_intdigest(asked[i].tobytes()) >> 1
                found = [(float(d[j]), x["id"]) for j in np.flatnonzero(d <= cut) for x in ids[at[j]] if x["id"] != q for _ in range(x["many"])]
                out += [(q, mark, x, s) for s, x in heapq.nsmallest(top, found)]
            columns = list(zip(*out)) if out else [()] * 4
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.float64()
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["query_id", "mark", "id", "score"])

        for batch in batches:
            parts = np.asarray(batch.column(0))
            entry = np.asarray(batch.column(1).is_null())
            cuts = np.flatnonzero((parts[1:] != parts[:-1]) | (entry[1:] != entry[:-1])) + 1 if len(parts) else np.zeros(0, int)
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if a == b:
                    continue
                if parts[a] != part:
                    part, waiting, ready = parts[a], [], None
                some = batch.slice(a, b - a)
                if entry[a]:
                    waiting.append((_matrix(some.column(2)), np.asarray(some.column(4)), some.column(3)))
                else:
                    for at in range(0, some.num_rows, 1024):
                        yield answer(some.slice(at, 1024))

    parts = int((first + splits).max())
    found = both.repartition(min(parts, MOST_TASKS), "part").sortWithinPartitions("part", F.col("query_id").isNotNull()).mapInArrow(rerank, "query_id long, mark long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "id", "score")
