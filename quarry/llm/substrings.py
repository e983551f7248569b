"""Removal of repeated passages with suffix automata of reference shards.

A window is ``window`` consecutive words. A word goes if it lies in a window
whose words also start in a document with a smaller id. Every window is judged
on the input.

1. Fingerprints. Each window has a minimizer: the smallest hash of the 8-word
   grams inside it. Equal windows have equal minimizers at equal places, so only
   documents that share a minimizer can share a window. Neighbouring windows with
   one minimizer form a run; a digest (BLAKE2b, 128 bits) names all its words.
2. Whole runs. A run whose words occur in a document with a smaller id goes as a
   whole. Copies of any number meet in an aggregation and need nothing more.
3. Automata. Where a minimizer has several different runs, the first document of
   each run is a reference. The references of a minimizer form a shard; a suffix
   automaton of their words is built in id order, and each document is streamed
   against the automaton of the smaller ids for its matching statistics. Maximal
   spans of at least ``window`` words go. Shards of over ``shard_runs`` runs are
   split, and a document is streamed against each part; a minimizer with more
   than ``most_shards`` parts has its windows compared by digest, which splits
   without limit.

The hash of the grams only proposes: two grams that collide bring windows
together, and equal windows always meet. Equality is decided by the words (in the
automata) or by a cryptographic digest of them, for which no collision is known.

Automata of the whole corpus, broadcast to every task, would need memory for
every word and time for documents times shards; here a shard meets only the
documents that share a minimizer with it. ``against_reference`` keeps the
broadcast form for a bounded outside reference.

Defined results:
- null text: no words; fewer words than a window: nothing goes;
- null id: nothing goes, and the row is nobody's reference;
- very long texts: read whole, a batch of about ``BATCH_BYTES`` or one text at a time; ties: the leftmost minimizer;
- repeated rows: equal ids are one document, which is never its own reference;
- empty table: empty result;
- other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import materialize

WINDOW = 50
GRAM = 8
SHARD_RUNS = 1_000
MOST_SHARDS = 64
#: Span lists up to this many spans (about 10 MB) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_SPANS = 100_000
#: Bytes of text that a task hashes at once (a longer document alone).
BATCH_BYTES = 1 << 19

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)


class SuffixAutomaton:
    """The automaton of all substrings of several word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _copy(self, p: int, q: int, word) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: Iterable) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._copy(last, q, word)
                continue
            new = len(self.next)
            self.next.append({})
            self.link.append(0)
            self.size.append(self.size[last] + 1)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, q, word)
            last = new

    def spans(self, words: list, least: int) -> list[tuple[int, int]]:
        """Merged half-open spans of words that lie in a match of at least ``least`` words."""
        found: list[tuple[int, int]] = []
        state = length = 0
        step, link, size = self.next, self.link, self.size
        for i, word in enumerate(words):
            to = step[state].get(word)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(word)
            if to is None:
                length = 0
                continue
            state, length = to, length + 1
            if length >= least:
                start = i + 1 - length
                if found and start <= found[-1][1]:
                    found[-1] = (min(found[-1][0], start), i + 1)
                else:
                    found.append((start, i + 1))
        return found


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Hashes:
    """Hashes of any word range of some documents, from one running sum over their bytes."""

    def __init__(self, docs: list[list[bytes]]) -> None:
        words = [w for d in docs for w in d]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.stop = np.cumsum(sizes + 1) - 1
        self.start = self.stop - sizes
        self.text = b" ".join(words)
        data = np.frombuffer(self.text, np.uint8)
        power, self.inverse = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the words first..last (inclusive)."""
        a = self.start[first]
        return _mix((self.sums[self.stop[last]] - self.sums[a]) * self.inverse[a])

    def digest(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(n, 2) longs: the digest of the words first..last (inclusive), joined by spaces."""
        text, of = self.text, hashlib.blake2b
        found = b"".join([of(text[a:b], digest_size=16).digest() for a, b in zip(self.start[first].tolist(), self.stop[last].tolist())])
        return np.frombuffer(found, np.int64).reshape(-1, 2)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _lowest(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of every ``width`` neighbouring hashes, of equal ones the leftmost, whatever stands around them."""
    out = np.empty(len(grams) - width + 1, np.int64)
    bits = np.uint64(20)
    step = (1 << 20) - width
    for at in range(0, len(out), step):
        part = grams[at : at + step + width - 1]
        ranked = (part >> bits << bits) | np.arange(len(part), dtype=np.uint64)
        out[at : at + step] = at + (_sliding_min(ranked, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
    return out


def runs_of(docs: list[list[bytes]], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(document number, first word, windows, minimizer, the two halves of the run's digest) of every run of docs."""
    counts = np.array([len(d) for d in docs], np.int64)
    total = int(counts.sum())
    none = np.zeros(0, np.int64)
    if total < window:
        return none, none, none, none, none, none
    h = _Hashes(docs)
    doc = np.repeat(np.arange(len(docs)), counts)
    base = np.cumsum(counts) - counts
    at = np.arange(total - gram + 1)
    grams = h.of(at, at + gram - 1)
    low = _lowest(grams, window - gram + 1)
    begin = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])  # windows inside one document
    if not len(begin):
        return none, none, none, none, none, none
    low = low[begin]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (low[1:] != low[:-1]) | (begin[1:] != begin[:-1] + 1)
    head = np.flatnonzero(fresh)
    many = np.diff(np.append(head, len(begin)))
    first = begin[head]
    whole = h.digest(first, first + many - 1 + window - 1)
    number = doc[first]
    return number, first - base[number], many, grams[low[head]].view(np.int64), whole[:, 0], whole[:, 1]


def _batched(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Row numbers and words of rows with enough words, about BATCH_BYTES at a time."""
    rows: list[int] = []
    docs: list[list[bytes]] = []
    held = 0
    for i, text in enumerate(batch.column("text")):
        words = words_of(text.as_py())
        rows.append(i)
        docs.append(words)
        held += sum(map(len, words)) + len(words)
        if held >= BATCH_BYTES:
            yield rows, docs
            rows, docs, held = [], [], 0
    if rows:
        yield rows, docs


def _runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column("id").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False)
            for rows, docs in _batched(batch):
                number, first, many, low, whole, more = runs_of(docs, window, gram)
                of = np.array(rows, np.int64)[number]
                yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(marks[of]), pa.array(first.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(low), pa.array(whole), pa.array(more)], names=["id", "mark", "first", "many", "low", "whole", "more"])

    return rows.where("id is not null").select("id", "mark", "text").mapInArrow(run, "id long, mark long, first int, many int, low long, whole long, more long")


def _with_lists(rows: DataFrame, lists: DataFrame, how: str, count: int, limit: int) -> DataFrame:
    """rows joined with one list per (id, mark), broadcast if the lists are short in all."""
    lists = F.broadcast(lists) if count <= limit else lists
    return rows.join(lists, ["id", "mark"], how)


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_runs: int = SHARD_RUNS, most_shards: int = MOST_SHARDS, broadcast_spans: int = BROADCAST_SPANS) -> DataFrame:
    """(id, mark, start, stop): spans of words to remove, from rows (id, mark, text)."""
    runs = materialize(_runs(rows, window, gram), "runs")
    kinds = runs.groupBy("low", "whole", "more").agg(F.min("id").alias("owner"), F.max("id").alias("latest"))  # copies meet here
    shared = kinds.groupBy("low").agg(F.count("*").alias("kinds"), F.min("owner").alias("a"), F.max("latest").alias("b")).where("a < b").select("low", "kinds")
    known = materialize(kinds.join(shared, "low").where("kinds > 1 or owner < latest").select("low", "whole", "more", "owner", "kinds"), "kinds")
    met = runs.join(known, ["low", "whole", "more"]).where("owner < id or kinds > 1")
    met = materialize(met.select("id", "mark", "first", "many", "low", (F.col("owner") < F.col("id")).alias("copy")), "met")
    stop = F.col("first") + F.col("many") + F.lit(window - 1)
    spans = met.where("copy").select("id", "mark", F.col("first").alias("start"), stop.alias("stop"))

    open_runs = met.where("not copy")
    per_low = open_runs.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    wanted = materialize(open_runs.join(per_low, "low").select("id", "mark", "first", "many", "low", F.ceil(F.col("n") / shard_runs).cast("int").alias("parts")), "open")
    count = wanted.count()
    if not count:
        return spans
    lists = wanted.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "many", "low", "parts")).alias("open"))
    texts = _with_lists(rows, lists, "inner", count, broadcast_spans)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column("text")[i].as_py())
                opened = batch.column("open")[i].as_py()
                n = len(opened)
                cut = [b" ".join(words[o["first"] : o["first"] + o["many"] + window - 1]) for o in opened]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("id")[i].as_py()] * n, pa.int64()),
                        pa.array([batch.column("mark")[i].as_py()] * n, pa.int64()),
                        pa.array([o["first"] for o in opened], pa.int32()),
                        pa.array([o["low"] for o in opened], pa.int64()),
                        pa.array([o["parts"] for o in opened], pa.int32()),
                        pa.array(cut, pa.binary()),
                    ],
                    names=["id", "mark", "first", "low", "parts", "words"],
                )

    cut = materialize(texts.mapInArrow(contexts, "id long, mark long, first int, low long, parts int, words binary"), "contexts")
    few = cut.where(F.col("parts") <= most_shards).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")))
    dealt = few.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    dealt = dealt.select("low", "part", "id", "mark", "first", (F.col("own") == F.col("part")).alias("holds"), "words")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        automaton, waiting, current = SuffixAutomaton(), [], None
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            columns = [batch.column(name).to_pylist() for name in ("low", "part", "id", "mark", "first", "holds", "words")]
            for low, part, doc, mark, first, holds, data in zip(*columns):
                if (low, part) != group:
                    group, automaton, waiting, current = (low, part), SuffixAutomaton(), [], doc
                elif doc != current:  # the automaton holds smaller ids only
                    for words in waiting:
                        automaton.add(words)
                    waiting, current = [], doc
                words = data.split()
                found += [(doc, mark, first + a, first + b) for a, b in automaton.spans(words, window)]
                if holds:
                    waiting.append(words)
            out = np.array(found, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2].astype(np.int32)), pa.array(out[:, 3].astype(np.int32))], names=["id", "mark", "start", "stop"])

    schema = "id long, mark long, start int, stop int"
    matched = dealt.repartition("low", "part").sortWithinPartitions("low", "part", "id", "mark", "first").mapInArrow(stream, schema)
    spans = spans.unionByName(matched)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].as_py().split()
                at = np.arange(len(words) - window + 1)
                n = len(at)
                hashed = _Hashes([words]).digest(at, at + window - 1)
                same = [pa.array([batch.column(c)[i].as_py()] * n, pa.int64()) for c in ("id", "mark", "low")]
                yield pa.RecordBatch.from_arrays([*same, pa.array((at + batch.column("first")[i].as_py()).astype(np.int32)), pa.array(hashed[:, 0]), pa.array(hashed[:, 1])], names=["id", "mark", "low", "start", "hash", "more"])

    many = cut.where(F.col("parts") > most_shards)
    if not many.isEmpty():
        each = materialize(many.mapInArrow(windows, "id long, mark long, low long, start int, hash long, more long"), "windows")
        first = each.groupBy("low", "hash", "more").agg(F.min("id").alias("owner"), F.max("id").alias("latest")).where("owner < latest").select("low", "hash", "more", "owner")
        again = each.join(first, ["low", "hash", "more"]).where("owner < id")
        spans = spans.unionByName(again.select("id", "mark", "start", (F.col("start") + window).alias("stop")))
    return spans


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))


def _kept(words: list[bytes], spans: list[dict] | None) -> tuple[list[bytes], int]:
    if not spans:
        return words, 0
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["start"]] += 1
        gone[s["stop"]] -= 1
    gone = np.cumsum(gone[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], int(gone.sum())


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_spans: int = BROADCAST_SPANS, with_text: bool = False, **kwargs) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) per row, and with ``with_text`` the kept words joined by spaces."""
    rows = keyed(docs, id_col, text_col)
    spans = materialize(repeated_spans(rows, broadcast_spans=broadcast_spans, **kwargs), "spans")
    lists = spans.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    joined = _with_lists(rows, lists, "left", spans.count(), broadcast_spans).select("id", "text", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts, removed, digests, texts = [], [], [], []
                for text, gone in zip(batch.column("text"), batch.column("gone")):
                    words = words_of(text.as_py())
                    kept, n = _kept(words, gone.as_py())
                    data = b" ".join(kept)
                    counts.append(len(words))
                    removed.append(n)
                    digests.append(hashlib.sha256(data).hexdigest())
                    if with_text:
                        texts.append(data.decode("utf-8", "surrogatepass"))
                columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if with_text else []), names=names + (["kept"] if with_text else []))

    return joined.mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def against_reference(docs: DataFrame, reference: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = 200_000, most_words: int = 5_000_000) -> DataFrame:
    """(id, mark, start, stop): spans of docs that occur in a bounded outside reference, by broadcast automata, shard after shard.

    ``most_words`` bounds what is sent to the driver and to every executor; a larger reference is refused.
    """
    size = reference.agg(F.sum(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > most_words:
        raise ValueError(f"the reference has {size} words, more than the {most_words} that are broadcast; use repeated_spans")
    rows = keyed(docs, id_col, text_col)
    found = None
    shard, held = SuffixAutomaton(), 0
    shards = []
    for row in reference.select(text_col).toLocalIterator():
        words = words_of(row[0])
        shard.add(words)
        held += len(words)
        if held >= shard_words:
            shards.append(shard)
            shard, held = SuffixAutomaton(), 0
    for automaton in [*shards, shard]:
        sent = docs.sparkSession.sparkContext.broadcast(automaton)

        def stream(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(d, m, a, b) for d, m, t in zip(batch.column("id").to_pylist(), batch.column("mark").to_pylist(), batch.column("text")) for a, b in sent.value.spans(words_of(t.as_py()), window)]
                ids, marks, starts, stops = zip(*out) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["id", "mark", "start", "stop"])

        part = rows.mapInArrow(stream, "id long, mark long, start int, stop int")
        found = part if found is None else found.unionByName(part)
    return found
