"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads all bytes of a text in both directions, with its state carried
from the first byte to the last and back, labels every byte position with
language probabilities, and pools them into the document's: the mean over all
positions.

A text of over ``PIECE`` bytes is run in pieces side by side: each piece starts
from a state guessed by a run-up over the bytes before it, then the state that
its predecessor really ends in is compared with the guess, and a piece whose
guess was off by more than ``TOLERANCE`` in any unit is run anew from the real
state, until none is. The result is that of one pass. Of a text of over
``BLOCK`` bytes one block is held at a time; the states that its backward pass
enters each block with are found in a pass of their own.

Training is in numpy by backpropagation through time (Adam, cross entropy at
every position) on a bounded sample of labelled rows, whole texts cut into
windows: per language at most ``PER_LABEL`` rows, by a hash of id and text, and
``SAMPLE_BYTES`` bytes (but one row at least). Half of the windows start from the
state in which another one ended, so that the network learns to run on.

Defined results:
- null text or no letter: ``und`` with score 0;
- nothing learned (no labelled rows): ``und`` for all;
- null id: the row is predicted like any other; its crc32 is that of the empty text, so it is held out;
- very long texts: read whole, in time proportional to their length and memory for one block;
- ties between languages: the first in code point order;
- repeated rows: each is returned; equal texts of a batch are read once; empty table: empty result;
- other columns are not read; ``keep_recognised`` keeps them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import carried

UND = "und"
#: Bounds of the training sample.
PER_LABEL = 150
SAMPLE_BYTES = 500_000
WINDOW = 128
HIDDEN = 10
EMBED = 10
#: Bytes of a piece, of a run-up, and of what is run at once.
PIECE = 8192
RUN_UP = 512
BLOCK = 1 << 20
TOLERANCE = 1e-4


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """labels in code point order; w holds the arrays of both directions and of the output layer."""

    labels: list[str]
    w: dict[str, np.ndarray]

    @staticmethod
    def fresh(labels: list[str], seed: int) -> Network:
        rng = np.random.default_rng(seed)
        w = {"emb": rng.normal(0, 0.3, (257, EMBED))}
        for d in "fb":
            w[d + "x"] = rng.normal(0, 1 / np.sqrt(EMBED), (EMBED, 3 * HIDDEN))
            w[d + "h"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN))
            w[d + "b"] = np.zeros(3 * HIDDEN)
        w["out"] = rng.normal(0, 1 / np.sqrt(2 * HIDDEN), (2 * HIDDEN, len(labels)))
        w["bias"] = np.zeros(len(labels))
        return Network(labels, {k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, start: np.ndarray | None = None) -> tuple[np.ndarray, list]:
        """States of one direction. x: (n, t, EMBED), mask: (n, t). Each step is z, r, candidate of a GRU."""
        n, t, _ = x.shape
        h = np.zeros((n, HIDDEN), np.float32) if start is None else start
        tape, states = [], np.zeros((n, t, HIDDEN), np.float32)
        gates = x @ self.w[d + "x"] + self.w[d + "b"]
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            u = h @ self.w[d + "h"]
            z = _sigmoid(gates[:, i, :HIDDEN] + u[:, :HIDDEN])
            r = _sigmoid(gates[:, i, HIDDEN : 2 * HIDDEN] + u[:, HIDDEN : 2 * HIDDEN])
            c = np.tanh(gates[:, i, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            m = mask[:, i : i + 1]
            new = h + m * z * (c - h)
            tape.append((i, h, u, z, r, c, m))
            h = new
            states[:, i] = h
        return states, tape

    def forward(self, ids: np.ndarray, mask: np.ndarray, starts: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
        """Probabilities of each position (n, t, labels)."""
        x = self.w["emb"][ids]
        forward, tape_f = self._run(x, mask, "f", starts and starts["f"])
        backward, tape_b = self._run(x, mask, "b", starts and starts["b"])
        both = np.concatenate([forward, backward], axis=2)
        logits = both @ self.w["out"] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return p, (x, both, tape_f, tape_b)

    def gradients(self, ids: np.ndarray, mask: np.ndarray, target: np.ndarray, starts: dict[str, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Mean cross entropy over positions, its gradients through all time steps of both directions, and the states at either end."""
        p, (x, both, tape_f, tape_b) = self.forward(ids, mask, starts)
        total = mask.sum()
        n = len(ids)
        loss = float(-(np.log(p[np.arange(n), :, target] + 1e-12) * mask).sum() / total)
        d_logits = p.copy()
        d_logits[np.arange(n), :, target] -= 1
        d_logits *= (mask / total)[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["out"] = np.tensordot(both, d_logits, axes=([0, 1], [0, 1]))
        g["bias"] = d_logits.sum(axis=(0, 1))
        d_both = d_logits @ self.w["out"].T
        d_x = np.zeros_like(x)
        for d, tape, d_states in (("f", tape_f, d_both[:, :, :HIDDEN]), ("b", tape_b, d_both[:, :, HIDDEN:])):
            wh = self.w[d + "h"]
            d_gates = np.zeros((*ids.shape, 3 * HIDDEN), np.float32)
            d_h = np.zeros((n, HIDDEN), np.float32)
            for i, h, u, z, r, c, m in reversed(tape):
                d_new = d_h + d_states[:, i]
                d_c = d_new * m * z * (1 - c * c)
                d_z = d_new * m * (c - h) * z * (1 - z)
                d_r = d_c * u[:, 2 * HIDDEN :] * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_gates[:, i] = np.concatenate([d_z, d_r, d_c], axis=1)
                g[d + "h"] += h.T @ d_u
                d_h = d_new * (1 - m * z) + d_u @ wh.T
            g[d + "x"] = np.tensordot(x, d_gates, axes=([0, 1], [0, 1]))
            g[d + "b"] = d_gates.sum(axis=(0, 1))
            d_x += d_gates @ self.w[d + "x"].T
        np.add.at(g["emb"], ids, d_x * mask[:, :, None])
        return loss, g, {"f": both[:, -1, :HIDDEN], "b": both[:, 0, HIDDEN:]}

    def sweep(self, ids: np.ndarray, sizes: np.ndarray, d: str, start: np.ndarray, logits: np.ndarray | None = None, add: bool = False) -> np.ndarray:
        """The end states (HIDDEN, n) of rows run from ``start``; ids: (t, n) bytes, sizes descending. Fills logits (t, labels, n), or adds to them."""
        half = np.repeat(np.float32([0.5, 0.5, 1]), HIDDEN)[:, None]  # a sigmoid is half of 1 + tanh of half its argument
        table = np.ascontiguousarray((self.table(d) * half).T)
        wh = self.w[d + "h"].T * np.float32(0.5)
        out = np.ascontiguousarray((self.w["out"][:HIDDEN] if d == "f" else self.w["out"][HIDDEN:]).T)
        h = np.array(start, np.float32, order="C")
        t = len(ids)
        alive = np.searchsorted(-sizes, -np.arange(t), side="left").tolist()  # rows longer than i
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            m = alive[i]
            was = h[:, :m]
            u, x = wh @ was, np.ascontiguousarray(table.take(ids[i, :m], axis=0).T)
            gates, c = x[: 2 * HIDDEN], x[2 * HIDDEN :]
            gates += u[: 2 * HIDDEN]
            np.tanh(gates, out=gates)
            gates += 1
            u = u[2 * HIDDEN :]
            u *= gates[HIDDEN:]
            c += u
            np.tanh(c, out=c)
            c -= was
            c *= gates[:HIDDEN]
            c *= 0.5
            was += c
            if add:
                logits[i, :, :m] += out @ was
            elif logits is not None:
                logits[i, :, :m] = out @ was
        return h

    def table(self, d: str) -> np.ndarray:
        """What each byte adds to the gates of a direction: (3 * HIDDEN, 257)."""
        return np.ascontiguousarray((self.w["emb"] @ self.w[d + "x"] + self.w[d + "b"]).T)

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """Sum of the position probabilities of each text (len(texts), labels)."""
        total = np.zeros((len(texts), len(self.labels)))
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        waiting: list[int] = []
        held = 0
        at = 0
        while at < len(order) and len(texts[order[at]]) > PIECE:
            i, at = order[at], at + 1
            if len(texts[i]) > BLOCK:
                total[i] = self._long(texts[i])
                continue
            if waiting and held + len(texts[i]) > BLOCK:
                total[waiting] = _Pieces(self, [texts[j] for j in waiting]).sums()
                waiting, held = [], 0
            waiting.append(i)
            held += len(texts[i])
        if waiting:
            total[waiting] = _Pieces(self, [texts[j] for j in waiting]).sums()
        while at < len(order):  # texts of one piece, between a length and half of it, side by side
            longest, start = max(1, len(texts[order[at]])), at
            while at < len(order) and 2 * len(texts[order[at]]) >= longest and (at - start + 1) * longest <= 2 * BLOCK:
                at += 1
            at = max(at, start + 1)
            total[order[start:at]] = self._side_by_side([texts[i] for i in order[start:at]])
        return total

    def _side_by_side(self, texts: list[bytes]) -> np.ndarray:
        """sums of texts of one piece each, longest first."""
        ids, sizes = _columns(texts)
        logits = np.zeros((len(ids), len(self.labels), len(texts)), np.float32)
        zero = np.zeros((HIDDEN, len(texts)), np.float32)
        self.sweep(ids, sizes, "f", zero, logits)
        self.sweep(ids, sizes, "b", zero, logits, add=True)
        return self.pooled(logits, sizes)

    def pooled(self, logits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the positions of each row of the probabilities that logits (t, labels, n) give; logits are used up."""
        live = np.arange(len(logits))[:, None] < sizes[None, :]
        logits += self.w["bias"][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        np.copyto(logits, 0, where=~live[:, None, :])
        return logits.sum(axis=0, dtype=np.float64).T

    def _long(self, text: bytes) -> np.ndarray:
        """sums of one text of several blocks: backward for the states at its cuts, then forward block by block."""
        starts = range(0, len(text), BLOCK)
        state = np.zeros(HIDDEN, np.float32)
        entered = [state]
        for at in reversed(starts[1:]):
            state = _Pieces(self, [text[at : at + BLOCK]], backward=state).run("b")[1]
            entered.append(state)
        state, total = np.zeros(HIDDEN, np.float32), np.zeros(len(self.labels))
        for at, back in zip(starts, reversed(entered)):
            part = _Pieces(self, [text[at : at + BLOCK]], state, back)
            total += part.sums()[0]
            state = part.last["f"]
        return total


class _Pieces:
    """Several texts cut in pieces of at most PIECE bytes that run side by side."""

    def __init__(self, net: Network, texts: list[bytes], forward: np.ndarray | None = None, backward: np.ndarray | None = None) -> None:
        """forward and backward: the states that the first text is entered with (zero if not given)."""
        self.net, self.count = net, len(texts)
        self.text = np.array([i for i, t in enumerate(texts) for _ in range(0, max(1, len(t)), PIECE)])
        self.data = [t[at : at + PIECE] for t in texts for at in range(0, max(1, len(t)), PIECE)]
        n = len(self.data)
        same = np.append(self.text[1:] == self.text[:-1], False)  # the next piece is of the same text
        after = np.where(same, np.arange(1, n + 1), -1)
        before = np.where(np.append(False, same[:-1]), np.arange(-1, n - 1), -1)
        self.chain = {"f": before, "b": after}  # whose end a piece starts from
        self.entry = {"f": (0, forward), "b": (int(np.flatnonzero(self.text == 0)[-1]), backward)}
        self.last: dict[str, np.ndarray] = {}
        sizes = np.array([len(x) for x in self.data])
        order = np.argsort(-sizes, kind="stable")
        self.groups = []
        while len(order):  # pieces between a length and half of it
            many = int(np.searchsorted(-sizes[order], -(sizes[order[0]] // 2), side="right"))
            self.groups.append((order[:many], *_columns([self.data[i] for i in order[:many]])))
            order = order[many:]

    def _guess(self, d: str) -> np.ndarray:
        """The states (HIDDEN, pieces) to start from: those given, zero, or after a run-up over the bytes before the piece."""
        start = np.zeros((HIDDEN, len(self.data)), np.float32)
        at, given = self.entry[d]
        if given is not None:
            start[:, at] = given
        cut = np.flatnonzero(self.chain[d] >= 0)
        if len(cut):
            sides = [self.data[i][-RUN_UP:] if d == "f" else self.data[i][:RUN_UP] for i in self.chain[d][cut]]
            by_size = np.argsort([-len(x) for x in sides], kind="stable")
            zero = np.zeros((HIDDEN, len(cut)), np.float32)
            start[:, cut[by_size]] = self.net.sweep(*_columns([sides[i] for i in by_size]), d, zero)
        return start

    def run(self, d: str, onto: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """Per group the logits (t, labels, n) of one direction, added to ``onto`` if given, and the state after the first text."""
        start, end = self._guess(d), np.zeros((HIDDEN, len(self.data)), np.float32)
        # Only what may be run anew needs an array of its own.
        apart = [onto is None or bool((self.chain[d][who] >= 0).any()) for who, _, _ in self.groups]
        logits = [np.zeros((len(ids), len(self.net.labels), len(who)), np.float32) if own else onto[g] for g, ((who, ids, _), own) in enumerate(zip(self.groups, apart))]
        due = np.ones(len(self.data), bool)
        while due.any():
            for g, (who, ids, sizes) in enumerate(self.groups):
                at = np.flatnonzero(due[who])
                if not len(at):
                    continue
                whole = len(at) == len(who)
                part = logits[g] if whole else np.zeros((len(ids), len(self.net.labels), len(at)), np.float32)
                end[:, who[at]] = self.net.sweep(ids if whole else ids[:, at], sizes[at], d, start[:, who[at]], part, add=not apart[g])
                if not whole:
                    logits[g][:, :, at] = part
            real = np.where(self.chain[d] >= 0, end[:, self.chain[d]], start)
            due = np.abs(real - start).max(axis=0) > TOLERANCE
            start[:, due] = real[:, due]
        self.last[d] = end[:, self.entry["b" if d == "f" else "f"][0]]
        if onto is not None:
            for g, own in enumerate(apart):
                if own:
                    onto[g] += logits[g]
                    logits[g] = onto[g]
        return logits, self.last[d]

    def sums(self) -> np.ndarray:
        total = np.zeros((self.count, len(self.net.labels)))
        logits = self.run("f")[0]
        self.run("b", logits)
        for (who, _, sizes), part in zip(self.groups, logits):
            np.add.at(total, self.text[who], self.net.pooled(part, sizes))
        return total


def _columns(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows of descending length as columns (t, n), and their lengths."""
    sizes = np.array([len(r) for r in rows])
    t = max(1, int(sizes[0]))
    flat = np.frombuffer(b"".join(r.ljust(t, b"\0") for r in rows), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(rows), t).T), sizes


def _padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(w) for w in words])
    ids = np.full((len(words), max(1, sizes.max(initial=1))), 256, dtype=np.int64)
    mask = np.arange(ids.shape[1])[None, :] < sizes[:, None]
    ids[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return ids, mask.astype(np.float32)


def train(rows: list[tuple[str, str]], seed: int = 5, passes: int = 2, batch: int = 128, rate: float = 0.01, least_steps: int = 150) -> Network | None:
    """A network from (text, label) rows. A label with fewer bytes has its windows repeated up to the largest label's; a small sample is passed over more often."""
    labels = sorted({label for _, label in rows})
    if not labels:
        return None
    net = Network.fresh(labels, seed)
    if len(labels) == 1:
        return net
    rng = np.random.default_rng(seed)
    windows: list[list[bytes]] = []
    for label in labels:
        whole = [text.encode("utf-8", "surrogatepass") for text, of in rows if of == label]
        windows.append([t[i : i + WINDOW] for t in whole for i in range(0, len(t), WINDOW)])
    most = max(map(len, windows))
    sample = [(w, at) for at, some in enumerate(windows) if some for w in [*some, *(some[i] for i in rng.integers(0, len(some), most - len(some)))]]
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    each = -(-len(sample) // batch)
    passes = max(passes, -(-least_steps // max(1, each)))
    step, steps = 0, max(1, passes * each)
    ended = {d: np.zeros((1, HIDDEN), np.float32) for d in "fb"}
    for _ in range(passes):
        mixed = rng.permutation(len(sample))
        for at in range(0, len(mixed), batch):
            chosen = [sample[j] for j in mixed[at : at + batch]]
            ids, mask = _padded([w for w, _ in chosen])
            resumed = rng.random((len(chosen), 1)) < 0.5
            starts = {d: ended[d][rng.integers(0, len(ended[d]), len(chosen))] * resumed for d in "fb"}
            _, g, ended = net.gradients(ids, mask, np.array([label for _, label in chosen]), starts)
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            scale = min(1.0, 1.0 / (norm + 1e-12))
            pace = rate * max(0.05, 1 - step / steps)
            for k, v in g.items():
                v = v * scale
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                net.w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, str]]:
    """Rows of each label outside the held-out fold, at most per_label and sample_bytes (but one), by a hash of id and text. The bounds are on what is sent to the driver."""
    known = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col))
    rows = docs.where(known).select(F.col(lang_col).cast("string").alias("label"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row per language
    if not counts:
        return []
    # Of a frequent label only hashes low enough for about four times the bound are looked at, so that no task meets more.
    span = 1 << 63
    cuts = {r["label"]: span - 1 if r["n"] <= 8 * per_label else int(-span + 2 * span * (4 * per_label / r["n"])) for r in counts}
    cut = F.create_map(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for pair in cuts.items() for x in pair])[F.col("label")]
    size = F.octet_length("text").cast("long")
    distinct = rows.where(F.col("h") <= cut).dropDuplicates(["label", "h"]).withColumn("size", size).withColumn("large", size > sample_bytes // 8)
    place = Window.partitionBy("label").orderBy("large", "h")  # large texts last, so that a few do not fill the sample
    chosen = distinct.withColumn("n", F.row_number().over(place)).where(F.col("n") <= per_label)
    chosen = chosen.withColumn("sum", F.sum("size").over(Window.partitionBy("label").orderBy("n")))
    kept = chosen.where((F.col("sum") <= sample_bytes) | (F.col("n") == 1)).select("text", "label", "n").collect()
    return [(r["text"], r["label"]) for r in sorted(kept, key=lambda r: (r["label"], r["n"]))]


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", to: str = "judged") -> DataFrame:
    """docs with a column ``to``: struct (lang_pred, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = sent.value
        for series in parts:
            langs, scores = [UND] * len(series), [0.0] * len(series)
            places: dict[str, list[int]] = {}
            for i, t in enumerate(series.tolist() if net else ()):
                if isinstance(t, str) and any(map(str.isalpha, t)):
                    places.setdefault(t, []).append(i)
            distinct = list(places)
            for at in range(0, len(distinct), 4096):
                some = distinct[at : at + 4096]
                for text, total in zip(some, net.sums([t.encode("utf-8", "surrogatepass") for t in some])):
                    best = int(total.argmax())
                    for i in places[text]:
                        langs[i], scores[i] = net.labels[best], float(min(1.0, total[best] / total.sum()))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.withColumn(to, judged(F.col(text_col)))


def keep_recognised(docs: DataFrame, least: float = 0.34, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose language is recognised: neither ``und`` nor with a pooled probability under ``least``."""
    net = train(sample(docs, id_col, text_col, lang_col))
    marked = predict(carried(docs, text=F.col(text_col)), net)
    return marked.where((F.col("judged.lang_pred") != UND) & (F.col("judged.score") >= least)).select("row.*")
