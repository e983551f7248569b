"""Benchmark decontamination against a broadcast hash set of test n-grams, in SQL functions only.

A window is ``n`` consecutive words of a benchmark item (an item with fewer
words, but not none, is one window). Every token position of a document is
probed by the hash of its next few words against the broadcast set of windows;
a probe that hits is verified word by word over the whole window. The words
inside verified windows are hit.

The set is broadcast up to ``broadcast_bytes`` of its own text. A larger one is
joined by a shuffle of places alone (id, hash of the text, position, hash of the
whole window); the places that meet a window go back to the texts by id and are
verified there, with the same result.

Defined results:
- null or word-less text: no words, no hits; null benchmark texts have no windows;
- null id: the row is judged and returned like any other;
- repeated rows: each is returned, with the same result;
- very long texts: time in proportion to their words; ties do not arise, since every window that occurs counts;
- repeated items (same id, or same words under several ids): each item id counts once, null ids not at all;
- empty tables: no documents give no rows, no benchmark leaves every document clean;
- other columns are not read by ``judge``; the filters keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import carried
from quarry.session import materialize

#: Words once A-Z is lower-cased, and the same class before that.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Words hashed for the probe; the rest of a window is compared on a hit.
PROBE = 4
#: Bytes of windows and their items that are broadcast, with 16 for each word's own bookkeeping.
BROADCAST_BYTES = 100 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(items array<string>, gram array<string>): the distinct windows with the ids of their items."""
    tokens = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - width + 1)
    grams = tokens.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("gram"))
    return grams.groupBy("gram").agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, mark, n_words, pos, width, items): every place where a window occurs, and one row without items for every text.

    pos counts words from 0; mark is the text's hash.
    """
    windows = materialize(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    size = sum((F.octet_length(F.array_join(c, "")) + 16 * F.size(c) for c in ("gram", "items")), F.lit(32))
    sent = (windows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= broadcast_bytes
    probed = F.least(F.size("gram"), F.lit(PROBE if sent else window))
    probes = sorted((r["k"] for r in windows.select(probed.alias("k")).distinct().collect()), reverse=True)  # at most ``window`` values
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), words(F.col(text_col)).alias("w"))
    # The outer form keeps texts without words; the planner would also put a test of size(w) before the other and split every text twice.
    places = base.select("id", "mark", "w", F.posexplode_outer("w").alias("pos", "first"))
    head = F.coalesce("pos", F.lit(0)) == 0
    found = None
    for k in probes or [PROBE]:
        side = windows.where(probed == k)
        side = side.select("items", "gram", F.size("gram").alias("width"), F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(k)]).alias("key"))
        probe = F.xxhash64(F.col("first"), *[F.get("w", F.col("pos") + j) for j in range(1, k)])
        each = places.select("id", "mark", "w", "pos", probe.alias("probe"))
        if sent:
            same = (F.col("probe") == F.col("key")) & (F.slice("w", F.col("pos") + 1, F.col("width")) == F.col("gram"))
            met = each.join(F.broadcast(side), same, "left")
            hit = met.where(F.col("items").isNotNull() | (head if found is None else F.lit(False)))
            hit = hit.select("id", "mark", F.size("w").cast("long").alias("n_words"), "pos", "width", "items")
        else:
            hit = _verified(each.where("pos is not null").select("id", "mark", "pos", "probe").join(side, F.col("probe") == F.col("key")), base)
        found = hit if found is None else found.unionByName(hit)
    if not sent:
        none = [F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c in ("pos", "width", "items")]
        found = found.unionByName(base.select("id", "mark", F.size("w").cast("long").alias("n_words"), *none))
    return found


def _verified(met: DataFrame, base: DataFrame) -> DataFrame:
    """Of the places that met a window by its hash, those that hold its words; each text is read once more."""
    lists = met.groupBy("id", "mark").agg(F.collect_set(F.struct("pos", "width", "gram", "items")).alias("met"))
    lists = lists.select(F.col("id").alias("met_id"), F.col("mark").alias("met_mark"), "met")
    joined = base.join(lists, F.col("id").eqNullSafe(F.col("met_id")) & (F.col("mark") == F.col("met_mark")))
    true = F.filter("met", lambda m: F.slice("w", m["pos"] + 1, m["width"]) == m["gram"])
    return joined.select("id", "mark", F.size("w").cast("long").alias("n_words"), F.explode(true).alias("m")).select("id", "mark", "n_words", "m.pos", "m.width", "m.items")


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """(id, mark, n_words, n_hit, n_items, items, contaminated) per row of docs."""
    places = hits(docs, benchmark, id_col, text_col, **kwargs)
    spans = F.sort_array(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", (F.col("pos") + F.col("width")).alias("stop")))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        "spans",
        start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["pos"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], s["stop"]).alias("upto")),
    )["n"]
    of = places.select("id", "mark", "n_words", "pos", "width", "items", F.explode_outer("items").alias("item"))
    summed = of.groupBy("id", "mark").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    summed = summed.select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "n_words", covered.alias("n_hit"), "items", F.when(F.size("spans") > 0, F.col("spans")).alias("spans"))
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    joined = base.join(summed, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "id",
        "mark",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """The rows of docs that are not contaminated."""
    bad = judge(docs, benchmark, id_col, text_col, **kwargs).where("contaminated").select(F.col("id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct()
    rows = carried(docs, id=F.col(id_col), mark=F.xxhash64(text_col))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("mark") == F.col("bad_mark")), "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """docs with the hit words (and what separates each from the next word) taken out of the text."""
    found = judge(docs, benchmark, id_col, text_col, **kwargs).where("n_hit > 0").select(F.col("id").alias("hit_id"), F.col("mark").alias("hit_mark"), "spans").dropDuplicates(["hit_id", "hit_mark"])
    rows = carried(docs, id=F.col(id_col), mark=F.xxhash64(text_col), text=F.col(text_col))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark")), "left")
    gaps = F.split("text", RAW_WORD)
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(RAW_WORD), F.lit(0)).alias("word"), F.slice(gaps, F.lit(2), F.greatest(F.lit(0), F.size(gaps) - 1)).alias("gap"))
    kept = F.filter(pairs, lambda x, i: ~F.exists("spans", lambda s: (s["pos"] <= i) & (i < s["stop"])))
    rebuilt = F.concat(gaps[0], F.array_join(F.transform(kept, lambda x: F.concat(x["word"], x["gap"])), ""))
    return joined.select(F.col("row").withField(text_col, F.when(F.col("spans").isNotNull(), rebuilt).otherwise(F.col("text"))).alias("row")).select("row.*")
