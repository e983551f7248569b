"""Mixing sources to target weights by Pareto order sampling.

Sizes are word counts. Every source gets a target number of words from its
weight; a target stops at ``ceiling`` times the source's size and the excess
goes to the other sources by weight (water filling). A source whose target is
r times its size takes floor(r) whole copies of each document for certain. The
rest is a fixed-size sample, unequal in probability: a document's inclusion
probability p is proportional to its size, cut at 1, such that the expected words
are those left over. Documents with p = 1 are taken first; the others are ranked
by the random odds u/(1-u) over the inclusion odds p/(1-p) and taken if they fit
in the words left; those that do not are passed over. When none fits any more,
the one whose size is nearest to what still lacks is taken too if that brings the
source nearer its target.

u is a hash of the id, the text and a seed, so reruns agree. The factor of
proportion comes from a source's distinct sizes, the cut from sums per source and
bin of the rank, so no source is sorted in one task. Behind the cut the documents
that still fit are looked through in order, ``STRETCH`` of a source at a time.

Defined results:
- null text: size 0; such rows take no words;
- null source: a source of its own, ordered last;
- null id: allowed, u then depends on the text alone;
- repeated rows: each counts as a document; equal rows at the cut are told apart by their order only;
- ties in rank: by id, then by hash of the text;
- very long texts: only counted and hashed; one too long for what lacks is passed over or, with p = 1, taken;
- empty table: empty result; a source of size 0 has target 0;
- other columns are not read by ``mix``; ``apply_mix`` keeps them; if one is named ``copy_no``, the counter is ``copy_no_1``.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import carried
from quarry.session import materialize

#: The words of a text, and the weights given to sources in order.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
CEILING = 3.0
#: Bins of the rank per source. A bin of a source is the most that one task sorts.
BINS = 1 << 16
#: Documents of a source that one task looks through at once, once most of its words are taken.
STRETCH = 4_096
#: A table of up to this many sources (about 4 MB) is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(keys: DataFrame, column: str) -> DataFrame:
    """keys with ``rank``: 0-based position in code point order, nulls last, without one task holding all."""
    spread = keys.repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    numbered = materialize(spread.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = sorted((r["p"], r["n"]) for r in numbered.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
    offsets, total = {}, 0
    for p, n in counts:
        offsets[p] = total
        total += n
    if not offsets:
        return numbered.drop("_at").withColumn("rank", F.lit(0).cast("long"))
    table = F.create_map(*[x for p, o in offsets.items() for x in (F.lit(p).cast("long"), F.lit(o).cast("long"))])
    return numbered.withColumn("rank", table[part] + place).drop("_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ceiling: float = CEILING) -> DataFrame:
    """(sno, source, source_size, weight, target) for a frame (source, size); sno is the source's place in order."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, "source")
    given = F.array(*[F.lit(float(w)) for w in weights])[(F.col("rank") % len(weights)).cast("int")]
    table = materialize(ranked.select(F.col("rank").alias("sno"), "source", "source_size", given.alias("weight")), "sources")
    level = _level(table, ceiling)
    full, share = F.col("source_size") * F.lit(ceiling), F.col("weight") * F.lit(level)
    return table.withColumn("target", F.least(full, share).cast("double"))


def _level(table: DataFrame, ceiling: float) -> float:
    """Words per unit of weight of the sources that stay under the ceiling."""
    level = 0.0
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(ceiling)
        r = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("source_size") * F.lit(ceiling)).otherwise(0.0)).alias("full"),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)).alias("free"),
        ).first()
        if not r["all"] or not r["free"]:
            return level
        now = max(level, (r["all"] - r["full"]) / r["free"])
        if now <= level * (1 + 1e-12):
            return level
        level = now


def chance(size: Column, factor: Column) -> Column:
    """A document's inclusion probability in what whole copies leave over; a null factor takes all."""
    return F.least(F.lit(1.0), F.coalesce(factor * size, F.lit(1.0)))


def _with_factor(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with ``factor``: the expected words of documents taken with probability min(1, factor x size) are ``rest``.

    If all sizes over s are certain, factor = (rest - words over s) / (squares up to s); the largest s for which that
    leaves s uncertain is the right one. Only the distinct sizes of a source are sorted.
    """
    spread = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    words, squares = F.col("size").cast("double") * F.col("n"), F.col("size").cast("double") * F.col("size") * F.col("n")
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    spread = spread.withColumn("over", F.coalesce(F.sum(words).over(down), F.lit(0.0))).withColumn("squares", F.sum(squares).over(up))
    narrow = sources.select(F.col("of").alias("s"), "rest")
    tried = spread.join(F.broadcast(narrow) if sources.count() <= BROADCAST_SOURCES else narrow, F.col("source").eqNullSafe(F.col("s")))
    tried = tried.withColumn("factor", (F.col("rest") - F.col("over")) / F.col("squares")).where("rest > over and factor * size < 1")
    best = tried.groupBy("source").agg(F.max_by("factor", "size").alias("factor"))
    return sources.join(best, sources["of"].eqNullSafe(best["source"]), "left").drop("source")


def _fill(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with ``fits``, true up to the first of a source that exceeds its ``gap``; and what each source then lacks."""
    # Words per bin, running over the bins of a source: the bin in which the gap is reached.
    binned = docs.groupBy("sno", "bin").agg(F.sum("size").alias("w"), F.first("gap").alias("gap"))
    before = F.sum("w").over(Window.partitionBy("sno").orderBy("bin")) - F.col("w")
    reached = F.max_by(F.struct(F.col("bin").alias("cut_bin"), F.col("before").alias("before")), "bin")
    cut = binned.withColumn("before", before).where("before < gap").groupBy("sno").agg(reached.alias("c"))
    with_cut = docs.join(materialize(cut.select("sno", "c.cut_bin", "c.before"), "cuts"), "sno", "left")

    order = Window.partitionBy("sno").orderBy("q", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    inside = with_cut.where("bin = cut_bin").withColumn("fits", F.col("before") + F.sum("size").over(order) <= F.col("gap"))
    others = with_cut.where("cut_bin is null or bin <> cut_bin").withColumn("fits", F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)))
    marked = materialize(others.unionByName(inside).drop("cut_bin", "before"), "marked")
    lack = marked.groupBy("sno").agg((F.first("gap") - F.sum(F.when(F.col("fits"), F.col("size")).otherwise(0))).alias("lack"))
    return marked, materialize(lack, "lack")


def _greedy(rows: pd.DataFrame) -> pd.DataFrame:
    """Of about STRETCH rows of a source those that are taken in order, others being passed over."""
    rows = rows.sort_values(["q", "id", "text_hash", "row"])
    lack, taken = float(rows["lack"].iat[0]), []
    for size in rows["size"]:
        taken.append(size <= lack)
        lack -= size if taken[-1] else 0
    return rows.loc[taken, ["sno", "row", "size"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, ceiling: float = CEILING, seed: int = 7, bins: int = BINS) -> DataFrame:
    """(id, text_hash, source, size, source_size, target, copies, taken): one row per document."""
    sized = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("text_hash"),
            F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), F.col(text_col)).alias("draw"),
        ),
        "sized",
    )
    sources = materialize(source_targets(sized, weights, ceiling), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.select("sno", F.col("source").alias("of"), "source_size", "target", F.floor(ratio + F.lit(1e-9)).alias("sure"))
    sources = sources.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("sure") * F.col("source_size")))
    sources = materialize(_with_factor(sized, sources), "factors")

    u = (F.shiftrightunsigned("draw", 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    known = sized.join(sources, sized["source"].eqNullSafe(sources["of"])).drop("of")
    p = chance(F.col("size"), F.col("factor"))
    rank = F.when((F.col("rest") <= 0) | (F.col("size") == 0), None).when(p >= 1, 0.0).otherwise(u / (1 - u) / (p / (1 - p)))
    bin_of = F.when(p >= 1, -1).otherwise(F.floor(F.col("q") / (1 + F.col("q")) * bins)).cast("int")
    known = known.withColumn("q", rank).withColumn("bin", bin_of).drop("factor")
    known = materialize(known.drop("draw").withColumn("row", F.monotonically_increasing_id()), "known")

    marked, lacks = _fill(known.where("q is not null").withColumn("gap", F.col("rest")))
    waiting = marked.where("not fits and size > 0").select("sno", "row", "q", "bin", "id", "text_hash", "size")
    later: list[DataFrame] = []
    while True:
        fitting = materialize(waiting.join(lacks, "sno").where("size <= lack"), "fitting")
        # The bins of the first STRETCH documents of each source.
        counts = fitting.groupBy("sno", "bin").agg(F.count("*").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy("sno").orderBy("bin")) - F.col("n")
        cut = counts.withColumn("ahead", ahead).where(F.col("ahead") < STRETCH).groupBy("sno").agg(F.max("bin").alias("last_bin"))
        some = fitting.join(cut, "sno").where("bin <= last_bin")
        took = materialize(some.groupBy("sno").applyInPandas(_greedy, "sno long, row long, size long"), "took")
        if took.isEmpty():  # the first that fits is always taken
            break
        later.append(took.select("row"))
        words = took.groupBy("sno").agg(F.sum("size").alias("words"))
        lacks = materialize(lacks.join(words, "sno", "left").select("sno", (F.col("lack") - F.coalesce("words", F.lit(0))).alias("lack")), "lacks")
        waiting = fitting.join(took.select("row"), "row", "left_anti").drop("lack")
    if later:
        also = reduce(DataFrame.unionByName, later).withColumn("also", F.lit(True))
        marked = marked.join(also, "row", "left").withColumn("fits", F.col("fits") | F.col("also").isNotNull()).drop("also")

    # One more document of those left may come nearest to what lacks.
    left = marked.where("not fits").join(lacks, "sno").where("size > 0 and abs(lack - size) < abs(lack)")
    best = left.groupBy("sno").agg(F.min(F.struct(F.abs(F.col("lack") - F.col("size")).alias("off"), "q", "id", "text_hash", "row")).alias("b"))
    best = materialize(best.select("sno", F.col("b.row").alias("best")), "fits")

    columns = ["id", "text_hash", "source", "size", "source_size", "target", "sure", "extra"]
    taken = F.col("fits") | F.coalesce(F.col("row") == F.col("best"), F.lit(False))
    out = marked.join(best, "sno", "left").withColumn("extra", taken).select(*columns)
    out = out.unionByName(known.where("q is null").withColumn("extra", F.lit(False)).select(*columns))
    copies = F.least(F.col("sure") + F.col("extra").cast("long"), F.lit(int(ceiling)).cast("long"))
    out = out.withColumn("copies", copies)
    return out.select("id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; ``copy_no`` (the first free of copy_no, copy_no_1, ...) counts from 1."""
    names = {c.lower() for c in docs.columns}
    counter = next(n for n in ("copy_no", *(f"copy_no_{i}" for i in range(1, len(names) + 2))) if n not in names)
    plan = mix(docs, id_col, text_col, **kwargs)
    source_col = kwargs.get("source_col", "source")
    keys = plan.groupBy(F.col("id").alias("k_id"), F.col("text_hash").alias("k_hash"), F.col("source").alias("k_source"))
    keys = keys.agg(F.min("copies").alias("low"), F.max("copies").alias("high"), F.sum("copies").alias("sum"), F.count("*").alias("rows"))
    rows = carried(docs, id=F.col(id_col), hash=F.xxhash64(text_col), source=F.col(source_col).cast("string"))
    joined = rows.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash")) & F.col("source").eqNullSafe(F.col("k_source")))
    plain = joined.where("low = high").select("row", F.col("low").alias("copies"))
    # Equal rows of which some are taken once more: the first ones.
    number = F.row_number().over(Window.partitionBy("k_id", "k_hash", "k_source").orderBy(F.lit(1)))
    uneven = joined.where("low <> high").withColumn("n", number)
    uneven = uneven.select("row", (F.col("low") + (F.col("n") <= F.col("sum") - F.col("low") * F.col("rows")).cast("long")).alias("copies"))
    both = plain.unionByName(uneven).where("copies > 0")
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy_no")).select("row.*", F.col("copy_no").alias(counter))
