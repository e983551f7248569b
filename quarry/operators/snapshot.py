"""Snapshots: content hashes, manifests, diffs, coverage, status checks, saved searches and replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHED = ("abstract", "status", "title", "track", "venue", "year")
DISPLAY = ("title", "abstract", "venue", "year", "track", "status")


def content_hash(columns: tuple[str, ...] = HASHED) -> Column:
    """sha256 of canonical JSON: keys sorted, no spaces, nulls kept, control characters in lower-case hex."""
    json = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    lower = json
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):  # an escape follows an even number of backslashes
        lower = F.regexp_replace(lower, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return F.sha2(F.when(json.rlike(r"\\u00[01][A-F]"), lower).otherwise(json), 256)


def snapshot_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("venue", "year", "track", "status").agg(F.count("*").alias("n"), F.count_if(F.col("abstract").isNotNull()).alias("with_abstract"), F.sort_array(F.collect_set("source")).alias("sources"))


def crawl_windows(records: DataFrame, source: str = "source", at: str = "fetched_at") -> DataFrame:
    return records.groupBy(source).agg(F.min(at).alias("first"), F.max(at).alias("last"))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, change, fields): added, removed, changed (which fields) between two snapshots, in one full outer join."""
    left = a.select("id", F.struct(*DISPLAY).alias("was"))
    right = b.select("id", F.struct(*DISPLAY).alias("now"))
    both = left.join(right, "id", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"was.{f}").eqNullSafe(F.col(f"now.{f}")), F.lit(f)) for f in DISPLAY]))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.withColumn("change", kind).where("change is not null").select("id", "change", F.when(F.col("change") == "changed", F.array_join(changed, ",")).otherwise("").alias("fields"))


def rekeyed(a: DataFrame, b: DataFrame) -> DataFrame:
    """(old_id, new_id): a native id that stands alone on both sides under different record ids."""
    one = lambda t, n: t.where("native_id is not null").groupBy("native_id").agg(F.count("*").alias("n"), F.min("id").alias(n)).where("n = 1").drop("n")
    return one(a, "old_id").join(one(b, "new_id"), "native_id").where("old_id <> new_id").select("old_id", "new_id")


def coverage(records: DataFrame) -> DataFrame:
    """Totals of every cell, track, venue-year and venue and of the corpus, by rollup."""
    rolled = records.rollup("venue", "year", "track", "status").agg(F.count("*").alias("n"), F.count_if(F.col("abstract").isNull()).alias("missing_abstract"), F.grouping_id().alias("level"))
    return rolled.select("venue", "year", "track", "status", "n", "missing_abstract", F.col("level").cast("long").alias("level"))


def gate(cells: DataFrame, official: DataFrame, percent: int = 1) -> DataFrame:
    """(venue, year, track, indexed, official, delta, within): indexed against official counts, exact integers."""
    joined = cells.join(official, ["venue", "year", "track"], "left")
    delta = F.col("indexed") - F.col("official")
    return joined.select("venue", "year", "track", "indexed", "official", delta.alias("delta"), (F.abs(delta) * 100 <= F.col("official") * percent).alias("within"))


def unexpected_statuses(records: DataFrame, supplied: DataFrame) -> DataFrame:
    """(venue, year, status, n) whose status no source of that venue and year supplies. supplied: (source, status)."""
    sources = records.select("venue", "year", "source").distinct().join(supplied, "source").select("venue", "year", "status").distinct()
    return records.groupBy("venue", "year", "status").agg(F.count("*").alias("n")).join(sources, ["venue", "year", "status"], "left_anti")


def replay(saved: DataFrame, now: DataFrame) -> DataFrame:
    """(id, side): ids that left (removed) or joined (added) since a search was saved."""
    return saved.select("id").exceptAll(now.select("id")).withColumn("side", F.lit("removed")).unionByName(now.select("id").exceptAll(saved.select("id")).withColumn("side", F.lit("added")))


def removal_causes(removed: DataFrame, corpus: DataFrame, clauses: list[tuple[str, Column]]) -> DataFrame:
    """(id, cause): not_in_index, the first failing clause in order, or still_eligible."""
    joined = removed.select("id").join(corpus.withColumn("_here", F.lit(True)), "id", "left")
    cause = F.when(F.col("_here").isNull(), "not_in_index")
    for name, passes in clauses:
        cause = cause.when(~passes, name)
    return joined.select("id", cause.otherwise("still_eligible").alias("cause"))


def removal_tally(causes: DataFrame, names: list[str]) -> DataFrame:
    """(cause, n) with every cause present."""
    every = causes.sparkSession.createDataFrame([(n,) for n in names], "cause string")
    return every.join(causes.groupBy("cause").agg(F.count("*").alias("n")), "cause", "left").select("cause", F.coalesce("n", F.lit(0)).alias("n"))


def replay_status(same_index: bool, equal: dict[str, bool], changed: dict[str, str]) -> str:
    """reproduced or mismatch on the same index; on another one, drifted with what changed (corpus or method)."""
    if same_index:
        return "reproduced" if all(equal.values()) else "mismatch"
    return "drifted:" + ",".join(sorted(set(changed.values())))


def freeze(index, q: str, mode: str, path: str, record_id: str) -> DataFrame:
    """Save a search as evidence under path: its canonical form, hashes, totals and id list. Never overwrites."""
    found = index.parse(q, mode)
    total = index.totals(found).first()
    row = (record_id, q, mode, found.canonical, found.canonical_hash, found.identification_query, index.version, total["total"], total["removed"], index.ids_hash(found.effective).first()[0])
    schema = "record_id string, input string, mode string, canonical string, canonical_hash string, identification_query string, index_version string, total long, removed long, ids_hash string"
    spark = index.corpus.sparkSession
    spark.createDataFrame([row], schema).write.mode("errorifexists").parquet(f"{path}/{record_id}/record")
    index.match(found.effective).select("id").write.mode("errorifexists").parquet(f"{path}/{record_id}/ids")
    return spark.read.parquet(f"{path}/{record_id}/record")


def reopen(index, path: str, record_id: str) -> tuple[str, DataFrame]:
    """(status, ids that changed) of a saved search run again on an index."""
    spark = index.corpus.sparkSession
    saved = spark.read.parquet(f"{path}/{record_id}/record").first()
    found = index.parse(saved["canonical"])
    ids = spark.read.parquet(f"{path}/{record_id}/ids")
    now = index.match(found.effective).select("id")
    equal = {
        "ids_hash": index.ids_hash(found.effective).first()[0] == saved["ids_hash"],
        "canonical": found.canonical == saved["canonical"],
        "removed": index.totals(found).first()["removed"] == saved["removed"],
    }
    return replay_status(index.version == saved["index_version"], equal, {"index_version": "corpus"}), replay(ids, now)
