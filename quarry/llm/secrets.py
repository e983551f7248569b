"""Secret scans with an incremental blob ledger, in SQL functions only.

Every version of every path is content-addressed by the SHA-256 of its text.
The ledger keeps one row per (blob, rule, rule version) that has been scanned,
with the spans found. A scan reads only the pairs that the ledger lacks, however
many paths or versions share the text, appends them to the ledger and joins the
findings back to all paths. A rule that gets a new version is scanned anew.

Matches are leftmost and do not overlap within a rule. Offsets are code points,
end exclusive; ties at one start are listed in the order of the rules. They come from the lengths of the matches and of the pieces
between them, summed in order, so a text with very many matches costs no more
than its length.

Defined results:
- null text: the empty text, which has no findings; very long texts: as above, and ``redact`` cuts them block by block;
- null path: allowed, such rows come back with a null path;
- repeated rows: each is returned, with the same findings; copies of a text are scanned once;
- empty table: empty result, the ledger stays as it was;
- other columns are not read by ``scan``; ``redact`` keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import carried
from quarry.session import fresh_path, materialize


@dataclass(frozen=True)
class Rule:
    """pattern: what is matched; group and least: the part whose length must reach the least."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: The base rules, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MARK = "[SECRET]"
#: Characters of a block of text when it is cut.
BLOCK = 4096


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    schema = "blob binary, kind string, version int, spans array<struct<start:long,stop:long>>"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _matches(text: Column, rule: Rule) -> Column:
    """Arrays of (gap before, length, tested length) for each match, or null where there is none."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern)
    lengths = F.arrays_zip(
        F.transform(F.slice(gaps, F.lit(1), F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        F.transform(tested, F.char_length).alias("tested"),
    )
    return F.when(F.rlike(text, F.lit(rule.pattern)), lengths)


def scan(docs: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, mark, kind, order, start, stop): the findings of all rows; new pairs are first added to the ledger.

    ``mark`` is the blob id; rows with findings appear once per finding.
    """
    spark = docs.sparkSession
    update_ledger(docs, ledger, text_col, rules)
    wanted = _rule_table(spark, rules)
    known = read_ledger(spark, ledger).where("size(spans) > 0").join(F.broadcast(wanted), ["kind", "version"])  # a few rows: the rules
    found = known.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order").alias("order"), s["stop"].alias("stop"), F.col("kind").alias("kind")))))).alias("found"))
    paths = docs.select(F.col(path_col).alias("path"), blob_id(F.col(text_col)).alias("blob"))
    return paths.join(found, "blob", "left").select("path", F.col("blob").alias("mark"), "found")


def _rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    return spark.createDataFrame([(r.kind, r.version, i) for i, r in enumerate(rules)], "kind string, version int, order int")


def update_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the (blob, rule version) pairs of docs that the ledger lacks and append them."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blobs = docs.select(blob_id(F.col(text_col)).alias("blob"), text.alias("text"))
    seen = read_ledger(spark, ledger)
    needs = [F.lit(True)] * len(rules)
    if not seen.isEmpty():
        wanted = _rule_table(spark, rules)
        done = seen.join(F.broadcast(wanted), ["kind", "version"]).groupBy("blob").agg(F.collect_set("order").alias("done"))
        blobs = blobs.join(done, "blob", "left").where(F.coalesce(F.size("done"), F.lit(0)) < len(rules))
        blobs = blobs.withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
        needs = [~F.array_contains("done", i) for i in range(len(rules))]
    distinct = blobs.distinct()  # copies of a text meet before the shuffle; scanned once
    per_rule = F.array(
        *[
            F.when(need, F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"), _matches(F.col("text"), r).alias("m")))
            for r, need in zip(rules, needs)
        ]
    )
    raw = distinct.select("blob", F.explode(F.filter(per_rule, lambda x: x.isNotNull())).alias("x")).select("blob", "x.kind", "x.version", "x.least", "x.m")
    raw = materialize(raw, "scanned")
    each = raw.where("m is not null").select("blob", "kind", "version", "least", F.posexplode("m").alias("i", "m"))
    so_far = Window.partitionBy("blob", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("m.gap").cast("long") + F.col("m.size")).over(so_far)
    placed = each.withColumn("stop", stop).where("m.tested >= least")
    placed = placed.select("blob", "kind", F.struct((F.col("stop") - F.col("m.size")).alias("start"), "stop").alias("s"))
    spans = placed.groupBy("blob", "kind").agg(F.sort_array(F.collect_list("s")).alias("spans"))
    rows = raw.select("blob", "kind", "version").join(spans, ["blob", "kind"], "left")
    none = F.array().cast("array<struct<start:long,stop:long>>")
    rows.select("blob", "kind", "version", F.coalesce("spans", none).alias("spans")).write.mode("append").parquet(ledger)


def describe(found: Column) -> Column:
    """kind:start:stop, comma-joined in order."""
    return F.array_join(F.transform(F.coalesce(found, F.array().cast(FOUND)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


FOUND = "array<struct<start:long,order:int,stop:long,kind:string>>"


def redact(docs: DataFrame, ledger: str | None = None, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = MARK) -> DataFrame:
    """docs with every finding replaced by the mark; overlapping findings become one mark."""
    ledger = ledger or fresh_path(docs.sparkSession, "ledger")
    found = scan(docs, ledger, path_col, text_col, rules).where("found is not null").select(F.col("mark").alias("blob"), "found").dropDuplicates(["blob"])
    rows = carried(docs, blob=blob_id(F.col(text_col)), text=F.coalesce(F.col(text_col), F.lit("")))
    joined = rows.join(_gaps(found), "blob", "left")
    blocks = F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % BLOCK), F.lit(0))
    pieces = F.array_join(F.transform("gaps", lambda g: _piece(F.col("blocks"), g["start"], g["stop"])), mark)
    cut = joined.withColumn("blocks", F.when(F.col("gaps").isNotNull(), blocks))
    changed = F.when(F.col("gaps").isNotNull(), pieces).otherwise(F.col("row").getField(text_col))
    return cut.select(F.col("row").withField(text_col, changed).alias("row")).select("row.*")


def _gaps(found: DataFrame) -> DataFrame:
    """(blob, gaps): what lies before, between and after the findings of each text, overlapping ones taken together."""
    spans = found.select("blob", F.explode("found").alias("s")).select("blob", "s.start", "s.stop")
    before = Window.partitionBy("blob").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.withColumn("upto", F.coalesce(F.max("stop").over(before), F.lit(0).cast("long")))
    last = spans.groupBy("blob").agg(F.max("stop").alias("start")).select("blob", "start", F.lit(None).cast("long").alias("stop"))
    gaps = ends.where("start >= upto").select("blob", F.col("upto").alias("start"), F.col("start").alias("stop")).unionByName(last)
    return gaps.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("gaps"))


def _piece(blocks: Column, start: Column, stop: Column) -> Column:
    """The text from start to stop (null: its end). Only the blocks it touches are read, so many findings cost no more than the text."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.coalesce(F.floor((stop - 1) / BLOCK).cast("int"), F.size(blocks) - 1)
    cut = F.transform(
        F.slice(blocks, first + 1, F.greatest(F.lit(0), last - first + 1)),
        lambda x, i: F.substring(x, F.when(i == 0, start % BLOCK).otherwise(0).cast("int") + 1, F.when(stop.isNotNull() & (i == last - first), stop - last.cast("long") * BLOCK).otherwise(BLOCK).cast("int") - F.when(i == 0, start % BLOCK).otherwise(0).cast("int")),
    )
    return F.when(F.coalesce(stop > start, F.lit(True)), F.array_join(cut, "")).otherwise("")
