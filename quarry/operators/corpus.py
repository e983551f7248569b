"""The searchable corpus: records with tokens, padded text, vocabulary and field statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.tokens import with_tokens
from quarry.functions.vocab import TEXT_FIELDS

COMBO = ("venue", "year", "track", "status", "abstract_kind")
#: Ids whose statuses one packed row holds, two bits each; so many rows are broadcast (42 MB).
SPAN_BITS = 5
BROADCAST_SPANS = 1_000_000


def papers(spark: SparkSession, sf_dir: str, packed: bool = False) -> DataFrame:
    """Search records from the driver's documents and labels: one row per document. With ``packed`` labels come as a packed broadcast where they can, and texts are not shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    code = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(3)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("l_id"), code.alias("code"))
    spans = packed_codes(labels) if packed else None
    if spans is None:
        d = docs.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    else:
        d = docs.join(F.broadcast(spans), F.shiftright("doc_id", SPAN_BITS) == F.col("span"), "left").withColumn("code", F.expr(f"shiftright(codes, {_shift('doc_id')}) & 3"))
    cut = F.instr("text", "\n")
    rest = F.when(cut > 0, F.trim(F.expr("substring(text, instr(text, '\n') + 1)")))
    abstract = F.when(F.coalesce(rest, F.lit("")) != "", rest)
    place = F.col("doc_id") % 10
    track = F.when(place == 0, "workshop").when(place == 1, "position").when(place == 2, "datasets_benchmarks").when(place == 3, "unknown").when(place == 4, "competition").otherwise("main")
    status = F.when(F.col("code") == 1, "desk_rejected").when(F.col("code") == 2, "rejected").when(F.col("code") == 3, "accepted").otherwise("unknown")
    return d.select(
        F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        abstract.alias("abstract"),
        F.upper("lang").alias("venue"),
        (F.lit(2013) + F.col("doc_id") % 12).cast("int").alias("year"),
        track.alias("track"),
        status.alias("status"),
        F.when(abstract.isNull(), "none").when(F.col("doc_id") % 5 == 0, "openalex").otherwise("official").alias("abstract_kind"),
        "source",
    )


def packed_codes(labels: DataFrame) -> DataFrame | None:
    """(span, codes): the codes 1 to 3 of 32 neighbouring ids in one number, 0 for an id without a label; None if an id has two labels, or too few are neighbours."""
    ids = labels.where("l_id is not null")
    place, code = _shift("l_id"), "cast(code as bigint)"
    spans = ids.groupBy(F.shiftright("l_id", SPAN_BITS).alias("span")).agg(
        F.bit_or(F.expr(f"shiftleft({code}, {place})")).alias("codes"),
        F.count("*").alias("n"),
        F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, {place})"))).alias("ids"),
    )
    found = spans.agg(F.count("*").alias("spans"), F.count_if(F.col("n") > F.col("ids")).alias("twice")).first()
    return spans.select("span", "codes") if found["spans"] <= BROADCAST_SPANS and not found["twice"] else None


def _shift(name: str) -> str:
    """Where the two bits of an id begin, also of a negative one."""
    return f"cast(2 * ({name} & {(1 << SPAN_BITS) - 1}) as int)"


def tokenised(records: DataFrame) -> DataFrame:
    """records with tok_title, tok_abstract and the padded T_title, T_abstract. A missing abstract is the empty token list."""
    return with_tokens(records, TEXT_FIELDS)


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(field, term, df): in how many records of a field each term occurs."""
    sides = [corpus.select(F.lit(f).alias("field"), F.explode(F.array_distinct(F.col(f"tok_{f}"))).alias("term")) for f in ("title", "abstract")]
    return sides[0].unionByName(sides[1]).groupBy("field", "term").agg(F.count("*").alias("df"))


def field_stats(corpus: DataFrame) -> DataFrame:
    """(field, n, tokens, avg_len): records and mean length of each text field."""
    sides = [corpus.select(F.lit(f).alias("field"), F.size(f"tok_{f}").cast("long").alias("len")) for f in ("title", "abstract")]
    return sides[0].unionByName(sides[1]).groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("tokens"), F.avg("len").alias("avg_len"))


#: Folders over which postings are spread.
BUCKETS = 64


def bucket(term: Column) -> Column:
    return (F.crc32(term) % BUCKETS).cast("int")


def postings(corpus: DataFrame) -> DataFrame:
    """(bucket, term, field, id, venue, year, positions): the inverted index with positions."""
    sides = [corpus.select("id", "venue", "year", F.lit(f).alias("field"), F.posexplode(F.col(f"tok_{f}")).alias("pos", "term")) for f in TEXT_FIELDS]
    found = sides[0].unionByName(sides[1]).groupBy("term", "field", "id", "venue", "year").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return found.select(bucket(F.col("term")).alias("bucket"), "term", "field", "id", "venue", "year", "positions")
