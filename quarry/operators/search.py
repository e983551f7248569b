"""The search engine: match sets, pages, facets, exclusion accounting, group counts, highlights.

An index is a folder: a tokenised corpus with its vocabulary and field
statistics, written once, and a manifest that says what it was made from. It can
be opened again, verified, and compared with a recount. A large corpus is laid
out by venue and year, so that filters prune it. With postings, a query whose
rarest required terms are few reads their postings first and only the records
they name; without, or for frequent terms, it scans the columns it needs. Every
operator returns a DataFrame; only pages, expansions and counts reach the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import sort_title
from quarry.functions.vocab import BM25, DEFAULT_STATUSES, DEFAULT_TRACKS, MAX_EXPANSIONS, TEXT_FIELDS, TOKENIZER_VERSION, Vocabulary
from quarry.operators.compile import admit, bm25, expand, of_word, predicate, required, scored_terms, weigh
from quarry.operators.corpus import COMBO, field_stats, postings, tokenised, vocabulary
from quarry.operators.ranking import global_rank
from quarry.plans.ast import And, Node, Not, Or
from quarry.plans.canonical import DEFAULTS, all_of, concept_groups, conjuncts, filter_of
from quarry.plans.parse import Result, parse
from quarry.session import discard, fresh_path

#: Rows from which a corpus is laid out by venue and year.
LAYOUT_ROWS = 2_000_000
#: How an index is compressed: it holds every text three times.
CODEC = "zstd"
#: Postings are read first if the rarest required terms stand in at most this share of the records; this many ids are broadcast (about 40 MB).
CANDIDATE_SHARE = 0.02
BROADCAST_IDS = 1_000_000
SORTS = ("relevance", "year_desc", "year_asc", "title")
DEFAULT_VALUES = {"track": DEFAULT_TRACKS, "status": DEFAULT_STATUSES}


class QueryError(ValueError):
    def __init__(self, result: Result) -> None:
        super().__init__("; ".join(f"{d.code}: {d.message}" for d in result.errors))
        self.result = result


class IndexMismatch(ValueError):
    """An index that another version wrote, or whose files are not what its manifest says."""


def index_version(snapshot_hash: str) -> str:
    inputs = {"ranking": sorted(BM25.items()), "snapshot": snapshot_hash, "tokenizer": TOKENIZER_VERSION}
    return hashlib.sha256(json.dumps(inputs, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


@dataclass
class Index:
    corpus: DataFrame
    vocab: DataFrame
    stats: DataFrame
    values: Vocabulary
    version: str
    path: str = ""
    postings: DataFrame | None = None
    manifest: dict = field(default_factory=dict)

    @staticmethod
    def build(records: DataFrame, values: Vocabulary | None = None, snapshot_hash: str = "", path: str | None = None, with_postings: bool = False, replaces: DataFrame | None = None) -> Index:
        """Tokenise once and write; later queries scan only the columns they need. ``replaces`` is a materialized table that nothing reads once the corpus is written: it is deleted."""
        spark = records.sparkSession
        path = path or fresh_path(spark, "index")
        writer = tokenised(records).write.mode("errorifexists").option("compression", CODEC)
        (writer.partitionBy("venue", "year") if _is_large(records) else writer).parquet(f"{path}/corpus")
        discard(replaces)
        corpus = spark.read.parquet(f"{path}/corpus")
        vocabulary(corpus).write.parquet(f"{path}/vocab", compression=CODEC)
        field_stats(corpus).write.parquet(f"{path}/stats")
        if with_postings:
            found = postings(corpus)
            found.repartition("bucket").sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{path}/postings", compression=CODEC)
        values = values or Vocabulary()
        manifest = {"version": index_version(snapshot_hash), "tokenizer": TOKENIZER_VERSION, "snapshot": snapshot_hash, "postings": with_postings, "values": {k: list(v) for k, v in values.values.items()}, **_sums(corpus)}
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.parquet(f"{path}/manifest")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, verify: bool = False) -> Index:
        """The index in a folder; one that another tokeniser wrote is refused, and with ``verify`` one whose corpus changed."""
        manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()[0])
        if manifest["tokenizer"] != TOKENIZER_VERSION or manifest["version"] != index_version(manifest["snapshot"]):
            raise IndexMismatch(f"the index in {path} was made by version {manifest['version']}, tokenizer {manifest['tokenizer']}")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        v = manifest["values"]
        values = Vocabulary(*(tuple(v[k]) for k in ("venue", "track", "status", "abstract_kind")))
        found = Index(read("corpus"), read("vocab"), read("stats"), values, manifest["version"], path, read("postings") if manifest["postings"] else None, manifest)
        if verify and (now := _sums(found.corpus)) != {k: manifest[k] for k in now}:
            raise IndexMismatch(f"the corpus in {path} holds {now['records']} records, {manifest['records']} were written")
        return found

    def parity(self) -> DataFrame:
        """(field, term, df, recount): terms whose stored document frequency is not what the corpus holds; none if all is well."""
        again = vocabulary(self.corpus).withColumnRenamed("df", "recount")
        both = self.vocab.join(again, ["field", "term"], "full_outer")
        return both.where(~F.col("df").eqNullSafe(F.col("recount"))).select("field", "term", "df", "recount")

    def records(self, ids: DataFrame) -> DataFrame:
        """The records of some ids (a column ``id``): random access."""
        return self.corpus.join(ids.select("id").distinct(), "id", "left_semi")

    def record(self, record_id: str) -> dict | None:
        """One record, or None; the scan is pushed to the files."""
        found = self.corpus.where(F.col("id") == record_id).drop("tok_title", "tok_abstract", "T_title", "T_abstract").first()
        return found.asDict() if found else None

    def token_streams(self, ids: DataFrame | None = None) -> DataFrame:
        """(id, field, pos, term): the stored token streams, of some ids or all."""
        rows = self.corpus if ids is None else self.records(ids)
        sides = [rows.select("id", F.lit(f).alias("field"), F.posexplode(f"tok_{f}").alias("pos", "term")) for f in TEXT_FIELDS]
        return sides[0].unionByName(sides[1])

    def ranks(self) -> DataFrame:
        """(id, ord, title_rank): places in the order of ids, and of folded titles with ids breaking ties."""
        by_id = global_rank(self.corpus.select("id"), ["id"], "ord")
        by_title = global_rank(self.corpus.select("id", sort_title(F.col("title")).alias("t")), ["t", "id"], "title_rank").select("id", "title_rank")
        return by_id.join(by_title, "id")

    def count_value(self, ids: DataFrame, name: str, value: str | int) -> int:
        """How many of some ids have a value in a filter field; ids that the index lacks count as none."""
        if name not in COMBO:
            raise ValueError(f"{name} is no filter field")
        return self.records(ids).where(F.col(name) == value).count()

    def meta(self) -> dict:
        """What the index is: its manifest, and the counts that its statistics hold."""
        return {**self.manifest, "fields": {r["field"]: {"n": r["n"], "avg_len": r["avg_len"]} for r in self.stats.collect()}}

    # -- queries -----------------------------------------------------------------------------------------
    def parse(self, q: str, mode: str = "native") -> Result:
        found = parse(q, mode, self.values)
        if not found.ok:
            raise QueryError(found)
        admit(found.effective, self.corpus)
        return found

    def expansions(self, tree: Node | None) -> dict[tuple[str, str], list[str]]:
        return expand(self.vocab, tree)

    def match(self, q: str | Node | None, mode: str = "native", limit: int | None = MAX_EXPANSIONS) -> DataFrame:
        """The matching records. Wildcards are expanded first, so a refusal never depends on the rows; without a limit none is refused."""
        tree = self.parse(q, mode).effective if isinstance(q, str) else q
        if limit is not None:
            expand(self.vocab, tree, limit)
        held = self.candidates(tree)
        if held is None:
            return self.corpus.where(predicate(tree))
        return self.corpus.join(held, [c for c in held.columns], "left_semi").where(predicate(tree))

    def candidates(self, tree: Node | None) -> DataFrame | None:
        """(id, venue, year) of a superset of the matches, from postings; None where a scan reads less."""
        if self.postings is None or tree is None:
            return None
        weights = weigh(self.vocab, tree)
        weight = lambda some: sum(weights[w][0] for w in some if w in weights)
        asked = required(tree, weight)
        if not asked:
            return None
        best = min(asked, key=weight)
        if weight(best) > CANDIDATE_SHARE * self.manifest["records"]:
            return None
        words = sorted(w for w in best if w in weights)  # the others occur nowhere
        spots = sorted(frozenset().union(*(weights[w][1] for w in words)))
        held = self.postings.where(F.col("bucket").isin(spots) & reduce(lambda a, b: a | b, map(of_word, words), F.lit(False)))
        held = held.select("id", "venue", "year").distinct()
        return F.broadcast(held) if weight(best) <= BROADCAST_IDS else held

    def count(self, q: str | Node | None, mode: str = "native") -> int:
        return self.match(q, mode).count()

    def page(self, q: str, sort: str = "relevance", offset: int = 0, limit: int = 50, mode: str = "native") -> DataFrame:
        """(id, score, title, venue, year, …) of one page of a total order that ends in id."""
        if sort not in SORTS or offset < 0 or limit < 0:
            raise ValueError("sort must be one of " + ", ".join(SORTS) + "; offset and limit not negative")
        tree = self.parse(q, mode).effective
        scored = self.match(tree).withColumn("score", self.score(tree))
        order = {
            "relevance": [F.desc("score"), F.asc("id")],
            "year_desc": [F.desc("year"), F.asc("id")],
            "year_asc": [F.asc("year"), F.asc("id")],
            "title": [F.asc(sort_title(F.col("title"))), F.asc("id")],
        }[sort]
        return scored.orderBy(*order).offset(offset).limit(limit).select("id", "score", "title", "abstract", *COMBO)

    def score(self, tree: Node | None):
        expansions = expand(self.vocab, tree)
        wanted = sorted({t for t, _ in scored_terms(tree, expansions)})
        df = {(r["field"], r["term"]): r["df"] for r in self.vocab.where(F.col("term").isin(wanted)).collect()} if wanted else {}  # two rows a query term
        stats = {r["field"]: (r["n"], r["avg_len"] or 1.0) for r in self.stats.collect()}
        return F.round(bm25(tree, expansions, df, stats), 9)

    def combos(self, tree: Node | None) -> DataFrame:
        """How many matches have each combination of filter values: the small cube behind facets and exclusions."""
        return self.corpus.where(predicate(tree)).groupBy(*COMBO).agg(F.count("*").alias("n"))

    def facets(self, tree: Node | None) -> DataFrame:
        """(field, value, n): each field counted without its own top-level filters, in one scan of the corpus."""
        parts = conjuncts(tree)
        base = all_of(c for c in parts if not filter_of(c))
        cube = self.combos(base).coalesce(1)  # at most one row per combination of values: no more shuffles
        filters = [c for c in parts if filter_of(c)]
        sides = []
        for f in COMBO:
            others = all_of(c for c in filters if filter_of(c).field != f)
            ok = predicate(others)
            sides.append(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.when(ok, F.col("n")).otherwise(0).alias("n")))
        each = cube.select(F.explode(F.array(*sides)).alias("x")).select("x.*")
        return each.groupBy("field", "value").agg(F.sum("n").alias("n")).where("n > 0").orderBy("field", "value")

    def exclusions(self, found: Result) -> DataFrame:
        """(field, value, n): records that only the default filters remove, track first, then status; unknown is always listed."""
        cube = self.combos(found.identification).coalesce(1)  # as above
        bucket, value = F.lit(None).cast("string"), F.lit(None).cast("string")
        for f in reversed([f for f in DEFAULTS if f in found.defaults]):
            outside = ~F.col(f).isin(list(DEFAULT_VALUES[f]))
            bucket, value = F.when(outside, F.lit(f)).otherwise(bucket), F.when(outside, F.col(f)).otherwise(value)
        removed = cube.select(bucket.alias("field"), value.alias("value"), "n").where("field is not null").groupBy("field", "value").agg(F.sum("n").alias("n"))
        listed = [F.struct(F.lit(f).alias("field"), F.lit("unknown").alias("value"), F.lit(0).cast("long").alias("n")) for f in found.defaults or ("track",)]
        always = cube.sparkSession.range(1).select(F.inline(F.array(*listed)))
        shaped = removed.unionByName(always).coalesce(1).groupBy("field", "value").agg(F.sum("n").alias("n"))
        return shaped.orderBy("field", F.col("value") == "unknown", F.desc("n"), "value")

    def totals(self, found: Result) -> DataFrame:
        """(total, identified, removed, unclassified) in one scan."""
        kept, known = predicate(found.effective), predicate(found.identification)
        unknown = reduce(lambda a, b: a | b, [F.col(f) == "unknown" for f in found.defaults], F.lit(False))
        return self.corpus.agg(
            F.count_if(kept).alias("total"),
            F.count_if(known).alias("identified"),
            F.count_if(known & ~kept).alias("removed"),
            F.count_if(known & ~kept & unknown).alias("unclassified"),
        )

    def group_counts(self, tree: Node) -> DataFrame:
        """(group_no, alone, without): each concept group's matches alone and the matches without it, all in one aggregate."""
        groups, kept = concept_groups(tree)
        tests = {f"g{i}": predicate(g) for i, g in enumerate(groups)}
        flags = self.corpus.select(predicate(all_of(kept)).alias("kept"), *[t.alias(k) for k, t in tests.items()])
        sums = []
        for i in range(len(groups)):
            rest = [F.col(f"g{j}") for j in range(len(groups)) if j != i]
            sums += [F.count_if(F.col("kept") & F.col(f"g{i}")).alias(f"a{i}"), F.count_if(reduce(lambda a, b: a & b, rest, F.col("kept"))).alias(f"w{i}")]
        row = flags.agg(*sums)
        return row.select(F.inline(F.array(*[F.struct(F.lit(i).alias("group_no"), F.col(f"a{i}").alias("alone"), F.col(f"w{i}").alias("without")) for i in range(len(groups))])))

    def ids_hash(self, tree: Node | None) -> DataFrame:
        """One row: sha256 of the sorted ids joined by newlines. The sorted ids stream through one task, which holds a batch of them."""

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, first = hashlib.sha256(), True
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    h.update((b"" if first else b"\n") + i.encode())
                    first = False
            yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["ids_hash"])

        hashed = self.match(tree).select("id").orderBy("id").coalesce(1).mapInArrow(digest, "ids_hash string")
        return hashed.agg(F.coalesce(F.max("ids_hash"), F.sha2(F.lit(""), 256)).alias("ids_hash"))  # no partition, no row: nothing matched

    def explain(self, q: str, mode: str = "native") -> str:
        """The tree, its expansions and Spark's plan."""
        found = self.parse(q, mode)
        lines = [found.canonical, *_outline(found.effective, 0)]
        lines += [f"{s}{o}: {', '.join(t)}" for (s, o), t in self.expansions(found.effective).items()]
        lines.append(self.corpus.where(predicate(found.effective))._jdf.queryExecution().toString())
        return "\n".join(lines)


def _is_large(records: DataFrame) -> bool:
    """Whether there are LAYOUT_ROWS records; counting stops there."""
    return records.select("id").limit(LAYOUT_ROWS).count() >= LAYOUT_ROWS


def _sums(corpus: DataFrame) -> dict:
    """What a corpus holds: its records, and a sum of hashes that any change of a token changes."""
    row = corpus.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("id", "T_title", "T_abstract")), F.lit(0)).alias("x")).first()
    return {"records": row["n"], "digest": row["x"]}


def _outline(n: Node, depth: int) -> list[str]:
    pad = "  " * depth
    if isinstance(n, (And, Or)):
        return [pad + type(n).__name__] + [x for c in n.children for x in _outline(c, depth + 1)]
    if isinstance(n, Not):
        return [pad + "Not", *_outline(n.child, depth + 1)]
    return [pad + repr(n)]
