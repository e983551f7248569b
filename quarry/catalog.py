"""Registered queries of classification, attribution, sources, snapshots and index upkeep, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vocab import TEXT_SOURCES
from quarry.operators import attribution, classify, resolve
from quarry.operators.corpus import papers
from quarry.operators.search import CODEC, Index
from quarry.plans.diagnose import cost_of_counting, terms_read, verified_clauses
from quarry.plans.edit import filter_clauses, word_forms
from quarry.queries import ALL, SEARCHES, VALUES, VOCAB, W, index, tree
from quarry.session import fresh_path, materialize
from quarry.sources import cache, crawled, snapshots

# -- classification ------------------------------------------------------------------------------------------
ORGS = ("NeurIPS", "ICLR", "ICML", "AAAI")
PATHS = (
    "Conference", "Conference/Submission", "Conference/Rejected_Submission", "Conference/Withdrawn_Submission", "Conference/Desk_Rejected_Submission", "Conference/Blind_Submission",
    "Track/Datasets_and_Benchmarks", "Track/Datasets_and_Benchmarks/Round1", "Datasets_and_Benchmarks_Track", "Datasets_and_Benchmarks_Track/Rejected_Submission", "Position_Paper_Track",
    "Competition_Track", "Track/Competition", "Evaluations_and_Datasets_Track", "TinyPapers", "BlogPosts", "Workshop/SafeAI", "Workshop/Rejected", "Workshop_X/Submission", "Creative_AI_Track",
    "Conference/-/Submission", "Submission", "Conference//X", "Other/Thing",
)


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id")


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def venueid_classes(spark, d):
    n = F.col("doc_id")
    text = F.concat_ws("/", F.concat(_pick(ORGS, n % 4), F.lit(".cc")), (F.lit(2012) + F.floor(n / 4) % 16).cast("string"), _pick(PATHS, F.floor(n / 7) % len(PATHS)))
    rows = _documents(spark, d).select("doc_id", text.alias("venueid"))
    return rows.select("doc_id", "venueid", classify.venue_id(F.col("venueid")).alias("v"), classify.creative(F.col("venueid"), F.lit(2023)).alias("creative")).select("doc_id", "venueid", "v.*", "creative")


_VENUEID_SQL = f"""WITH a AS (SELECT doc_id, ({_sql_list(ORGS)})[doc_id % 4 + 1] AS org, CAST(2012 + (doc_id // 4) % 16 AS INTEGER) AS y, ({_sql_list(PATHS)})[(doc_id // 7) % {len(PATHS)} + 1] AS rest FROM documents),
b AS (SELECT *, string_split(rest, '/') AS s FROM a),
c AS (SELECT *, len(s) > 1 AND (lower(s[-2]) = 'workshop' OR starts_with(lower(s[-2]), 'workshop_')) AS named, s[-1] IN ('Submission', 'Rejected_Submission', 'Withdrawn_Submission', 'Desk_Rejected_Submission', 'Blind_Submission') AS stated FROM b),
e AS (SELECT *, stated AND NOT named AS suffixed, CASE WHEN stated AND NOT named THEN s[1:len(s) - 1] ELSE s END AS p FROM c),
f AS (SELECT *, org <> 'AAAI' AND y >= 2013 AND rest NOT IN ('Conference/-/Submission', 'Submission', 'Conference//X') AS parsed, array_to_string(p, '/') AS path, list_bool_or([lower(x) = 'workshop' OR starts_with(lower(x), 'workshop_') FOR x IN p]) AS workshop FROM e),
g AS (SELECT f.*, CASE WHEN workshop THEN 'workshop' ELSE coalesce(t.track, 'other') END AS tr FROM f LEFT JOIN (VALUES {", ".join(f"('{o}', '{p}', '{t}', {a}, {z})" for o, p, t, a, z in classify.TRACK_PATHS)}) t(o, p2, track, lo, hi) ON (t.o = '' OR t.o = org) AND p2 = path AND y BETWEEN lo AND hi)
SELECT doc_id, org || '.cc/' || CAST(y AS VARCHAR) || '/' || rest AS venueid, CASE WHEN parsed THEN tr ELSE 'unknown' END AS track,
CASE WHEN NOT parsed OR (org = 'ICLR' AND y <= 2023) OR (org = 'NeurIPS' AND y IN (2021, 2022)) THEN 'unknown' WHEN suffixed THEN CASE s[-1] WHEN 'Rejected_Submission' THEN 'rejected' WHEN 'Withdrawn_Submission' THEN 'withdrawn' WHEN 'Desk_Rejected_Submission' THEN 'desk_rejected' ELSE 'unknown' END WHEN tr = 'other' THEN 'unknown' ELSE 'accepted' END AS status,
CASE WHEN parsed THEN org END AS venue, CASE WHEN parsed THEN y END AS year, parsed, org = 'NeurIPS' AND y = 2023 AND rest = 'Creative_AI_Track' AS creative FROM g"""
STRINGS = (*classify.VENUE_STRINGS, "ICLR 2020 Oral", "neurips 2021 oral", "", None)
_STRING_ROWS = ", ".join(f"('{k}', '{t}', '{s}', '{v}', {y})" for k, (v, y, t, s) in classify.VENUE_STRINGS.items())


def venue_string_classes(spark, d):
    rows = _documents(spark, d).select("doc_id", _pick(STRINGS, F.col("doc_id") % len(STRINGS)).alias("s"))
    return rows.select("doc_id", classify.venue_string(F.col("s")).alias("v")).select("doc_id", "v.*")


HOSTS = ("proceedings.neurips.cc", "papers.nips.cc", "datasets-benchmarks-proceedings.neurips.cc", "Proceedings.NeurIPS.cc", "example.org")
TOKENS = (None, "Conference", "Datasets_and_Benchmarks", "Datasets_and_Benchmarks_Track", "Position_Paper_Track", "Creative_AI_Track", "round1", "Workshop/X", "Unseen")


def listing_tracks(spark, d):
    n = F.col("doc_id")
    rows = _documents(spark, d).select("doc_id", _pick(HOSTS, n % 5).alias("h"), (F.lit(2019) + n % 7).cast("int").alias("y"), _pick(TOKENS, F.floor(n / 3) % 9).alias("t"))
    return rows.select("doc_id", classify.listing_track(F.col("h"), F.col("y"), F.col("t")).alias("v")).select("doc_id", "v.*")


_LISTING_SQL = f"""WITH a AS (SELECT doc_id, lower(({_sql_list(HOSTS)})[doc_id % 5 + 1]) AS h, 2019 + doc_id % 7 AS y, ({_sql_list(TOKENS)})[(doc_id // 3) % 9 + 1] AS t FROM documents),
b AS (SELECT *, h IN ('proceedings.neurips.cc', 'papers.nips.cc') AS main, CASE t WHEN 'Conference' THEN 'main' WHEN 'Datasets_and_Benchmarks' THEN 'datasets_benchmarks' WHEN 'Datasets_and_Benchmarks_Track' THEN 'datasets_benchmarks' WHEN 'Position_Paper_Track' THEN 'position' WHEN 'Creative_AI_Track' THEN 'other' WHEN 'Workshop/X' THEN 'workshop' ELSE 'unknown' END AS named FROM a)
SELECT doc_id, CASE WHEN starts_with(h, 'datasets') THEN CASE WHEN y = 2021 AND t = 'round1' THEN 'datasets_benchmarks' ELSE 'unknown' END WHEN NOT main THEN 'unknown' WHEN t IS NULL THEN CASE WHEN y <= 2021 THEN 'main' ELSE 'unknown' END WHEN t = 'Datasets_and_Benchmarks' AND y > 2023 THEN 'unknown' ELSE named END AS track,
CASE WHEN starts_with(h, 'datasets') THEN CASE WHEN y = 2021 AND t = 'round1' THEN 'host and round' ELSE 'no rule' END WHEN NOT main THEN 'no proceedings host' WHEN t IS NULL THEN CASE WHEN y <= 2021 THEN 'host and year' ELSE 'no rule' END WHEN t = 'Datasets_and_Benchmarks' THEN CASE WHEN y > 2023 THEN 'no rule' ELSE 'alias' END WHEN named = 'unknown' THEN 'no rule' ELSE 'token' END AS rule FROM b"""
_SHOWN = tuple((v, y, t, s, p) for v, y, t, strings in classify.PRESENTATIONS for s, p in strings.items())


def presentations(spark, d):
    n = F.col("doc_id")
    at = n % len(_SHOWN)
    track = F.when(n % 11 == 0, "workshop").otherwise(_pick(tuple(r[2] for r in _SHOWN), at))
    rows = _documents(spark, d).select("doc_id", _pick(tuple(r[0] for r in _SHOWN), at).alias("v"), _pick(tuple(r[1] for r in _SHOWN), at).alias("y"), track.alias("t"), F.concat(_pick(tuple(r[3] for r in _SHOWN), at), F.when(n % 13 == 0, "!").otherwise("")).alias("s"))
    return rows.select("doc_id", classify.presentation(F.col("v"), F.col("y"), F.col("t"), F.col("s")).alias("p")).select("doc_id", "p.*")


# -- attribution ---------------------------------------------------------------------------------------------
def _number() -> Column:
    return F.expr("cast(substring(id, 5) as bigint)")


def _abstract_claims(spark, d) -> DataFrame:
    p = papers(spark, d).where("abstract is not null").withColumn("n", _number())
    k = len(TEXT_SOURCES)
    sides = []
    for at, value in ((F.col("n") % k, F.when(F.col("n") % 4 == 0, "another text").otherwise(F.col("abstract"))), ((F.col("n") * 5 + 3) % k, F.col("abstract"))):
        source = _pick(TEXT_SOURCES, at)
        evidence = F.when(source == "ris", F.when(F.col("n") % 2 == 0, "tool:openreview_api x").otherwise(F.concat(F.lit("tool:proceedings_page https://proceedings.mlr.press/v"), (F.col("n") % 9).cast("string"), F.lit("/a1.html"))))
        sides.append(p.select(F.col("id").alias("record_id"), F.lit("abstract").alias("field"), source.alias("source"), value.alias("value"), F.concat(F.lit("https://src.example/"), "id").alias("url"), evidence.alias("evidence")))
    return sides[0].unionByName(sides[1])


def _attributed(spark, d) -> DataFrame:
    p = papers(spark, d).withColumn("n", _number())
    page = F.when(F.col("n") % 3 == 0, F.concat(F.lit("https://proceedings.mlr.press/v"), (F.col("n") % 9).cast("string"), F.lit("/a1.html")))
    records = p.select("id", "abstract", F.concat(F.lit("https://openreview.net/forum?id="), "id").alias("forum"), page.alias("proceedings"), F.concat(F.lit("pmlr-v"), (F.col("n") % 9).cast("string"), F.lit("-a1")).alias("native"))
    return attribution.attribution(records, _abstract_claims(spark, d))


def attributions(spark, d):
    return _attributed(spark, d)


_CLAIM_SQL = f"""claims AS (SELECT id AS record_id, doc_id AS n, unnest([({_sql_list(TEXT_SOURCES)})[doc_id % {len(TEXT_SOURCES)} + 1], ({_sql_list(TEXT_SOURCES)})[(doc_id * 5 + 3) % {len(TEXT_SOURCES)} + 1]]) AS source, unnest([doc_id % 4 <> 0, true]) AS holds FROM papers WHERE abstract IS NOT NULL),
best AS (SELECT record_id AS id, any_value(n) AS n, arg_min(source, list_position({_sql_list(TEXT_SOURCES)}, source)) AS source FROM claims WHERE holds GROUP BY record_id)"""
_ATTRIBUTION_SQL = f"""{W}, {_CLAIM_SQL}, x AS (SELECT *, 'https://openreview.net/forum?id=' || id AS forum, 'https://proceedings.mlr.press/v' || CAST(n % 9 AS VARCHAR) || '/a1.html' AS page FROM best)
SELECT id, source, CASE WHEN starts_with(source, 'openreview') THEN 'openreview' WHEN source = 'ris' THEN CASE WHEN n % 2 = 0 THEN 'openreview' ELSE 'pmlr' END WHEN source = 'dblp' THEN NULL ELSE source END AS origin,
CASE WHEN starts_with(source, 'openreview') THEN forum WHEN source = 'ris' THEN CASE WHEN n % 2 = 0 THEN forum ELSE page END WHEN source IN ('ojs', 'crossref', 'facct_site', 'openalex') THEN CASE WHEN n % 3 = 0 THEN page END WHEN source IN ('aaai_library', 'dblp') THEN NULL ELSE 'https://src.example/' || id END AS url, false AS as_submitted FROM x"""


def abstract_credit(spark, d):
    return attribution.credited(papers(spark, d), _abstract_claims(spark, d)).select("id", "source")


def window_kinds(spark, d):
    return attribution.window_kinds(_abstract_claims(spark, d), captures=["aaai_library"])


def entry_matches(spark, d):
    p = papers(spark, d).withColumn("title_key", resolve.title_key(F.col("title"))).withColumn("n", _number())
    entries = p.where("n % 3 = 0").select(F.concat(F.lit("e"), "id").alias("entry_id"), "title_key", (F.col("n") % 5 != 0).alias("usable"))
    return attribution.match_entries(p.where("n % 7 <> 0"), entries, "title_key")


def sampled_ids(spark, d):
    return attribution.deterministic_sample(papers(spark, d).select("id"), 100, 7)


def engine_disagreement(spark, d):
    i = index(spark, d)
    return attribution.disagreement(i.match("the" + ALL), i.match("and" + ALL))


def _merges(spark, d) -> DataFrame:
    """Each document but the first of five was merged into the one before it."""
    p = papers(spark, d).select(_number().alias("n"), "id").where("n % 5 <> 0")
    return p.select(F.concat(F.lit("doc:"), F.lpad((F.col("n") - 1).cast("string"), 8, "0")).alias("survivor_id"), F.col("id").alias("merged_id"))


def followed_merges(spark, d):
    return resolve.follow_merges(papers(spark, d), _merges(spark, d))


def takedown_problems(spark, d):
    p = papers(spark, d).withColumn("n", _number())
    listed = p.where("n % 4 = 0").select("id").unionByName(p.where("n % 8 = 0").select("id")).unionByName(spark.createDataFrame([("doc:gone",)], "id string"))
    return attribution.takedown_problems(listed, p.where("n % 5 = 0"), _merges(spark, d).where("merged_id < 'doc:00000500'"))


# -- scalar functions ----------------------------------------------------------------------------------------
def split_names(spark, d):
    """Authors made from each text's first words: listed, joined by "and", or too many for the count."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    word = lambda i: F.coalesce(F.nullif(F.get(w, F.lit(i)), F.lit("and")), F.lit("x"))
    n = F.col("doc_id") % 4
    entries = F.when(n == 0, F.array(word(0), word(1))).when(n == 1, F.array(F.concat(word(0), F.lit(" and "), word(1)))).when(n == 2, F.array(F.concat(word(0), F.lit(", "), word(1), F.lit(", and "), word(2)))).otherwise(F.array(word(0), F.concat(F.lit("and "), word(1))))
    rows = docs.select("doc_id", T.split_authors(entries, F.when(n == 2, 3).otherwise(F.when(F.col("doc_id") % 8 == 7, 5).otherwise(2))).alias("a"))
    return rows.select("doc_id", F.array_join("a.names", "|").alias("names"), "a.how")


OFFSETS = ("+00:00", "-05:00", "+05:30", "+14:00", "+14:30", "5:00", "-09:75")


def query_dates(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    rows = events.select("event_id", T.local_to_utc(local, _pick(OFFSETS, F.col("event_id") % len(OFFSETS))).alias("at"))
    return rows.select("event_id", F.unix_timestamp("at").alias("at"))


def native_names(spark, d):
    n = F.col("doc_id")
    sha = F.md5(n.cast("string"))
    urls = (
        F.concat(F.lit("https://proceedings.neurips.cc/paper_files/paper/2024/hash/"), sha),
        F.concat(F.lit("https://proceedings.iclr.cc/paper_files/paper/2024/hash/"), F.upper(sha), F.lit("/")),
        F.concat(F.lit("https://proceedings.mlr.press/v"), (n % 9).cast("string"), F.lit("/a1.html")),
        F.concat(F.lit("https://example.org/paper/2024/hash/"), sha),
    )
    names = (F.concat(F.lit("nips-"), sha), F.concat(F.lit("iclr-"), sha), F.concat(F.lit("pmlr-v"), (n % 9).cast("string"), F.lit("-a1")))
    rows = _documents(spark, d).select("doc_id", F.get(F.array(*urls), (n % 4).cast("int")).alias("u"), F.get(F.array(*names), (F.floor(n / 4) % 3).cast("int")).alias("k"))
    return rows.select("doc_id", T.names_native(F.col("u"), F.col("k")).alias("named"))


# -- index and snapshots -------------------------------------------------------------------------------------
_POSTED: dict[tuple[str, str], Index] = {}


def posted(spark, d) -> Index:
    key = (spark.sparkContext.applicationId, d)
    if key not in _POSTED:
        records = materialize(papers(spark, d), "papers", codec=CODEC)
        _POSTED[key] = Index.build(records, VALUES, with_postings=True, replaces=records)
    return _POSTED[key]


RARE = '"of lement*" OR whi* OR "les eaux$"'


def postings_search(spark, d):
    return posted(spark, d).match(RARE, limit=None).select("id")


def index_ranks(spark, d):
    return index(spark, d).ranks().select("id", "ord", "title_rank")


def index_parity(spark, d):
    """Terms with a wrong count are found: those that begin with "th" are given one too many."""
    i = index(spark, d)
    wrong = i.vocab.withColumn("df", F.col("df") + F.startswith("term", F.lit("th")).cast("long"))
    return replace(i, vocab=wrong).parity()


def token_streams(spark, d):
    return index(spark, d).token_streams().groupBy("id", "field").agg(F.count("*").alias("n"), F.min_by("term", "pos").alias("first"), F.max_by("term", "pos").alias("last"))


def count_value(spark, d):
    i = index(spark, d)
    ids = i.match("the" + ALL).select("id").unionByName(spark.createDataFrame([("doc:gone",)], "id string"))
    return spark.createDataFrame([(v, i.count_value(ids, "venue", v)) for v in ("EN", "FR", "XX")], "value string, n long")


def query_costs(spark, d):
    """Clauses that are verified by position, the terms that evaluating reads, and what counting the groups reads."""
    i, rows = index(spark, d), []
    for name in ("flagship", "phrase", "near", "near_self", "near_phrase", "and_or_not", "filter_venue"):
        t = tree(SEARCHES[name]).effective
        expansions = i.expansions(t)
        weight = lambda c: terms_read(c, expansions)  # noqa: B023, E731
        rows.append((name, len(verified_clauses(t)), weight(t), cost_of_counting(t, weight)))
    return spark.createDataFrame(rows, "name string, verified long, terms long, counting long")


def query_clauses(spark, d):
    """How each filter field stands in some queries: whether an interface may edit it, or why not."""
    rows = []
    for name in ("flagship", "phrase_wildcard", "filter_venue", "filter_track_default"):
        for field, c in filter_clauses(tree(SEARCHES[name])).items():
            shown = ",".join(c.values or [f"{r.lo}..{r.hi}" for r in c.ranges or ()])
            rows.append((name, field, c.toggleable, c.reason, shown))
    return spark.createDataFrame(rows, "name string, field string, editable boolean, reason string, shown string")


def query_words(spark, d):
    """Where "$" can be written after a word of a query."""
    rows = [(f.token, f.edit, f.reason) for f in word_forms(tree('models the ai 2020 "trust" risk'))]
    return spark.createDataFrame(rows, "token string, edit string, reason string")


def snapshot_round_trip(spark, d):
    """The cells of a snapshot's manifest beside those of its records, read back and verified."""
    path = fresh_path(spark, "snapshot")
    made = snapshots.write(papers(spark, d), path)
    stated = spark.createDataFrame([(c["venue"], c["year"], c["track"], c["status"], c["n"]) for c in made["counts"]], "venue string, year int, track string, status string, stated long")
    back = snapshots.read(spark, path).groupBy("venue", "year", "track", "status").agg(F.count("*").alias("n"), F.count("abstract").alias("with_abstract"))
    return back.join(stated, ["venue", "year", "track", "status"])


# -- sources: files made from the documents, read back ------------------------------------------------------------
def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\p{Cc}", " "), r"\s+", " "))


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(_plain(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _files(rows: DataFrame, value: Column, suffix: str, around: tuple[str, str] = ("", "")) -> str:
    """One text file per twenty rows; the path. value is a row's part, around what a file begins and ends with."""
    path = fresh_path(rows.sparkSession, f"cached-{suffix}")
    parts = rows.select((F.col("n") % F.lit(20)).alias("g"), "n", value.alias("v")).groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), "," if suffix == "json" else "\n").alias("v"))
    parts.repartition(8).select(F.concat(F.lit(around[0]), "v", F.lit(around[1])).alias("value")).write.option("lineSep", "\n").text(path)
    return path


def _numbered(spark, d) -> DataFrame:
    return papers(spark, d).withColumn("n", _number())


def _note(v2: bool) -> Column:
    wrap = (lambda c: F.struct(c.alias("value"))) if v2 else (lambda c: c)
    year = (F.lit(2019) + F.col("n") % 7).cast("string")
    venueid = F.concat(F.lit("NeurIPS.cc/"), year, F.lit("/"), _pick(("Conference", "Conference/Rejected_Submission", "Workshop/X"), F.col("n") % 3))
    content = F.struct(wrap(_plain(F.col("title"))).alias("title"), wrap(F.array(F.lit("A B"), F.col("source"))).alias("authors"), wrap(F.col("abstract")).alias("abstract"), wrap(F.concat(F.lit("NeurIPS "), year, _pick((" oral", " Submitted"), F.col("n") % 2))).alias("venue"), wrap(venueid).alias("venueid"))
    return F.to_json(F.struct(F.col("id").alias("id"), F.col("id").alias("forum"), F.col("n").alias("number"), content.alias("content")))


def _notes(spark, d, v2: bool) -> str:
    path = fresh_path(spark, "notes")
    rows = _numbered(spark, d).select((F.col("n") % 20).alias("g"), _note(v2).alias("v"))
    pages = rows.groupBy("g").agg(F.collect_list("v").alias("v"))
    pages.repartition(20, "g").select(F.concat(F.lit('{"notes": ['), F.array_join("v", ",\n"), F.lit('], "count": 1}')).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def cached_pages(spark, d):
    """Pages of several visits, some failed and one entry damaged: the newest good answer of every address, else the newest."""
    pages = spark.read.parquet(f"{d}/pages.parquet").withColumn("url", F.concat(F.lit("https://a.example/"), (F.col("page_id") % 60).cast("string")))
    path = fresh_path(spark, "cache")
    fetched = pages.select("url", F.when(F.col("page_id") % 7 == 0, 404).otherwise(200).alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("fetched_at"), F.col("html").alias("body"))
    cache.add(fetched, path)
    held = cache.read(spark, path).withColumn("body", F.when(F.unix_timestamp("fetched_at") % 11 == 0, "damaged").otherwise(F.col("body")))
    asked = spark.range(70).select(F.concat(F.lit("https://a.example/"), F.col("id").cast("string")).alias("url"))
    found = cache.lookup(asked, held).select("url", "status", F.unix_timestamp("fetched_at").alias("at"))
    return found.unionByName(cache.misses(asked, held).join(found, "url", "left_anti").select("url", F.lit(None).cast("int").alias("status"), F.lit(None).cast("long").alias("at")))


def notes_v2(spark, d):
    found = crawled.openreview_v2(spark, _notes(spark, d, True))
    return found.select(F.col("forum_id").alias("id"), "title", F.sha2("abstract", 256).alias("abstract"), F.array_join("authors", ";").alias("authors"), "track", "status", "year", "presentation")


def notes_v1(spark, d):
    found = crawled.openreview_v1(spark, _notes(spark, d, False))
    return found.select(F.col("forum_id").alias("id"), "title", F.array_join("authors", ";").alias("authors"), "authors_how", "track", "status", "year")


def proceedings_listing(spark, d):
    """A listing page per hundred documents, in the markup of a proceedings site."""
    item = F.concat(F.lit('<li><a title="paper" href="/paper_files/paper/2020/hash/'), F.md5("id"), F.lit('-Abstract.html">'), _escaped(F.col("title")), F.lit('</a> <span class="paper-authors">A B, '), F.col("source"), F.lit("</span></li>"))
    rows = _numbered(spark, d).select(F.floor(F.col("n") / 100).alias("g"), "n", item.alias("v"))
    pages = rows.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "v"))), lambda x: x["v"]), "\n").alias("v"))
    html = F.concat(F.lit('<html><body><ul><li><a href="/x-Abstract">no paper</a></li></ul><ul class="paper-list">'), "v", F.lit("<li>unlinked</li></ul></body></html>"))
    found = crawled.listing_entries(pages.select(F.concat(F.lit("https://proceedings.neurips.cc/paper/"), F.col("g").cast("string")).alias("url"), html.alias("html")), "neurips")
    return found.select("page_url", F.col("at").cast("long").alias("at"), "href", "title", F.array_join("authors", ";").alias("authors"))


def paper_pages(spark, d):
    html = F.concat(F.lit('<html><head><meta name="citation_title" content="'), F.replace(_escaped(F.col("title")), F.lit('"'), F.lit("&quot;")), F.lit('"><meta name="citation_author" content="A B"></head><body><div id="abstract" class="abstract">'), _escaped(F.col("abstract")), F.lit("</div></body></html>"))
    found = crawled.paper_pages(_numbered(spark, d).select(F.col("id").alias("url"), html.alias("html")), "pmlr")
    return found.select(F.col("url").alias("id"), "title", F.array_join("authors", ";").alias("authors"), F.sha2("abstract", 256).alias("abstract"))


def dblp_release(spark, d):
    record = F.concat(F.lit('<inproceedings mdate="2024-01-02" key="conf/'), F.when(F.col("n") % 3 == 0, "icml").otherwise("other"), F.lit("/"), "id", F.lit('">\n<author>M&uuml;ller</author>\n<author>'), F.col("source"), F.lit("</author>\n<title>"), _escaped(F.col("title")), F.lit("</title>\n<pages>1-9</pages>\n<year>"), F.col("year").cast("string"), F.lit("</year>\n<ee>https://doi.org/10.1/x</ee>\n</inproceedings>\n"))
    path = _files(_numbered(spark, d), record, "xml", ('<?xml version="1.0"?>\n<dblp>\n<article key="journals/x"><title>An article</title></article>\n', "</dblp>"))
    found = crawled.dblp(spark, path, "inproceedings", ("conf/icml/",))
    return found.select("key", "mdate", "title", F.array_join("authors", ";").alias("authors"), "year", "pages")


def oai_answers(spark, d):
    record = F.concat(F.lit("<record><header"), F.when(F.col("n") % 9 == 0, ' status="deleted"').otherwise(""), F.lit("><identifier>oai:ojs.example.org:article/"), F.col("n").cast("string"), F.lit("</identifier><setSpec>s:x</setSpec></header>"), F.when(F.col("n") % 9 == 0, "").otherwise(F.concat(F.lit('<metadata><oai_dc:dc><dc:title xml:lang="fr-FR">Autre</dc:title><dc:title xml:lang="en-US">'), _escaped(F.col("title")), F.lit("</dc:title><dc:creator>A B</dc:creator><dc:identifier>https://ojs.example.org/index.php/X/article/view/"), F.col("n").cast("string"), F.lit("</dc:identifier><dc:identifier>10.1609/x.v"), F.col("n").cast("string"), F.lit("</dc:identifier><dc:source>Proceedings; Vol. 34 No. 01</dc:source></oai_dc:dc></metadata>"))), F.lit("</record>"))
    path = _files(_numbered(spark, d), record, "oai", ("<OAI-PMH><ListRecords>", "</ListRecords></OAI-PMH>"))
    return crawled.oai_records(spark, path).select("article", "deleted", "title", "doi", F.col("volume").cast("long").alias("volume"), F.size("creators").cast("long").alias("creators"))


def crossref_answers(spark, d):
    path = fresh_path(spark, "works")
    item = F.to_json(F.struct(F.concat(F.lit(" 10.1/"), F.upper("id")).alias("DOI"), F.lit("proceedings-article").alias("type"), F.array(F.concat(F.lit("<i>"), _plain(F.col("title")), F.lit("</i>"))).alias("title"), F.array(F.when(F.col("n") % 2 == 0, "part two")).alias("subtitle"), F.array(F.struct(F.lit("Ada").alias("given"), F.col("source").alias("family")), F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"))).alias("author"), F.lit("1-9").alias("page")))
    pages = _numbered(spark, d).where("not title like '%<%'").select((F.col("n") % 20).alias("g"), item.alias("v")).groupBy("g").agg(F.collect_list("v").alias("v"))
    pages.repartition(20, "g").select(F.concat(F.lit('{"status":"ok","message-type":"work-list","message":{"items":['), F.array_join("v", ","), F.lit('],"total-results":1}}')).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return crawled.crossref_works(spark, path).select("doi", "title", F.array_join("authors", ";").alias("authors"), F.col("unnamed").cast("long").alias("unnamed"), "page")


_PLAIN_SQL = "trim(regexp_replace(regexp_replace(title, '\\p{Cc}', ' ', 'g'), '\\s+', ' ', 'g'))"
_Q = (
    venueid_classes, venue_string_classes, listing_tracks, presentations, attributions, abstract_credit, window_kinds, entry_matches, sampled_ids, engine_disagreement, followed_merges,
    takedown_problems, split_names, query_dates, native_names, postings_search, index_ranks, index_parity, token_streams, count_value, query_costs, query_clauses, query_words, snapshot_round_trip,
    cached_pages, notes_v2, notes_v1, proceedings_listing, paper_pages, dblp_release, oai_answers, crossref_answers,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _Q}


def oracles() -> dict[str, str]:
    from quarry.queries import _AND_KNOWN, _DEFAULT, _KEYED, _THE_KNOWN, _like

    shown = ", ".join(f"({i}, {'NULL' if p is None else repr(p)})" for i, (*_, p) in enumerate(_SHOWN))
    title_fold = "replace(lower(nfc_normalize(title)), 'ß', 'ss')"
    return {
        "venueid_classes": _VENUEID_SQL,
        "venue_string_classes": f"SELECT doc_id, coalesce(t.track, 'unknown') AS track, coalesce(t.status, 'unknown') AS status, t.venue, CAST(t.year AS INTEGER) AS year, t.venue IS NOT NULL AS parsed FROM documents LEFT JOIN (VALUES {_STRING_ROWS}) t(k, track, status, venue, year) ON t.k = ({_sql_list(STRINGS)})[doc_id % {len(STRINGS)} + 1]",
        "listing_tracks": _LISTING_SQL,
        "presentations": f"SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 <> 0 THEN p END AS value, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AS mapped FROM documents JOIN (VALUES {shown}) t(i, p) ON i = doc_id % {len(_SHOWN)}",
        "attributions": _ATTRIBUTION_SQL,
        "abstract_credit": f"{W}, {_CLAIM_SQL} SELECT id, source FROM best",
        "window_kinds": f"{W}, {_CLAIM_SQL}, s AS (SELECT DISTINCT source FROM claims) SELECT source AS \"window\", CASE source WHEN 'aaai_library' THEN 'archive_captures' WHEN 'ris' THEN 'scholar_query_dates' ELSE 'crawl' END AS kind FROM s UNION ALL SELECT '*', CASE WHEN NOT bool_or(source = 'ris') THEN 'crawl' WHEN bool_and(source = 'ris') THEN 'scholar_query_dates' ELSE 'mixed' END FROM s",
        "entry_matches": f"""{W}, {_KEYED}, e AS (SELECT 'e' || id AS entry_id, nullif(t, '') AS t, doc_id % 5 <> 0 AS usable, count(*) OVER (PARTITION BY nullif(t, '')) AS entries FROM keyed WHERE doc_id % 3 = 0),
p AS (SELECT t, count(*) AS papers, min(id) AS id FROM keyed WHERE doc_id % 7 <> 0 AND t <> '' GROUP BY t)
SELECT entry_id, CASE WHEN entries = 1 AND papers = 1 THEN p.id END AS id, CASE WHEN papers IS NULL THEN 'unmatched' WHEN entries > 1 OR papers > 1 THEN 'ambiguous' ELSE 'matched' END AS verdict FROM e LEFT JOIN p ON p.t = e.t WHERE usable""",
        "sampled_ids": f"{W} SELECT id FROM papers ORDER BY md5(id || ':7'), id LIMIT 100",
        "engine_disagreement": f"{W} (SELECT id, 'one' AS only_in FROM corpus WHERE {_THE_KNOWN} AND NOT {_AND_KNOWN}) UNION ALL (SELECT id, 'other' FROM corpus WHERE {_AND_KNOWN} AND NOT {_THE_KNOWN})",
        "followed_merges": f"{W} SELECT id, 'doc:' || lpad(CAST(doc_id - doc_id % 5 AS VARCHAR), 8, '0') AS survivor_id FROM papers",
        "takedown_problems": f"{W} SELECT id, CASE WHEN doc_id % 5 <> 0 AND doc_id >= 500 THEN 'unknown_id' ELSE 'listed_twice' END AS problem FROM papers WHERE doc_id % 4 = 0 AND ((doc_id % 5 <> 0 AND doc_id >= 500) OR doc_id % 8 = 0) UNION ALL SELECT 'doc:gone', 'unknown_id'",
        "split_names": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), x AS (SELECT doc_id, coalesce(nullif(w[1], 'and'), 'x') AS a, coalesce(nullif(w[2], 'and'), 'x') AS b, coalesce(nullif(w[3], 'and'), 'x') AS c FROM w)
SELECT doc_id, CASE WHEN doc_id % 8 = 7 THEN '' WHEN doc_id % 4 = 2 THEN concat_ws('|', a, b, c) ELSE a || '|' || b END AS names, CASE WHEN doc_id % 4 = 0 THEN 'listed' WHEN doc_id % 8 = 7 THEN 'refused' ELSE 'split' END AS how FROM x""",
        "query_dates": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN e WHEN 1 THEN e + 18000 WHEN 2 THEN e - 19800 WHEN 3 THEN e - 50400 END AS at FROM (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e FROM events)",
        "native_names": "SELECT doc_id, doc_id % 4 = (doc_id // 4) % 3 AS named FROM documents",
        "postings_search": f"{W} SELECT id FROM corpus WHERE ({_like(' of lement')} OR {_like(' whi')} OR {_like(' les eaux[^ ]? ')}) AND {_DEFAULT}",
        "index_ranks": f"{W} SELECT id, row_number() OVER (ORDER BY id) - 1 AS ord, row_number() OVER (ORDER BY {title_fold}, id) - 1 AS title_rank FROM papers",
        "index_parity": f"{W}, {VOCAB} SELECT field, term, df + 1 AS df, df AS recount FROM vocab WHERE starts_with(term, 'th')",
        "token_streams": f"{W}, s AS (SELECT id, 'title' AS field, tok_title AS t FROM papers UNION ALL SELECT id, 'abstract', tok_abstract FROM papers) SELECT id, field, len(t) AS n, t[1] AS first, t[-1] AS last FROM s WHERE len(t) > 0",
        "count_value": f"{W} SELECT v AS value, (SELECT count(*) FROM corpus WHERE venue = v AND {_THE_KNOWN}) AS n FROM (VALUES ('EN'), ('FR'), ('XX')) t(v)",
        "query_costs": "SELECT name, CAST(verified AS BIGINT) AS verified, CAST(terms AS BIGINT) AS terms, CAST(counting AS BIGINT) AS counting FROM (VALUES ('flagship', 0, 4, 6), ('phrase', 0, 2, 2), ('near', 0, 2, 2), ('near_self', 1, 2, 2), ('near_phrase', 1, 3, 3), ('and_or_not', 0, 7, 16), ('filter_venue', 0, 2, 2)) t(name, verified, terms, counting)",
        "query_clauses": """SELECT n AS name, f AS field, coalesce(e, true) AS editable, r AS reason, coalesce(s, '') AS shown FROM (VALUES ('flagship'), ('phrase_wildcard'), ('filter_venue'), ('filter_track_default')) a(n) CROSS JOIN (VALUES ('venue'), ('year'), ('track'), ('status'), ('abstract_kind')) b(f)
LEFT JOIN (VALUES ('flagship', 'year', true, NULL, '2013..2020'), ('phrase_wildcard', 'track', false, 'nested', NULL), ('phrase_wildcard', 'status', false, 'nested', NULL), ('filter_venue', 'venue', true, NULL, 'EN,FR'), ('filter_track_default', 'track', true, NULL, 'main'),
('filter_venue', 'track', true, NULL, 'competition,datasets_benchmarks,main,position,unknown,workshop'), ('filter_venue', 'status', true, NULL, 'accepted,desk_rejected,rejected,unknown')) c(n2, f2, e, r, s) ON n2 = n AND f2 = f""",
        "query_words": """SELECT * FROM (VALUES ('models', 'models$ the ai 2020 "trust" risk', NULL), ('the', 'models the$ ai 2020 "trust" risk', NULL), ('ai', NULL, 'too_short'), ('2020', NULL, 'number'), ('trust', NULL, 'in_phrase'), ('risk', 'models the ai 2020 "trust" risk$', NULL)) t(token, edit, reason)""",
        "snapshot_round_trip": f"{W} SELECT venue, year, track, status, count(*) AS stated, count(*) AS n, count(abstract) AS with_abstract FROM papers WHERE title <> '' GROUP BY ALL",
        "cached_pages": """WITH v AS (SELECT 'https://a.example/' || CAST(page_id % 60 AS VARCHAR) AS url, CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END AS status, 1700000000 + page_id AS seen FROM pages),
b AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY status, seen DESC) AS n FROM v WHERE seen % 11 <> 0), u AS (SELECT 'https://a.example/' || CAST(range AS VARCHAR) AS url FROM range(70))
SELECT u.url, status, seen AS at FROM u LEFT JOIN b ON b.url = u.url AND n = 1""",
        "notes_v2": rf"""{W}, x AS (SELECT *, CAST(2019 + doc_id % 7 AS INTEGER) AS y, doc_id % 3 AS k FROM papers)
SELECT id, {_PLAIN_SQL} AS title, sha256(trim(regexp_replace(regexp_replace(abstract, '\p{{Cc}}', ' ', 'g'), '\s+', ' ', 'g'))) AS abstract, 'A B;' || source AS authors, CASE WHEN k = 2 THEN 'workshop' ELSE 'main' END AS track, CASE WHEN y IN (2021, 2022) THEN 'unknown' WHEN k = 1 THEN 'rejected' ELSE 'accepted' END AS status, y AS year, CASE WHEN k = 0 AND y >= 2023 AND doc_id % 2 = 0 THEN 'oral' END AS presentation FROM x""",
        "notes_v1": f"""{W}, x AS (SELECT *, CAST(2019 + doc_id % 7 AS INTEGER) AS y FROM papers)
SELECT id, {_PLAIN_SQL} AS title, 'A B;' || source AS authors, 'listed' AS authors_how, CASE WHEN doc_id % 3 = 2 THEN 'workshop' ELSE 'main' END AS track, CASE WHEN y IN (2021, 2022) AND doc_id % 2 = 1 THEN 'rejected' ELSE 'unknown' END AS status, y AS year FROM x""",
        "proceedings_listing": f"{W} SELECT 'https://proceedings.neurips.cc/paper/' || CAST(doc_id // 100 AS VARCHAR) AS page_url, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS at, 'https://proceedings.neurips.cc/paper_files/paper/2020/hash/' || md5(id) || '-Abstract.html' AS href, {_PLAIN_SQL} AS title, 'A B;' || source AS authors FROM papers",
        "paper_pages": rf"{W} SELECT id, nullif({_PLAIN_SQL}, '') AS title, 'A B' AS authors, sha256(trim(regexp_replace(regexp_replace(coalesce(abstract, ''), '\p{{Cc}}', ' ', 'g'), '\s+', ' ', 'g'))) AS abstract FROM papers",
        "dblp_release": f"{W} SELECT 'conf/icml/' || id AS key, '2024-01-02' AS mdate, {_PLAIN_SQL} AS title, 'Müller;' || source AS authors, year, '1-9' AS pages FROM papers WHERE doc_id % 3 = 0",
        "oai_answers": f"{W} SELECT doc_id AS article, doc_id % 9 = 0 AS deleted, CASE WHEN doc_id % 9 <> 0 THEN nullif({_PLAIN_SQL}, '') END AS title, CASE WHEN doc_id % 9 <> 0 THEN '10.1609/x.v' || CAST(doc_id AS VARCHAR) END AS doi, CAST(CASE WHEN doc_id % 9 <> 0 THEN 34 END AS BIGINT) AS volume, CAST(CASE WHEN doc_id % 9 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS creators FROM papers",
        "crossref_answers": f"{W} SELECT '10.1/' || id AS doi, {_PLAIN_SQL} || CASE WHEN doc_id % 2 = 0 THEN ': part two' ELSE '' END AS title, 'Ada ' || source AS authors, CAST(1 AS BIGINT) AS unnamed, '1-9' AS page FROM papers WHERE NOT contains(title, '<')",
    }
