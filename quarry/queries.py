"""The registered queries of the search and integration engine, each over whole tables, with DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vocab import CONFERENCES, STATUS_SOURCES, TEXT_SOURCES, Vocabulary
from quarry.operators import compare, resolve, snapshot
from quarry.operators.components import connected_components
from quarry.operators.compile import all_expansions, predicate
from quarry.operators.corpus import papers, postings
from quarry.operators.highlight import highlight
from quarry.operators.search import CODEC, Index
from quarry.plans.ast import Wildcard
from quarry.plans.parse import parse
from quarry.session import materialize
from quarry.sources import export

VALUES = Vocabulary(venues=("EN", "FR", "DE", "ES"))
ALL = " track:(main OR datasets_benchmarks OR position OR workshop OR competition OR unknown) status:(accepted OR rejected OR desk_rejected OR unknown)"
#: Name -> query string: match sets over title and abstract.
SEARCHES = {
    "flagship": '(the OR la) AND NOT "of the" year:2013..2020',
    "term": "the" + ALL,
    "term_title": "title:the" + ALL,
    "term_abstract": "abstract:the" + ALL,
    "wildcard_star": "lement*" + ALL,
    "wildcard_dollar": "tion$" + ALL,
    "phrase": '"of the"' + ALL,
    "phrase_wildcard": '"of lement*" OR "les eaux$"' + ALL,
    "near": "abstract:(the NEAR/3 and)" + ALL,
    "near_self": "the NEAR/0 the" + ALL,
    "near_phrase": '"of the" NEAR/5 and' + ALL,
    "and_or_not": "(the OR la OR der) AND (and OR et OR und) AND NOT of" + ALL,
    "nested_not": "the AND NOT (of AND NOT (and OR is))" + ALL,
    "not_null_abstract": "NOT abstract:the title:the" + ALL,
    "filter_venue": "(the OR la) venue:(EN OR FR)" + ALL,
    "filter_year_ranges": "the year:(2014..2016 OR 2017 OR 2021..2022)" + ALL,
    "filter_track_default": "the track:main",
    "filter_abstract_kind": "the abstract_kind:openalex" + ALL,
}
_INDEXES: dict[tuple[str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str) -> Index:
    """The index of a data folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        records = materialize(papers(spark, sf_dir, packed=True), "papers", codec=CODEC)  # the derivation is evaluated once
        _INDEXES[key] = Index.build(records, VALUES, replaces=records)
    return _INDEXES[key]


def tree(q: str):
    found = parse(q, vocabulary=VALUES)
    if not found.ok:
        raise ValueError([d.code for d in found.errors])
    return found


# -- shared SQL ----------------------------------------------------------------------------------------------
_TOK = "regexp_extract_all(strip_accents(replace(lower({}), 'ß', 'ss')), '[a-z0-9]+')"
PAPERS = f"""
papers0 AS (
  SELECT 'doc:' || lpad(CAST(d.doc_id AS VARCHAR), 8, '0') AS id, split_part(text, chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 AND trim(substr(text, instr(text, chr(10)) + 1)) <> '' THEN trim(substr(text, instr(text, chr(10)) + 1)) END AS abstract,
         upper(lang) AS venue, CAST(2013 + d.doc_id % 12 AS INTEGER) AS year,
         CASE d.doc_id % 10 WHEN 0 THEN 'workshop' WHEN 1 THEN 'position' WHEN 2 THEN 'datasets_benchmarks' WHEN 3 THEN 'unknown' WHEN 4 THEN 'competition' ELSE 'main' END AS track,
         CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'desk_rejected' WHEN quality = 0 THEN 'rejected' ELSE 'accepted' END AS status,
         d.doc_id AS doc_id, source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
papers AS (
  SELECT *, CASE WHEN abstract IS NULL THEN 'none' WHEN doc_id % 5 = 0 THEN 'openalex' ELSE 'official' END AS abstract_kind,
         {_TOK.format("title")} AS tok_title, {_TOK.format("coalesce(abstract, '')")} AS tok_abstract FROM papers0),
corpus AS (SELECT *, ' ' || array_to_string(tok_title, ' ') || ' ' AS T_title, ' ' || array_to_string(tok_abstract, ' ') || ' ' AS T_abstract FROM papers)
"""
VOCAB = "vocab AS (SELECT field, term, count(*) AS df FROM (SELECT DISTINCT id, 'title' AS field, unnest(tok_title) AS term FROM corpus UNION ALL SELECT DISTINCT id, 'abstract', unnest(tok_abstract) FROM corpus) GROUP BY field, term)"
W = f"WITH {PAPERS} "


def _search(q: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: index(spark, d).match(q, limit=None).select("id", "venue", "year", "track", "status")


MIXED = "(the OR la OR der) (and OR et OR und) NOT abstract:of venue:(EN OR FR)"
RANKED = "the OR la OR und"


def vocab_expand(spark, d):
    return all_expansions(index(spark, d).vocab, tree("lement* OR whi*").effective)


def match_total(spark, d):
    return index(spark, d).totals(tree(MIXED))


def setops(kind: str):
    def run(spark, d):
        i = index(spark, d)
        a, b = (i.match(q + ALL).select("id") for q in ("the", "and"))
        return {"intersect": a.intersect, "union": lambda x: a.union(x).distinct(), "except": a.exceptAll}[kind](b)

    return run


def facets_disjunctive(spark, d):
    return index(spark, d).facets(tree(MIXED).effective)


def combos(spark, d):
    return index(spark, d).combos(tree(RANKED).identification)


def exclusions(spark, d):
    return index(spark, d).exclusions(tree(RANKED))


def group_counts(spark, d):
    return index(spark, d).group_counts(tree(MIXED).effective).select("group_no", F.col("alone").cast("long").alias("alone"), F.col("without").cast("long").alias("without"))


def bm25_page(spark, d):
    return index(spark, d).page(RANKED, limit=50).select("id", F.round("score", 6).alias("score"))


def page_of(sort: str, offset: int, limit: int):
    return lambda spark, d: index(spark, d).page(RANKED + ALL, sort, offset, limit).select("id", "year")


def vocab_df(spark, d):
    return index(spark, d).vocab


def field_stats(spark, d):
    return index(spark, d).stats.select("field", "n", "tokens", F.round("avg_len", 6).alias("avg_len"))


def postings_df(spark, d):
    found = postings(index(spark, d).corpus)
    return found.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("occurrences"), F.min(F.element_at("positions", 1)).cast("long").alias("first"))


def title_key_buckets(spark, d):
    rows = index(spark, d).corpus.select("id", "venue", "year", F.array_join("tok_title", " ").alias("title_key")).where("title_key <> ''")
    return rows.groupBy("venue", "year", "title_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def abstract_key_buckets(spark, d):
    rows = index(spark, d).corpus.where(F.size("tok_abstract") >= 50).select("id", F.concat(F.lit("sha256:"), F.sha2(F.array_join("tok_abstract", " "), 256)).alias("abstract_key"))
    return rows.groupBy("abstract_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def dedup_components(spark, d):
    """Documents linked by equal title keys of one venue, or by equal abstracts, whatever their year."""
    rows = index(spark, d).corpus.select("id", "venue", F.array_join("tok_title", " ").alias("t"), F.when(F.size("tok_abstract") >= 50, F.sha2(F.array_join("tok_abstract", " "), 256)).alias("a"))
    stars = []
    for keys in (["venue", "t"], ["a"]):
        first = rows.where(F.col(keys[-1]).isNotNull() & (F.col(keys[-1]) != "")).groupBy(*keys).agg(F.min("id").alias("src"))
        stars.append(rows.join(first, keys).where("id <> src").select("src", F.col("id").alias("dst")))
    found = connected_components(stars[0].unionByName(stars[1]))
    return found.groupBy("component").agg(F.count("*").alias("n"), F.max("node").alias("last_id"))


def merged_records(spark, d):
    """(survivor_id, merged_id, rule) over made-up claims: sources by number, forum ids that some share, a proceedings id for every listing."""
    p = papers(spark, d).withColumn("n", F.expr("cast(substring(id, 5) as bigint)"))
    source = F.get(F.array(*[F.lit(s) for s in TEXT_SOURCES]), (F.col("n") % len(TEXT_SOURCES)).cast("int"))
    none = F.array().cast("array<string>")
    forum = F.when(source.startswith("openreview") | (F.col("n") % 9 == 0), F.array(F.concat(F.lit("F"), (F.col("n") % 997).cast("string")))).otherwise(none)
    listed = F.when(source.isin("iclr_archive", "neurips_proceedings", "pmlr"), F.array(F.concat(F.lit("P"), "id"))).otherwise(none)
    rows = p.select("id", "venue", "year", "title", "abstract", "track", "status", F.array(source).alias("sources"), forum.alias("forum_ids"), listed.alias("proceedings_ids"))
    return resolve.merge(rows)[1]


_SOURCES = TEXT_SOURCES[:7]


def claims(spark, d):
    docs = papers(spark, d).select(F.expr("cast(substring(id, 5) as bigint)").alias("n"), "title", "track", "status")
    source = F.get(F.array(*[F.lit(s) for s in _SOURCES]), (F.col("n") % len(_SOURCES)).cast("int"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("n") % 97) * 86400)
    base = docs.select(F.concat(F.lit("rec:"), (F.col("n") % 150).cast("string")).alias("record_id"), source.alias("source"), at.alias("fetched_at"), F.lit(None).cast("string").alias("url"), "title", "track", "status")
    return base.select("record_id", "source", "fetched_at", "url", F.explode(F.create_map(*[x for f in ("title", "track", "status") for x in (F.lit(f), F.col(f))])).alias("field", "value"))


CLAIMS = f"""{PAPERS},
base AS (SELECT 'rec:' || CAST(doc_id % 150 AS VARCHAR) AS record_id, ([{", ".join(f"'{s}'" for s in _SOURCES)}])[doc_id % {len(_SOURCES)} + 1] AS source,
                1700000000 + (doc_id % 97) * 86400 AS seen, title, track, status FROM papers),
claims AS (SELECT record_id, source, seen, 'title' AS field, title AS value FROM base UNION ALL SELECT record_id, source, seen, 'track', track FROM base UNION ALL SELECT record_id, source, seen, 'status', status FROM base),
standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field, source ORDER BY seen DESC, value) AS n FROM claims) WHERE n = 1),
ranked AS (SELECT *, CASE WHEN field = 'status' THEN coalesce(list_position([{", ".join(f"'{s}'" for s in STATUS_SOURCES)}], source) - 1, {len(STATUS_SOURCES)})
                          ELSE coalesce(list_position([{", ".join(f"'{s}'" for s in TEXT_SOURCES)}], source) - 1, {len(TEXT_SOURCES)}) END AS rank FROM standing)
"""


def newest_claim(spark, d):
    return resolve.newest(claims(spark, d))[0].select("record_id", "field", "source", "value")


def precedence_pick(spark, d):
    return resolve.resolve(claims(spark, d))[0]


def claim_conflicts(spark, d):
    found = resolve.resolve(claims(spark, d))[1].where("resolution like 'precedence:%'")
    return found.groupBy("field", "source_a", "source_b").agg(F.count("*").alias("n"))


def crawl_windows(spark, d):
    found = snapshot.crawl_windows(claims(spark, d))
    return found.select("source", F.unix_timestamp("first").alias("first"), F.unix_timestamp("last").alias("last"))


def reconcile_unlisted(spark, d):
    rows = papers(spark, d).withColumn("title_key", resolve.title_key(F.col("title"))).withColumn("forum_id", F.lit(None).cast("string"))
    listed = rows.where("year % 2 = 0 and abstract_kind = 'openalex'").select("venue", "year", "track", "title_key", "forum_id", F.lit(True).alias("complete"))
    return resolve.unlisted(rows, listed).select("id")


def survivor_id(spark, d):
    rows = papers(spark, d).select("id", F.concat("venue", F.col("year").cast("string")).alias("g"), (F.col("track") == "main").alias("has_forum"))
    return resolve.survivor(rows, "g")


def fill_abstracts(spark, d):
    """A third of the records and works have a DOI that some share."""
    p = papers(spark, d).withColumn("title_key", resolve.title_key(F.col("title"))).withColumn("n", F.expr("cast(substring(id, 5) as bigint)"))
    p = p.withColumn("doi", F.when(F.col("n") % 3 == 0, F.concat(F.lit("10.1/A"), (F.col("n") % 200).cast("string"))))
    records = p.select("id", "doi", "venue", "year", "title_key", F.when(F.col("abstract_kind") == "official", F.col("abstract")).alias("abstract"))
    works = p.where("abstract_kind = 'openalex'").select(F.lower("doi").alias("doi"), "venue", "year", "title_key", "abstract")
    return resolve.fill_abstracts(records, works).groupBy("how").agg(F.count("*").alias("n"))


def _earlier(spark, d):
    """An earlier snapshot: some records absent, some with another status."""
    p = papers(spark, d)
    return p.where("year <> 2016").withColumn("status", F.when(F.col("year") == 2018, "unknown").otherwise(F.col("status")))


def snapshot_diff(spark, d):
    return snapshot.diff(_earlier(spark, d), papers(spark, d).where("track <> 'workshop'"))


def replay_added_removed(spark, d):
    i = index(spark, d)
    now = i.corpus.where(predicate(tree("the" + ALL).effective))
    then = i.corpus.where(predicate(tree("and" + ALL).effective))
    return snapshot.replay(then, now)


def removal_cause(spark, d):
    removed = _earlier(spark, d).where("status <> 'accepted'").select("id").unionByName(spark.createDataFrame([("doc:gone",)], "id string"))
    return snapshot.removal_causes(removed, index(spark, d).corpus, [("track", F.col("track") == "main"), ("status", F.col("status") == "accepted")])


def removal_tally(spark, d):
    return snapshot.removal_tally(removal_cause(spark, d), ["not_in_index", "venue", "year", "track", "status", "still_eligible"])


def coverage_rollup(spark, d):
    return snapshot.coverage(papers(spark, d))


def coverage_gate(spark, d):
    cells = papers(spark, d).groupBy("venue", "year", "track").agg(F.count("*").alias("indexed"))
    official = papers(spark, d).where("abstract is not null").groupBy("venue", "year", "track").agg(F.count("*").alias("official"))
    return snapshot.gate(cells, official)


def status_check(spark, d):
    supplied = papers(spark, d).where("status in ('accepted', 'unknown')").select("source", "status").distinct()
    return snapshot.unexpected_statuses(papers(spark, d), supplied)


def snapshot_counts(spark, d):
    found = snapshot.snapshot_counts(papers(spark, d))
    return found.select("venue", "year", "track", "status", "n", "with_abstract", F.size("sources").cast("long").alias("n_sources"))


def ids_hash(spark, d):
    return index(spark, d).ids_hash(tree("the" + ALL).effective)


def content_hash(spark, d):
    return papers(spark, d).select("id", snapshot.content_hash().alias("content_hash"))


def same_paper_closure(spark, d):
    rows = papers(spark, d).withColumn("t", resolve.title_key(F.col("title"))).where("t <> ''")
    by = Window.partitionBy("t").orderBy("id")
    links = rows.withColumn("dst", F.lead("id").over(by)).where("dst is not null").select(F.col("id").alias("src"), "dst")
    listed = rows.where("track = 'position'").select("id")
    return resolve.same_paper(listed, links)


def withheld(spark, d):
    found = resolve.withhold(papers(spark, d), papers(spark, d).where("track = 'position'").select("id"))
    return found.groupBy("withheld").agg(F.count("*").alias("n"), F.count("abstract").alias("with_abstract"))


def rebuild_inverted_index(spark, d):
    corpus = index(spark, d).corpus.where("size(tok_title) > 0")
    words = corpus.select("id", F.posexplode("tok_title").alias("p", "w")).groupBy("id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    maps = words.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("m"))
    return maps.select("id", T.rebuild(F.col("m")).alias("title"))


def levenshtein_title(spark, d):
    """Near titles inside one venue and year."""
    rows = index(spark, d).corpus.where("size(tok_title) > 2").select("id", "venue", "year", F.array_join("tok_title", " ").alias("k"))
    return resolve.near_titles(rows)


def venue_era(spark, d):
    eras = spark.createDataFrame([(v, y, a) for v, (_, es) in CONFERENCES.items() for y, a in es], "conf string, first int, acronym string")
    rows = papers(spark, d).select("id", "year", F.when(F.col("venue") == "EN", "NeurIPS").when(F.col("venue") == "FR", "FAccT").otherwise("ICML").alias("conf"))
    on = (rows["conf"] == eras["conf"]) & (eras["first"] <= rows["year"])  # a row of the small table per venue and era
    return rows.join(F.broadcast(eras), on, "left").groupBy("id").agg(F.max_by("acronym", "first").alias("acronym"))


def url_parts(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", T.host(F.col("url")).alias("host"), T.is_url(F.col("url")).alias("is_url"), F.regexp_extract("url", r"/(\d+)", 1).cast("long").alias("article"))


def inflections(spark, d):
    return index(spark, d).vocab.select("term").distinct().select("term", T.inflection_stem(F.col("term")).alias("stem"))


def one_line_titles(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.sha2(T.one_line(F.col("text")), 256).alias("line_sha256"))


def html_text(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", T.html_text_column(F.col("html")).alias("text"))


def highlights(spark, d):
    i = index(spark, d)
    return highlight(i.page(RANKED, limit=50), tree(RANKED).effective)


def bibtex_keys(spark, d):
    return export.bibtex_keys(papers(spark, d))


def _exported(form: str):
    return lambda spark, d: export.FORMATS[form](index(spark, d).match(RANKED))


def canonicalise(spark, d):
    rows = []
    for name, q in SEARCHES.items():
        found = tree(q)
        rows.append((name, found.canonical, found.canonical_hash, found.identification_query))
    return spark.createDataFrame(rows, "name string, canonical string, canonical_hash string, identification string")


def match_ladder(spark, d):
    p = papers(spark, d).withColumn("title_key", resolve.title_key(F.col("title")))
    corpus = p.where("track <> 'unknown'").select("id", "venue", "year", "title_key", F.when(F.col("track") == "workshop", F.col("id")).alias("forum_id"), F.lit(None).cast("string").alias("native_id"), F.when(F.col("track") == "main", F.concat(F.lit("10.1/"), F.col("year").cast("string"), F.lit("."), F.expr("cast(substring(id, 5) as bigint) % 40"))).alias("doi"))
    refs = p.select(F.col("id").alias("ref_id"), "venue", "year", "title_key", F.when(F.col("track") == "workshop", F.col("id")).alias("forum_id"), F.lit(None).cast("string").alias("native_id"), F.when(F.col("track") == "main", F.concat(F.lit("10.1/"), F.col("year").cast("string"), F.lit("."), F.expr("cast(substring(id, 5) as bigint) % 40"))).alias("doi"))
    return compare.match_ladder(refs, corpus)


def comparison_partition(spark, d):
    i = index(spark, d)
    expected = i.match("the" + ALL).select("id").unionByName(spark.createDataFrame([("doc:gone",)], "id string"))
    return compare.partition(expected, i.match("and" + ALL).select("id"), i.corpus)


def comparison_classes(spark, d):
    sides = comparison_partition(spark, d).where("side = 'dropped'")
    rows = sides.join(index(spark, d).corpus, "id")
    tests = [("filtered", F.col("status") != "accepted"), ("unsettled", F.col("abstract").isNull()), ("stemming", F.contains("T_abstract", F.lit(" and")))]
    return compare.classify(rows, tests, "full_text").groupBy("class").agg(F.count("*").alias("n"))


def claim_rates(spark, d):
    """The hourly counts of the streaming operator, as a batch over events."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("ts").alias("fetched_at"), F.col("event_type").alias("source"))
    grouped = events.groupBy(F.window("fetched_at", "1 hour"), "source").agg(F.count("*").alias("n"))
    return grouped.select(F.unix_timestamp("window.start").alias("start"), "source", "n")


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _search(q) for name, q in SEARCHES.items()},
    **{f.__name__: f for f in (vocab_expand, match_total, facets_disjunctive, combos, exclusions, group_counts, bm25_page, vocab_df, field_stats, postings_df, title_key_buckets, abstract_key_buckets, dedup_components, merged_records, newest_claim, precedence_pick, claim_conflicts, crawl_windows, reconcile_unlisted, survivor_id, fill_abstracts, snapshot_diff, replay_added_removed, removal_cause, removal_tally, coverage_rollup, coverage_gate, status_check, snapshot_counts, ids_hash, content_hash, same_paper_closure, withheld, rebuild_inverted_index, levenshtein_title, venue_era, url_parts, inflections, one_line_titles, html_text, highlights, bibtex_keys, canonicalise, match_ladder, comparison_partition, comparison_classes, claim_rates)},
    **{f"setops_{k}": setops(k) for k in ("intersect", "union", "except")},
    **{f"sort_{s}": page_of(s, 0, 100) for s in ("year_desc", "year_asc")},
    "paging": page_of("year_desc", 30, 40),
    **{f"{form}_export": _exported(form) for form in export.FORMATS},
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


# -- oracles -------------------------------------------------------------------------------------------------
def _held(*texts: str) -> str:
    """Any of some words or phrases in either field."""
    return "(" + " OR ".join(f"contains(T_{f}, ' {t} ')" for t in texts for f in ("title", "abstract")) + ")"


def _like(pattern: str, *fields: str) -> str:
    return "(" + " OR ".join(f"regexp_matches(T_{f}, '{pattern}')" for f in fields or ("title", "abstract")) + ")"


#: Every query as a condition on the corpus, written from the language's rules, not by the parser.
_KNOWN = "track IN ('main', 'datasets_benchmarks', 'position', 'workshop', 'competition', 'unknown') AND status IN ('accepted', 'rejected', 'desk_rejected', 'unknown')"
_DEFAULT = "track IN ('datasets_benchmarks', 'main', 'position') AND status = 'accepted'"
_THE_KNOWN, _AND_KNOWN = f"({_held('the')} AND {_KNOWN})", f"({_held('and')} AND {_KNOWN})"
_WHERE = {
    "flagship": f"{_held('the', 'la')} AND NOT {_held('of the')} AND year BETWEEN 2013 AND 2020 AND {_DEFAULT}",
    "term": _THE_KNOWN,
    "term_title": f"contains(T_title, ' the ') AND {_KNOWN}",
    "term_abstract": f"contains(T_abstract, ' the ') AND {_KNOWN}",
    "wildcard_star": f"{_like(' lement')} AND {_KNOWN}",
    "wildcard_dollar": f"{_like(' tion[^ ]? ')} AND {_KNOWN}",
    "phrase": f"{_held('of the')} AND {_KNOWN}",
    "phrase_wildcard": f"({_like(' of lement')} OR ({_like(' les eaux[^ ]? ')} AND {_KNOWN})) AND {_DEFAULT}",
    "near": f"({_like(' the ([^ ]+ ){0,3}and ', 'abstract')} OR {_like(' and ([^ ]+ ){0,3}the ', 'abstract')}) AND {_KNOWN}",
    "near_self": f"{_held('the the')} AND {_KNOWN}",
    "near_phrase": f"({_like(' of the ([^ ]+ ){0,5}and ')} OR {_like(' and ([^ ]+ ){0,5}of the ')}) AND {_KNOWN}",
    "and_or_not": f"{_held('the', 'la', 'der')} AND {_held('and', 'et', 'und')} AND NOT {_held('of')} AND {_KNOWN}",
    "nested_not": f"{_held('the')} AND NOT ({_held('of')} AND NOT {_held('and', 'is')}) AND {_KNOWN}",
    "not_null_abstract": f"NOT contains(T_abstract, ' the ') AND contains(T_title, ' the ') AND {_KNOWN}",
    "filter_venue": f"{_held('the', 'la')} AND venue IN ('EN', 'FR') AND {_KNOWN}",
    "filter_year_ranges": f"{_held('the')} AND (year BETWEEN 2014 AND 2017 OR year IN (2021, 2022)) AND {_KNOWN}",
    "filter_track_default": f"{_held('the')} AND track = 'main' AND status = 'accepted'",
    "filter_abstract_kind": f"{_held('the')} AND abstract_kind = 'openalex' AND {_KNOWN}",
}
_RANKED_ALL = f"({_held('the', 'la')} OR {_held('und')} AND {_KNOWN}) AND {_DEFAULT}"
_MIXED_A, _MIXED_B, _MIXED_REST = _held("the", "la", "der"), _held("and", "et", "und"), "NOT contains(T_abstract, ' of ')"
_MIXED_KNOWN = f"{_MIXED_A} AND {_MIXED_B} AND {_MIXED_REST} AND venue IN ('EN', 'FR')"


#: The canonical forms, written out from the rules of the language.
_KNOWN_FORM = "track:(competition OR datasets_benchmarks OR main OR position OR unknown OR workshop) AND status:(accepted OR desk_rejected OR rejected OR unknown)"
_DEFAULT_FORM = "track:(datasets_benchmarks OR main OR position) AND status:accepted"
_TEXT_FORM = {
    "term": "the",
    "term_title": "title:the",
    "term_abstract": "abstract:the",
    "wildcard_star": "lement*",
    "wildcard_dollar": "tion$",
    "phrase": '"of the"',
    "near": '(abstract:"and" NEAR/3 abstract:the)',
    "near_self": "(the NEAR/0 the)",
    "near_phrase": '("and" NEAR/5 "of the")',
    "and_or_not": '(the OR la OR der) AND ("and" OR et OR und) AND NOT of',
    "nested_not": 'the AND NOT (of AND NOT ("and" OR is))',
    "not_null_abstract": "NOT abstract:the AND title:the",
    "filter_venue": "(the OR la) AND venue:(EN OR FR)",
    "filter_year_ranges": "the AND year:(2014..2017 OR 2021..2022)",
}
_CANONICAL = {name: (f"({form} AND {_KNOWN_FORM})", f"({form} AND {_KNOWN_FORM})") for name, form in _TEXT_FORM.items()} | {
    "flagship": (f'((the OR la) AND NOT "of the" AND year:2013..2020 AND {_DEFAULT_FORM})', '((the OR la) AND NOT "of the" AND year:2013..2020)'),
    "phrase_wildcard": (f'(("of lement*" OR ("les eaux$" AND {_KNOWN_FORM})) AND {_DEFAULT_FORM})', f'("of lement*" OR ("les eaux$" AND {_KNOWN_FORM}))'),
    "filter_track_default": ("(the AND track:main AND status:accepted)", "(the AND track:main)"),
    "filter_abstract_kind": (f"(the AND {_KNOWN_FORM} AND abstract_kind:openalex)", f"(the AND {_KNOWN_FORM} AND abstract_kind:openalex)"),
}


def _facet_sql() -> str:
    filters = {"venue": "venue IN ('EN', 'FR')", "track": "track IN ('datasets_benchmarks', 'main', 'position')", "status": "status = 'accepted'"}
    sides = []
    for f in ("venue", "year", "track", "status", "abstract_kind"):
        kept = " AND ".join([_MIXED_A, _MIXED_B, _MIXED_REST, *(w for name, w in filters.items() if name != f)])
        sides.append(f"SELECT '{f}' AS field, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM corpus WHERE {kept} GROUP BY {f}")
    return W + " UNION ALL ".join(sides)


def _group_sql() -> str:
    kept = f"{_MIXED_REST} AND venue IN ('EN', 'FR') AND {_DEFAULT}"
    rows = [(0, _MIXED_A, _MIXED_B), (1, _MIXED_B, _MIXED_A)]
    return W + " UNION ALL ".join(f"SELECT {i} AS group_no, count(*) FILTER (WHERE {own} AND {kept}) AS alone, count(*) FILTER (WHERE {other} AND {kept}) AS without FROM corpus" for i, own, other in rows)


def _bm25_sql() -> str:
    terms = ("the", "la", "und")
    parts = []
    for t in terms:
        for f, weight in (("title", 2.0), ("abstract", 1.0)):
            tf = f"CAST(len(list_filter(tok_{f}, lambda x: x = '{t}')) AS DOUBLE)"
            df = f"(SELECT CAST(coalesce(max(df), 0) AS DOUBLE) FROM vocab WHERE field = '{f}' AND term = '{t}')"
            n, over = f"len(tok_{f})", f"(len(tok_{f}) - 24)"
            length = f"(CASE WHEN {n} <= 40 THEN {n} ELSE 24 + floor({over} / pow(2, floor(log2({over})) - 3)) * pow(2, floor(log2({over})) - 3) END)"
            idf = f"ln(1 + (n_docs - {df} + 0.5) / ({df} + 0.5))"
            parts.append(f"{weight} * {idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {length} / avg_{f}))")
    return f"""{W}, {VOCAB}, st AS (SELECT count(*) AS n_docs, avg(len(tok_title)) AS avg_title, avg(len(tok_abstract)) AS avg_abstract FROM corpus),
scored AS (SELECT id, round({" + ".join(parts)}, 9) AS score FROM corpus, st WHERE {_held('the', 'la', 'und')} AND {_DEFAULT})
SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 50"""


def _exclusion_sql() -> str:
    return f"""{W}, r AS (SELECT CASE WHEN track NOT IN ('datasets_benchmarks', 'main', 'position') THEN 'track' WHEN status <> 'accepted' THEN 'status' END AS field, track, status FROM corpus WHERE {_held('the', 'la', 'und')}),
c AS (SELECT field, CASE field WHEN 'track' THEN track ELSE status END AS value, count(*) AS n FROM r WHERE field IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(c.field, u.field) AS field, coalesce(c.value, u.value) AS value, coalesce(n, 0) AS n
FROM c FULL JOIN (SELECT 'track' AS field, 'unknown' AS value UNION ALL SELECT 'status', 'unknown') u ON c.field = u.field AND c.value = u.value"""


_KEYED = "keyed AS (SELECT *, array_to_string(tok_title, ' ') AS t, CASE WHEN len(tok_abstract) >= 50 THEN sha256(array_to_string(tok_abstract, ' ')) END AS a FROM corpus)"


def oracles() -> dict[str, str]:
    out = {name: f"{W} SELECT id, venue, year, track, status FROM corpus WHERE {where}" for name, where in _WHERE.items()}
    the, and_, ranked = _THE_KNOWN, _AND_KNOWN, f"{_held('the', 'la', 'und')} AND {_DEFAULT}"
    ids = lambda p: f"SELECT id FROM corpus WHERE {p}"
    earlier = "earlier AS (SELECT * REPLACE (CASE WHEN year = 2018 THEN 'unknown' ELSE status END AS status) FROM papers WHERE year <> 2016)"
    out |= {
        "vocab_expand": f"{W}, {VOCAB} SELECT DISTINCT 'lement*' AS wildcard, term FROM vocab WHERE starts_with(term, 'lement') UNION ALL SELECT DISTINCT 'whi*', term FROM vocab WHERE starts_with(term, 'whi')",
        "match_total": f"{W} SELECT count(*) FILTER (WHERE {_MIXED_KNOWN} AND {_DEFAULT}) AS total, count(*) FILTER (WHERE {_MIXED_KNOWN}) AS identified, count(*) FILTER (WHERE {_MIXED_KNOWN} AND NOT ({_DEFAULT})) AS removed, count(*) FILTER (WHERE {_MIXED_KNOWN} AND NOT ({_DEFAULT}) AND (track = 'unknown' OR status = 'unknown')) AS unclassified FROM corpus",
        "setops_intersect": f"{W} {ids(the)} INTERSECT {ids(and_)}",
        "setops_union": f"{W} {ids(the)} UNION {ids(and_)}",
        "setops_except": f"{W} {ids(the)} EXCEPT {ids(and_)}",
        "facets_disjunctive": _facet_sql(),
        "combos": f"{W} SELECT venue, year, track, status, abstract_kind, count(*) AS n FROM corpus WHERE {_held('the', 'la', 'und')} GROUP BY ALL",
        "exclusions": _exclusion_sql(),
        "group_counts": _group_sql(),
        "bm25_page": _bm25_sql(),
        "sort_year_desc": f"{W} SELECT id, year FROM corpus WHERE {_RANKED_ALL} ORDER BY year DESC, id LIMIT 100",
        "sort_year_asc": f"{W} SELECT id, year FROM corpus WHERE {_RANKED_ALL} ORDER BY year, id LIMIT 100",
        "paging": f"{W} SELECT id, year FROM corpus WHERE {_RANKED_ALL} ORDER BY year DESC, id LIMIT 40 OFFSET 30",
        "vocab_df": f"{W}, {VOCAB} SELECT field, term, df FROM vocab",
        "field_stats": f"{W} SELECT 'title' AS field, count(*) AS n, CAST(sum(len(tok_title)) AS BIGINT) AS tokens, round(avg(len(tok_title)), 6) AS avg_len FROM corpus UNION ALL SELECT 'abstract', count(*), CAST(sum(len(tok_abstract)) AS BIGINT), round(avg(len(tok_abstract)), 6) FROM corpus",
        "postings_df": f"{W}, e AS (SELECT id, 'title' AS field, unnest(tok_title) AS term, unnest(range(len(tok_title))) AS p FROM corpus UNION ALL SELECT id, 'abstract', unnest(tok_abstract), unnest(range(len(tok_abstract))) FROM corpus), i AS (SELECT term, field, id, count(*) AS k, min(p) AS f FROM e GROUP BY ALL) SELECT term, field, count(*) AS df, CAST(sum(k) AS BIGINT) AS occurrences, min(f) AS first FROM i GROUP BY term, field",
        "title_key_buckets": f"{W}, {_KEYED} SELECT venue, year, t AS title_key, count(*) AS n, min(id) AS first_id FROM keyed WHERE t <> '' GROUP BY venue, year, t HAVING count(*) > 1",
        "abstract_key_buckets": f"{W}, {_KEYED} SELECT 'sha256:' || a AS abstract_key, count(*) AS n, min(id) AS first_id FROM keyed WHERE a IS NOT NULL GROUP BY a HAVING count(*) > 1",
        "dedup_components": f"""WITH RECURSIVE {PAPERS}, {_KEYED},
e0 AS (SELECT id, min(id) OVER (PARTITION BY venue, t) AS m FROM keyed WHERE t <> '' UNION SELECT id, min(id) OVER (PARTITION BY a) FROM keyed WHERE a IS NOT NULL),
e AS (SELECT id AS x, m AS y FROM e0 WHERE id <> m UNION SELECT m, id FROM e0 WHERE id <> m),
r AS (SELECT DISTINCT x, x AS y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS node, min(y) AS component FROM r GROUP BY x)
SELECT component, count(*) AS n, max(node) AS last_id FROM c GROUP BY component""",
        "newest_claim": f"WITH {CLAIMS} SELECT record_id, field, source, value FROM standing",
        "precedence_pick": f"WITH {CLAIMS} SELECT record_id, field, value, source FROM (SELECT *, row_number() OVER (PARTITION BY record_id, field ORDER BY rank, source, value) AS k FROM ranked) WHERE k = 1",
        "claim_conflicts": f"""WITH {CLAIMS}, b AS (SELECT *, first_value(value) OVER w AS bv, first_value(source) OVER w AS bs FROM ranked WINDOW w AS (PARTITION BY record_id, field ORDER BY rank, source, value)),
x AS (SELECT DISTINCT record_id, field, bv, bs, value, source FROM b WHERE source <> bs AND CASE WHEN field = 'title' THEN array_to_string({_TOK.format("value")}, ' ') <> array_to_string({_TOK.format("bv")}, ' ') ELSE value <> bv END)
SELECT field, bs AS source_a, source AS source_b, count(*) AS n FROM x GROUP BY ALL""",
        "crawl_windows": f"WITH {CLAIMS} SELECT source, CAST(min(seen) AS BIGINT) AS first, CAST(max(seen) AS BIGINT) AS last FROM claims GROUP BY source",
        "reconcile_unlisted": f"""{W}, {_KEYED}, l AS (SELECT DISTINCT venue, year, track, t FROM keyed WHERE year % 2 = 0 AND abstract_kind = 'openalex')
SELECT id FROM keyed k WHERE status = 'accepted' AND EXISTS (SELECT 1 FROM l WHERE l.venue = k.venue AND l.year = k.year AND l.track = k.track) AND NOT EXISTS (SELECT 1 FROM l WHERE l.venue = k.venue AND l.year = k.year AND l.t = k.t AND l.t <> '')""",
        "survivor_id": f"{W} SELECT venue || CAST(year AS VARCHAR) AS g, coalesce(min(id) FILTER (WHERE track = 'main'), min(id)) AS survivor FROM papers GROUP BY 1",
        "fill_abstracts": f"""{W}, {_KEYED}, d AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '10.1/A' || CAST(doc_id % 200 AS VARCHAR) END AS doi FROM keyed),
w AS (SELECT * FROM d WHERE abstract_kind = 'openalex' AND abstract IS NOT NULL),
by_doi AS (SELECT doi, count(DISTINCT abstract) AS texts FROM w WHERE doi IS NOT NULL GROUP BY doi),
works AS (SELECT venue, year, t, count(*) AS works FROM w WHERE doi IS NULL AND t <> '' GROUP BY ALL), s AS (SELECT venue, year, t, count(*) AS sharers FROM d GROUP BY ALL)
SELECT CASE WHEN abstract_kind = 'official' THEN 'had_abstract' WHEN texts > 1 THEN 'doi_duplicate' WHEN texts = 1 THEN 'doi' WHEN works IS NULL THEN 'no_work' WHEN works > 1 OR sharers > 1 THEN 'title_ambiguous' ELSE 'title' END AS how, count(*) AS n
FROM d LEFT JOIN by_doi USING (doi) LEFT JOIN works USING (venue, year, t) LEFT JOIN s USING (venue, year, t) GROUP BY 1""",
        "snapshot_diff": f"""{W}, {earlier}, now AS (SELECT * FROM papers WHERE track <> 'workshop')
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
       CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE 'status' END AS fields
FROM earlier a FULL JOIN now b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.status <> b.status""",
        "replay_added_removed": f"{W} SELECT id, 'removed' AS side FROM ({ids(and_)} EXCEPT {ids(the)}) UNION ALL SELECT id, 'added' FROM ({ids(the)} EXCEPT {ids(and_)})",
        "removal_cause": f"""{W}, {earlier}, r AS (SELECT id FROM earlier WHERE status <> 'accepted' UNION ALL SELECT 'doc:gone')
SELECT r.id, CASE WHEN p.id IS NULL THEN 'not_in_index' WHEN track <> 'main' THEN 'track' WHEN status <> 'accepted' THEN 'status' ELSE 'still_eligible' END AS cause FROM r LEFT JOIN papers p ON p.id = r.id""",
        "removal_tally": f"""{W}, {earlier}, r AS (SELECT id FROM earlier WHERE status <> 'accepted' UNION ALL SELECT 'doc:gone'),
c AS (SELECT CASE WHEN p.id IS NULL THEN 'not_in_index' WHEN track <> 'main' THEN 'track' WHEN status <> 'accepted' THEN 'status' ELSE 'still_eligible' END AS cause FROM r LEFT JOIN papers p ON p.id = r.id)
SELECT v.cause, count(c.cause) AS n FROM (VALUES ('not_in_index'), ('venue'), ('year'), ('track'), ('status'), ('still_eligible')) v(cause) LEFT JOIN c ON c.cause = v.cause GROUP BY v.cause""",
        "coverage_rollup": f"{W} SELECT venue, year, track, status, count(*) AS n, count(*) FILTER (WHERE abstract IS NULL) AS missing_abstract, CAST(grouping(venue, year, track, status) AS BIGINT) AS level FROM papers GROUP BY ROLLUP (venue, year, track, status)",
        "coverage_gate": f"{W}, c AS (SELECT venue, year, track, count(*) AS indexed, nullif(count(abstract), 0) AS official FROM papers GROUP BY ALL) SELECT venue, year, track, indexed, official, indexed - official AS delta, abs(indexed - official) * 100 <= official AS within FROM c",
        "status_check": f"""{W}, s AS (SELECT DISTINCT source, status FROM papers WHERE status IN ('accepted', 'unknown')), v AS (SELECT DISTINCT venue, year, s.status FROM papers p JOIN s ON s.source = p.source)
SELECT venue, year, status, count(*) AS n FROM papers p WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.venue = p.venue AND v.year = p.year AND v.status = p.status) GROUP BY ALL""",
        "snapshot_counts": f"{W} SELECT venue, year, track, status, count(*) AS n, count(abstract) AS with_abstract, count(DISTINCT source) AS n_sources FROM papers GROUP BY ALL",
        "ids_hash": f"{W} SELECT sha256(string_agg(id, chr(10) ORDER BY id)) AS ids_hash FROM corpus WHERE {the}",
        "content_hash": f"""{W} SELECT id, sha256('{{"abstract":' || coalesce(CAST(to_json(abstract) AS VARCHAR), 'null') || ',"status":' || CAST(to_json(status) AS VARCHAR) || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"track":' || CAST(to_json(track) AS VARCHAR) || ',"venue":' || CAST(to_json(venue) AS VARCHAR) || ',"year":' || CAST(year AS VARCHAR) || '}}') AS content_hash
FROM papers""",
        "same_paper_closure": f"{W}, {_KEYED}, l AS (SELECT DISTINCT t FROM keyed WHERE track = 'position' AND t <> '') SELECT id FROM keyed JOIN l USING (t)",
        "withheld": f"{W} SELECT track = 'position' AS withheld, count(*) AS n, count(CASE WHEN track <> 'position' THEN abstract END) AS with_abstract FROM papers GROUP BY 1",
        "rebuild_inverted_index": f"{W} SELECT id, array_to_string(tok_title, ' ') AS title FROM corpus WHERE len(tok_title) > 0",
        "levenshtein_title": f"""{W}, k AS (SELECT id, venue, year, array_to_string(tok_title, ' ') AS k, length(array_to_string(tok_title, ' ')) AS n FROM corpus WHERE len(tok_title) > 2),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.k AS x, b.k AS y, levenshtein(a.k, b.k) AS distance FROM k a JOIN k b ON a.venue = b.venue AND a.year = b.year AND a.id < b.id AND abs(a.n - b.n) * 10 <= greatest(a.n, b.n))
SELECT id_a, id_b, distance, CASE WHEN x = y THEN 'exact' ELSE 'similar' END AS verdict FROM p
WHERE x = y OR (distance * 10 <= greatest(length(x), length(y)) AND regexp_extract_all(x, '[0-9]+') = regexp_extract_all(y, '[0-9]+'))""",
        "venue_era": f"""{W}, e AS (SELECT * FROM (VALUES {", ".join(f"('{v}', {y}, '{a}')" for v, (_, es) in CONFERENCES.items() for y, a in es)}) t(conf, first, acronym)),
r AS (SELECT id, year, CASE venue WHEN 'EN' THEN 'NeurIPS' WHEN 'FR' THEN 'FAccT' ELSE 'ICML' END AS conf FROM papers)
SELECT r.id, arg_max(acronym, first) AS acronym FROM r LEFT JOIN e ON e.conf = r.conf AND e.first <= r.year GROUP BY r.id""",
        "url_parts": r"SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host, regexp_matches(url, '^https?://[^\s/?#]+\S*$') AS is_url, CAST(regexp_extract(url, '/(\d+)', 1) AS BIGINT) AS article FROM pages",
        "inflections": f"""{W}, {VOCAB} SELECT term, CASE WHEN length(term) > 4 AND ends_with(term, 'ies') THEN term[:-4] || 'y' WHEN length(term) > 4 AND regexp_matches(term, '(ss|sh|ch|x|z)es$') THEN term[:-3]
WHEN length(term) > 4 AND regexp_matches(term, '[^s]s$') THEN term[:-2] WHEN length(term) > 5 AND ends_with(term, 'ing') THEN term[:-4] WHEN length(term) > 4 AND ends_with(term, 'ed') THEN term[:-3] ELSE term END AS stem FROM (SELECT DISTINCT term FROM vocab)""",
        "one_line_titles": r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\p{Cc}', ' ', 'g'), '\s+', ' ', 'g'))) AS line_sha256 FROM documents",
        "bibtex_keys": f"""{W}, b AS (SELECT id, lower(venue) || CAST(year AS VARCHAR) || CASE WHEN regexp_matches(lower(title), '[a-z0-9]') THEN regexp_extract(lower(title), '([a-z0-9]+)', 1) ELSE 'untitled' END AS base FROM papers),
k AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n, count(*) OVER (PARTITION BY base) AS many FROM b)
SELECT id, CASE WHEN many = 1 THEN base WHEN n < 26 THEN base || chr(CAST(97 + n AS INTEGER)) ELSE base || chr(CAST(96 + n // 26 AS INTEGER)) || chr(CAST(97 + n % 26 AS INTEGER)) END AS bib_key FROM k""",
        "ris_export": f"""{W}, f AS (SELECT *, trim(regexp_replace(title, '[\\r\\n]+', ' ', 'g')) AS ti, trim(regexp_replace(coalesce(abstract, ''), '[\\r\\n]+', ' ', 'g')) AS ab FROM corpus WHERE {ranked})
SELECT id, concat_ws(chr(10), 'TY  - CONF', CASE WHEN ti <> '' THEN 'TI  - ' || ti END, CASE WHEN ab <> '' THEN 'AB  - ' || ab END, 'PY  - ' || CAST(year AS VARCHAR), 'T2  - ' || venue, 'ID  - ' || id, 'ER  - ') AS value FROM f""",
        "highlights": _bm25_sql().rsplit("\nSELECT", 1)[0]
        + """, top AS (SELECT id FROM scored ORDER BY scored.score DESC, id LIMIT 50),
f AS (SELECT id, 'title' AS field, regexp_extract_all(title, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') AS p FROM papers JOIN top USING (id) UNION ALL SELECT id, 'abstract', regexp_extract_all(abstract, '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+') FROM papers JOIN top USING (id) WHERE abstract IS NOT NULL),
w AS (SELECT id, field, unnest(p) AS w, unnest(range(len(p))) AS i FROM f),
r AS (SELECT id, field, w, CAST(sum(length(w)) OVER (PARTITION BY id, field ORDER BY i) AS BIGINT) AS stop FROM w)
SELECT id, field, stop - length(w) AS start, stop FROM r WHERE lower(strip_accents(w)) IN ('the', 'la', 'und')""",
        "html_text": f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<![^>]*>', '', 'g'), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?({"|".join(sorted(T.BLOCKS))})([ /][^>]*)?>', ' ', 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS h FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text FROM b""",
        "csv_export": f"""{W} SELECT id, concat_ws(',', {", ".join(f"CASE WHEN regexp_matches({c}, '[,\"' || chr(10) || chr(13) || ']') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END" for c in [f"(CASE WHEN left({v}, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) THEN chr(39) || {v} ELSE {v} END)" for v in [f"coalesce(CAST({n} AS VARCHAR), '')" for n in export.CSV_COLUMNS]])}) AS value
FROM corpus WHERE {ranked}""",
        "bibtex_export": f"""{W}, r AS (SELECT * FROM corpus WHERE {ranked}),
b AS (SELECT id, lower(venue) || CAST(year AS VARCHAR) || CASE WHEN regexp_matches(lower(title), '[a-z0-9]') THEN regexp_extract(lower(title), '([a-z0-9]+)', 1) ELSE 'untitled' END AS base FROM r),
k AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) - 1 AS n, count(*) OVER (PARTITION BY base) AS many FROM b),
f AS (SELECT r.id, venue, year, status, base || CASE WHEN many = 1 THEN '' WHEN n < 26 THEN chr(CAST(97 + n AS INTEGER)) ELSE chr(CAST(96 + n // 26 AS INTEGER)) || chr(CAST(97 + n % 26 AS INTEGER)) END AS bib_key,
 regexp_replace(trim(regexp_replace(title, '[\\r\\n]+', ' ', 'g')), '[{{}}\\\\]', '', 'g') AS ti, regexp_replace(trim(regexp_replace(coalesce(abstract, ''), '[\\r\\n]+', ' ', 'g')), '[{{}}\\\\]', '', 'g') AS ab FROM r JOIN k ON k.id = r.id)
SELECT id, concat_ws(chr(10), CASE WHEN status = 'accepted' THEN '@inproceedings{{' ELSE '@misc{{' END || bib_key || ',', CASE WHEN ti <> '' THEN '  title = {{' || ti || '}},' END, '  booktitle = {{' || venue || '}},', '  year = {{' || CAST(year AS VARCHAR) || '}},', CASE WHEN ab <> '' THEN '  abstract = {{' || ab || '}},' END, '}}') AS value FROM f""",
        "jsonl_export": f"""{W} SELECT id, '{{"abstract":' || coalesce(CAST(to_json(abstract) AS VARCHAR), 'null') || ',"abstract_kind":' || CAST(to_json(abstract_kind) AS VARCHAR) || ',"id":' || CAST(to_json(id) AS VARCHAR) || ',"status":' || CAST(to_json(status) AS VARCHAR) || ',"title":' || CAST(to_json(title) AS VARCHAR) || ',"track":' || CAST(to_json(track) AS VARCHAR) || ',"venue":' || CAST(to_json(venue) AS VARCHAR) || ',"year":' || CAST(year AS VARCHAR) || '}}' AS value
FROM corpus WHERE {ranked}""",
        "canonicalise": " UNION ALL ".join(f"SELECT '{name}' AS name, '{c}' AS canonical, sha256('{c}' || chr(0) || '3' || chr(0) || '2') AS canonical_hash, '{i}' AS identification" for name, (c, i) in _CANONICAL.items()),
        "match_ladder": f"""{W}, {_KEYED}, k AS (SELECT id, venue, year, track, t, CASE WHEN track = 'workshop' THEN id END AS forum, CASE WHEN track = 'main' THEN '10.1/' || CAST(year AS VARCHAR) || '.' || CAST(doc_id % 40 AS VARCHAR) END AS doi FROM keyed),
c AS (SELECT * FROM k WHERE track <> 'unknown'),
f AS (SELECT k.id AS ref_id, 0 AS o, 'forum_id' AS rule, c.id FROM k JOIN c ON k.forum = c.forum UNION ALL SELECT k.id, 2, 'doi', c.id FROM k JOIN c ON k.doi = c.doi AND k.venue = c.venue AND k.year = c.year
      UNION ALL SELECT k.id, 3, 'title', c.id FROM k JOIN c ON k.t = c.t AND k.t <> '' AND k.venue = c.venue AND k.year = c.year),
g AS (SELECT ref_id, o, rule, count(DISTINCT id) AS n, min(id) AS id FROM f GROUP BY ref_id, o, rule),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY o) AS r FROM g) WHERE r = 1)
SELECT k.id AS ref_id, CASE WHEN n = 1 THEN b.id END AS id, CASE WHEN n IS NULL THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE rule END AS rule FROM k LEFT JOIN b ON b.ref_id = k.id""",
        "comparison_partition": f"""{W}, a AS ({ids(the)} UNION ALL SELECT 'doc:gone'), b AS ({ids(and_)})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NOT NULL THEN 'kept' WHEN c.id IS NULL THEN 'not_in_index' ELSE 'dropped' END AS side FROM a FULL JOIN b ON a.id = b.id LEFT JOIN corpus c ON c.id = coalesce(a.id, b.id)""",
        "comparison_classes": f"""{W}, x AS (SELECT * FROM corpus WHERE {the} AND NOT {and_})
SELECT CASE WHEN status <> 'accepted' THEN 'filtered' WHEN abstract IS NULL THEN 'unsettled' WHEN contains(T_abstract, ' and') THEN 'stemming' ELSE 'full_text' END AS class, count(*) AS n FROM x GROUP BY 1""",
        "claim_rates": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type AS source, count(*) AS n FROM events GROUP BY 1, 2",
    }
    return out

