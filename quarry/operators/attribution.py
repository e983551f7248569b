"""Where an abstract came from, the kinds of crawl windows, one-to-one matches of entries and papers, takedown lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import host, names_native
from quarry.functions.vocab import TEXT_SOURCES
from quarry.operators.resolve import source_rank

#: The site that published what a source holds; sources whose own url is no paper's page.
ORIGINS = {
    "openreview_v2": "openreview", "openreview_v1": "openreview", "neurips_proceedings": "neurips_proceedings", "pmlr": "pmlr", "iclr_archive": "iclr_archive",
    "icml_site": "icml_site", "ojs": "ojs", "crossref": "crossref", "facct_site": "facct_site", "openalex": "openalex", "aaai_library": "aaai_library",
}
BY_PROCEEDINGS_LINK = ("ojs", "crossref", "facct_site", "openalex")
SITE_ORIGINS = {"proceedings.neurips.cc": "neurips_proceedings", "papers.nips.cc": "neurips_proceedings", "papers.neurips.cc": "neurips_proceedings", "proceedings.iclr.cc": "iclr_proceedings", "proceedings.mlr.press": "pmlr"}
#: How an import names its route, and what marks an abstract as submitted.
ROUTE = r"^[a-z]+:(openreview_api|proceedings_page)(?: (\S+))?"
AS_SUBMITTED = "submission-time abstract"
#: Sources whose dates are those of queries; the kinds of window.
QUERY_SOURCES = ("ris",)
LOCAL, UTC, CRAWL, MIXED, MIXED_UTC, CAPTURES = "scholar_query_dates", "scholar_query_dates_utc", "crawl", "mixed", "mixed_utc", "archive_captures"


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def credited(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, source, url, evidence): of the abstract claims that hold exactly the text shown, the best-ranked; nothing where none does.

    records: id, abstract; claims: record_id, field, source, value, url, evidence.
    """
    held = claims.where((F.col("field") == "abstract") & F.col("source").isin(list(TEXT_SOURCES)))
    same = records.where("abstract is not null").select("id", "abstract").join(held, (F.col("id") == F.col("record_id")) & (F.col("abstract") == F.col("value")))
    rank = source_rank(F.col("source"), F.lit("abstract"))
    best = F.min(F.struct(rank.alias("rank"), "source", "url", "evidence"))
    return same.groupBy("id").agg(best.alias("b")).select("id", "b.source", "b.url", "b.evidence")


def archived_original(capture: Column) -> Column:
    """The page that an archive's raw capture is a copy of, else null."""
    return F.nullif(F.regexp_extract(capture, r"^https://web\.archive\.org/web/[0-9]{14}id_/(https?://\S+)$", 1), F.lit(""))


def attribution(records: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, source, origin, url, as_submitted) of every record whose abstract a claim holds.

    records: id, abstract, forum, proceedings (links or null), native. An import names its route in its evidence: the
    forum, or the page it was read from, whose site decides; that page is linked if it is this paper's.
    """
    rows = records.select("id", "forum", "proceedings", "native").join(credited(records, claims), "id")
    own = _lookup(ORIGINS, F.col("source"))
    via, page = F.regexp_extract("evidence", ROUTE, 1), F.nullif(F.regexp_extract("evidence", ROUTE, 2), F.lit(""))
    said, held = _lookup(SITE_ORIGINS, host(page)), _lookup(SITE_ORIGINS, host(F.col("proceedings")))
    on_site = held.isNotNull() & (page.isNull() | (said == held))
    origin = F.coalesce(own, F.when(via == "openreview_api", "openreview").when((via == "proceedings_page") & on_site, held).when(via == "proceedings_page", said))
    link = (
        F.when(own == "openreview", F.col("forum"))
        .when(own.isin(list(BY_PROCEEDINGS_LINK)), F.col("proceedings"))
        .when(own == "aaai_library", archived_original(F.col("url")))
        .when(own.isNotNull(), F.col("url"))
        .when(via == "openreview_api", F.col("forum"))
        .when((via == "proceedings_page") & on_site, F.col("proceedings"))
        .when((via == "proceedings_page") & held.isNull() & names_native(page, F.col("native")), page)
    )
    submitted = F.coalesce((own == "icml_site") & F.contains(F.coalesce("evidence", F.lit("")), F.lit(AS_SUBMITTED)), F.lit(False))
    return rows.select("id", "source", origin.alias("origin"), link.alias("url"), submitted.alias("as_submitted"))


def page_attributions(ids: DataFrame, attributions: DataFrame) -> DataFrame:
    """Each id of a page with its attribution, null where it has none."""
    return ids.select("id").distinct().join(attributions, "id", "left")


def window_kind(sources: Column, converted: Column) -> Column:
    """The kind of a window over some sources: of fetches, of query dates (local, or all converted to UTC), or mixed."""
    query = F.filter(sources, lambda s: s.isin(list(QUERY_SOURCES)))
    local = F.exists(query, lambda s: ~F.array_contains(converted, s))
    crawled = F.size(query) < F.size(sources)
    return F.when(F.size(query) == 0, CRAWL).when(~crawled, F.when(local, LOCAL).otherwise(UTC)).when(local, MIXED).otherwise(MIXED_UTC)


def window_kinds(claims: DataFrame, converted: list[str] = [], captures: list[str] = []) -> DataFrame:  # noqa: B006
    """(window, kind): of each source's window, and of ``*``, the one over all sources."""
    utc = F.array(*map(F.lit, converted)) if converted else F.array().cast("array<string>")
    own = claims.select("source").distinct()
    kinds = own.select(F.col("source").alias("window"), F.when(F.col("source").isin(captures) if captures else F.lit(False), CAPTURES).otherwise(window_kind(F.array("source"), utc)).alias("kind"))
    return kinds.unionByName(own.agg(F.collect_set("source").alias("s")).select(F.lit("*").alias("window"), window_kind(F.col("s"), utc).alias("kind")))


def match_entries(papers: DataFrame, entries: DataFrame, by: str) -> DataFrame:
    """(entry_id, id, verdict): site entries matched to papers one to one by ``doi`` or ``title_key``: matched, ambiguous or unmatched.

    A key that two entries share matches none, nor does a title that two papers share. entries: entry_id, the key,
    usable; an entry that is not usable (no title or text) still makes its key ambiguous, and is not returned.
    """
    key = F.lower(F.col(by)) if by == "doi" else F.col(by)
    held = papers.where(key.isNotNull() & (key != "")).groupBy(key.alias("k")).agg(F.count("*").alias("papers"), F.min("id").alias("paper"))
    asked = entries.withColumn("k", F.when(key != "", key)).withColumn("entries", F.count("*").over(Window.partitionBy("k")))
    joined = asked.where("usable").join(held, "k", "left")
    many = (F.col("entries") > 1) | (F.lit(by != "doi") & (F.col("papers") > 1))
    verdict = F.when(F.col("papers").isNull(), "unmatched").when(many, "ambiguous").otherwise("matched")
    return joined.select("entry_id", F.when(verdict == "matched", F.col("paper")).alias("id"), verdict.alias("verdict"))


def deterministic_sample(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n records in id order, drawn by a hash of id and seed: the same on every run, whatever the partitions."""
    return records.orderBy(F.md5(F.concat_ws(":", "id", F.lit(str(seed)))), "id").limit(n).orderBy("id")


def disagreement(one: DataFrame, other: DataFrame, names: tuple[str, str] = ("one", "other")) -> DataFrame:
    """(id, only_in): what one of two match sets holds and the other does not."""
    a, b = one.select("id").distinct(), other.select("id").distinct()
    return a.join(b, "id", "left_anti").withColumn("only_in", F.lit(names[0])).unionByName(b.join(a, "id", "left_anti").withColumn("only_in", F.lit(names[1])))


def takedown_problems(listed: DataFrame, records: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, problem): listed ids that name no record and were merged into none, or that stand twice."""
    known = records.select("id").unionByName(merges.select(F.col("merged_id").alias("id"))).distinct()
    counts = listed.groupBy("id").agg(F.count("*").alias("n")).join(known.withColumn("known", F.lit(True)), "id", "left")
    problem = F.when(F.col("known").isNull(), "unknown_id").when(F.col("n") > 1, "listed_twice")
    return counts.select("id", problem.alias("problem")).where("problem is not null")
