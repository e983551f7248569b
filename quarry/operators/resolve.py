"""Record integration: claims to fields, copies to one record, listings to reconciliation.

A claim says what one source states about one field of one record. Per field and
source the newest claim stands; per field the best-ranked source is shown.
Records of one paper merge over shared ids, titles or long abstracts of one
venue and year, unless something speaks against it: ambiguity never merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.tokens import tokens
from quarry.functions.vocab import STATUS_SOURCES, TEXT_SOURCES
from quarry.operators.components import connected_components
from quarry.session import materialize

MIN_ABSTRACT_TOKENS = 50
CONFLICT_FIELDS = ("title", "track", "status")
#: Sources that hold an earlier search's output, and statuses that no import may bring in.
IMPORTS = ("ris",)
REJECTED_LIKE = ("rejected", "withdrawn", "desk_rejected")
PROCEEDINGS_TRACKS = ("main", "datasets_benchmarks", "position")


def title_key(title: Column) -> Column:
    return F.array_join(tokens(title), " ")


def abstract_key(abstract: Column) -> Column:
    """Digest of an abstract's tokens, empty for fewer than 50."""
    found = tokens(abstract)
    return F.when(F.size(found) >= MIN_ABSTRACT_TOKENS, F.concat(F.lit("sha256:"), F.sha2(F.array_join(found, " "), 256))).otherwise("")


def source_rank(source: Column, field: Column) -> Column:
    def of(order: tuple[str, ...]) -> Column:
        return F.coalesce(F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])[source], F.lit(len(order)))

    return F.when(field == "status", of(STATUS_SOURCES)).otherwise(of(TEXT_SOURCES))


def newest(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the standing claim per record, field and source; the others as conflicts newest: or tie:)."""
    by = Window.partitionBy("record_id", "field", "source")
    ranked = claims.withColumn("n", F.row_number().over(by.orderBy(F.desc("fetched_at"), "value", "url"))).withColumn("last", F.max("fetched_at").over(by)).withColumn("shown", F.first("value").over(by.orderBy(F.desc("fetched_at"), "value", "url")))
    standing = ranked.where("n = 1").select(*claims.columns)
    lost = ranked.where("n > 1 and value <> shown")
    kind = F.when(F.col("fetched_at") == F.col("last"), "tie:").otherwise("newest:")
    conflicts = lost.select(F.col("record_id").alias("id"), "field", F.col("shown").alias("value_a"), F.col("source").alias("source_a"), F.col("value").alias("value_b"), F.col("source").alias("source_b"), F.concat(kind, "source").alias("resolution"))
    return standing, conflicts


def resolve(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((record_id, field, value, source) shown per field; conflict rows for title, track and status)."""
    standing, lost = newest(claims)
    ranked = standing.withColumn("rank", source_rank(F.col("source"), F.col("field")))
    best = F.min(F.struct("rank", "source", "value")).over(Window.partitionBy("record_id", "field"))
    ranked = ranked.withColumn("best", best)
    shown = ranked.where((F.col("rank") == F.col("best.rank")) & (F.col("source") == F.col("best.source"))).select("record_id", "field", "value", "source")
    differs = F.when(F.col("field") == "title", title_key(F.col("value")) != title_key(F.col("best.value"))).otherwise(F.col("value") != F.col("best.value"))
    rows = ranked.where(F.col("field").isin(list(CONFLICT_FIELDS)) & (F.col("source") != F.col("best.source")) & differs)
    conflicts = rows.select(F.col("record_id").alias("id"), "field", F.col("best.value").alias("value_a"), F.col("best.source").alias("source_a"), F.col("value").alias("value_b"), F.col("source").alias("source_b"), F.concat(F.lit("precedence:"), "best.source").alias("resolution"))
    return shown, conflicts.unionByName(lost).distinct()


def _clusters(records: DataFrame, member: DataFrame) -> DataFrame:
    """One row per cluster with what merging must respect. member: (id, cluster)."""
    joined = records.join(member, "id")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    found = joined.groupBy("cluster", "venue", "year").agg(
        flat("sources").alias("sources"),
        flat("forum_ids").alias("forum_ids"),
        flat("proceedings_ids").alias("proceedings_ids"),
        F.bool_or("crawled").alias("crawled"),
        F.collect_set("title_key").alias("titles"),
        F.collect_set("abstract_key").alias("abstracts"),
        F.min_by("status", "id").alias("status"),
        F.min_by("track", "id").alias("track"),
        F.bool_or("creative").alias("creative"),
    )
    own = F.filter("sources", lambda s: ~s.isin(list(IMPORTS)))
    listed = F.size("proceedings_ids") > 0
    waits = listed & (F.col("track") == "unknown") & ~F.exists("sources", lambda s: s.startswith("openreview"))
    family = F.when(F.col("creative"), "creative").when(F.col("track").isin(list(PROCEEDINGS_TRACKS)) | waits, "proceedings")
    return found.select(
        "cluster", "venue", "year", "titles", "abstracts", "forum_ids", "track", "status", "crawled",
        own.alias("own"), listed.alias("listed"), family.alias("family"),
        F.array_min("forum_ids").alias("forum_low"), F.array_max("forum_ids").alias("forum_high"),
        F.array_min("proceedings_ids").alias("listed_low"), F.array_max("proceedings_ids").alias("listed_high"),
    )


def _facts(parts: DataFrame, *by: str) -> DataFrame:
    """Per group, counts and extremes of its clusters: all that the rules ask, without gathering the clusters."""
    imported, bad = F.size("own") == 0, ~F.col("crawled") & F.col("status").isin(list(REJECTED_LIKE))
    return parts.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("cluster").alias("first"),
        F.sum(F.size("own")).alias("own_all"),
        F.size(F.array_distinct(F.flatten(F.collect_set("own")))).alias("own_distinct"),  # sources: a closed list
        F.min("forum_low").alias("forum_low"),
        F.max("forum_high").alias("forum_high"),
        F.min("listed_low").alias("listed_low"),
        F.max("listed_high").alias("listed_high"),
        F.count_if(imported).alias("imports"),
        F.count_if(imported & bad).alias("bad_imports"),
        F.count_if(~imported & bad).alias("bad_others"),
        F.bool_or("listed").alias("any_listed"),
        F.collect_set("family").alias("families"),
        F.collect_set(F.when(F.col("listed"), F.col("family"))).alias("listed_families"),
        F.count_if(F.col("family").isNull()).alias("no_family"),
        F.min(F.when(F.size("forum_ids") > 0, F.col("cluster"))).alias("with_forum"),
    )


def _refusal(linked: bool) -> Column:
    """Why the clusters of a group with these facts may not merge, or null. Linked groups share a forum id, which says which paper each is."""
    others = F.col("n") - F.col("imports")
    alone = (F.col("bad_others") > 0) & (others == 1) | (F.col("bad_imports") > 0) & (others == 0)  # all others are imports
    families = F.col("any_listed") & ((F.size("families") > 1) | (F.col("no_family") > 0))
    return (
        F.when(F.lit(not linked) & (F.col("own_all") > F.col("own_distinct")), "shared_source")
        .when(F.col("forum_low") < F.col("forum_high"), "two_forum_ids")
        .when(F.col("listed_low") < F.col("listed_high"), "two_proceedings_ids")
        .when(F.lit(not linked) & alone, "import_status")
        .when(families, "track_not_merged")
    )


RULES = {"forum_link": "forum_ids", "title_venue_year": "titles", "abstract_venue_year": "abstracts"}
_KEY = ("venue", "year", "key")


def _keyed(clusters: DataFrame, rule: str) -> DataFrame:
    """A row for each cluster and each key by which it may merge."""
    return clusters.withColumn("key", F.explode(F.array_distinct(F.col(RULES[rule])))).where("key <> ''")


def _judged(parts: DataFrame, rule: str) -> DataFrame:
    """The facts of each group of two or more clusters, with the refusal. Abstracts count only where an import takes part."""
    facts = _facts(parts, *_KEY).where("n > 1")
    return (facts.where("imports > 0") if rule == "abstract_venue_year" else facts).withColumn("refusal", _refusal(rule == "forum_link"))


def _aside(part_track: Column, part_status: Column) -> Column:
    """Whether a cluster can never be the paper that its group's listing names: its track keeps it from every listing there, or it was not accepted."""
    stranger = F.col("family").isNull() | (F.size("listed_families") > 0) & ~F.array_contains("listed_families", F.col("family"))
    return ~F.col("listed") & ((part_track != "unknown") & stranger | part_status.isin(list(REJECTED_LIKE)))


def _edges(clusters: DataFrame, rule: str) -> DataFrame:
    """(src, dst) between clusters that merge by a rule: whole groups, or, by title, those left when rivals of a listing are set aside."""
    parts = materialize(_keyed(clusters, rule), "parts")
    judged = materialize(_judged(parts, rule), "judged")
    fine = parts.join(judged.where("refusal is null").select(*_KEY, "first"), list(_KEY))
    edges = fine.select(F.col("first").alias("src"), F.col("cluster").alias("dst"))
    if rule == "title_venue_year":
        held = parts.join(judged.where("refusal is not null and any_listed").select(*_KEY, "listed_families"), list(_KEY))
        rest = materialize(held.where(~_aside(F.col("track"), F.col("status"))).drop("listed_families"), "rest")
        left = _judged(rest, rule).where("refusal is null").select(*_KEY, "first")
        edges = edges.unionByName(rest.join(left, list(_KEY)).select(F.col("first").alias("src"), F.col("cluster").alias("dst")))
    return materialize(edges.where("src <> dst").distinct(), "eredges")


def merge(records: DataFrame, max_rounds: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((id, cluster); merges (survivor_id, merged_id, rule); refused (rule, venue, year, key, id_a, id_b, resolution, refusal)).

    records: id, venue, year, title, abstract, track, status, sources, forum_ids, proceedings_ids; optional: crawled
    (a listing by evidence of its own; else: it has a proceedings id and a source that is no import), creative.
    Steps repeat until nothing merges. The cluster is the smallest id with a forum id, else the smallest. A group that
    is refused stays apart and is reported, each other cluster against the first.
    """
    own = F.exists("sources", lambda s: ~s.isin(list(IMPORTS)))
    crawled = F.col("crawled") if "crawled" in records.columns else (F.size("proceedings_ids") > 0) & own
    creative = F.col("creative") if "creative" in records.columns else F.lit(False)
    keyed = records.withColumn("title_key", title_key(F.col("title"))).withColumn("abstract_key", abstract_key(F.col("abstract")))
    keyed = materialize(keyed.withColumn("crawled", F.coalesce(crawled, F.lit(False))).withColumn("creative", F.coalesce(creative, F.lit(False))), "er")
    member = keyed.select("id", F.col("id").alias("cluster")).distinct()
    # The same id again is the same record: a row per extra copy.
    copies = keyed.groupBy("id").agg(F.count("*").alias("n"), F.max(F.size("forum_ids") > 0).alias("forum")).where("n > 1")
    again = F.explode(F.sequence(F.lit(2).cast("long"), "n"))
    merges = copies.select("id", "forum", again.alias("copy")).select(F.col("id").alias("survivor_id"), F.col("id").alias("merged_id"), F.when(F.col("forum"), "forum_id").otherwise("native_id").alias("rule"))
    clusters = None
    for _ in range(max_rounds):
        moved = False
        for rule in RULES:
            clusters = materialize(_clusters(keyed, member), "clusters", replaces=clusters)
            edges = _edges(clusters, rule)
            if edges.isEmpty():
                continue
            found = materialize(connected_components(edges), "found")
            # A chain of allowed groups may still join what must stay apart: the whole component is judged again.
            parts = clusters.join(found, F.col("cluster") == F.col("node"))
            judged = _facts(parts, "component").where(_refusal(rule == "forum_link").isNull())
            names = judged.select("component", F.coalesce("with_forum", "first").alias("survivor"))
            moving = materialize(found.join(names, "component").where("node <> survivor").select("node", "survivor"), "moving")
            if moving.isEmpty():
                continue
            rows = moving.select(F.col("survivor").alias("survivor_id"), F.col("node").alias("merged_id"), F.lit(rule).alias("rule"))
            merges = merges.unionByName(rows)
            moved_on = member.join(moving.withColumnRenamed("node", "cluster"), "cluster", "left")
            member = materialize(moved_on.select("id", F.coalesce("survivor", "cluster").alias("cluster")), "member", replaces=member)
            moved = True
        if not moved:
            break
    else:
        raise RuntimeError("merging did not settle")
    final = materialize(_clusters(keyed, member), "clusters")
    refused = None
    for rule in RULES:
        parts = _keyed(final, rule)
        judged = _judged(parts, rule).where("refusal is not null").select(*_KEY, "first", "refusal")
        resolution = F.when(F.col("refusal") == "track_not_merged", "track_not_merged").otherwise("ambiguous_not_merged")
        rows = parts.select(*_KEY, "cluster").join(judged, list(_KEY)).where("cluster <> first")
        rows = rows.select(F.lit(rule).alias("rule"), *_KEY, F.col("first").alias("id_a"), F.col("cluster").alias("id_b"), resolution.alias("resolution"), "refusal")
        refused = rows if refused is None else refused.unionByName(rows)
    return member, merges, refused


def follow_merges(ids: DataFrame, merges: DataFrame) -> DataFrame:
    """(id, survivor_id): the record that each id ended in, over merges of merges; its own where none took it."""
    merges = merges.where("survivor_id <> merged_id")
    if merges.isEmpty():
        return ids.select("id", F.col("id").alias("survivor_id")).distinct()
    groups = connected_components(merges.select(F.col("survivor_id").alias("src"), F.col("merged_id").alias("dst")))
    ended = groups.join(merges.select(F.col("merged_id").alias("node")).distinct(), "node", "left_anti").select("component", F.col("node").alias("survivor_id"))
    named = groups.join(ended, "component").select(F.col("node").alias("id"), "survivor_id")
    return ids.select("id").distinct().join(named, "id", "left").select("id", F.coalesce("survivor_id", "id").alias("survivor_id"))


def survivor(group: DataFrame, by: str) -> DataFrame:
    """(by, survivor): an id with a forum id first, else the smallest."""
    return group.groupBy(by).agg(F.min(F.struct(~F.col("has_forum"), F.col("id"))).alias("s")).select(by, F.col("s.id").alias("survivor"))


def unlisted(records: DataFrame, listings: DataFrame) -> DataFrame:
    """Accepted records of a covered (venue, year, track) that share neither title key nor forum id with a complete listing.

    listings: venue, year, track, title_key, forum_id, complete.
    """
    whole = listings.where("complete")
    covered = whole.select("venue", "year", "track").distinct()
    rows = records.where("status = 'accepted'").join(covered, ["venue", "year", "track"], "left_semi")
    names = whole.select("venue", "year", "title_key").where("title_key <> ''").distinct()
    forums = whole.select("venue", "year", F.col("forum_id").alias("listed_forum")).where("listed_forum is not null").distinct()
    rows = rows.join(names, ["venue", "year", "title_key"], "left_anti")
    on = (rows["venue"] == forums["venue"]) & (rows["year"] == forums["year"]) & (rows["forum_id"] == forums["listed_forum"])
    return rows.join(forums, on, "left_anti")


def complete_crawls(reports: DataFrame) -> DataFrame:
    """(source, venue, year, complete): every listing of the crawl found what it stated and skipped nothing."""
    fine = (F.col("stated") == F.col("found")) & (F.col("skipped") == 0) & (F.col("unfollowed") == 0)
    return reports.groupBy("source", "venue", "year").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("complete"))


def fill_abstracts(records: DataFrame, works: DataFrame) -> DataFrame:
    """records with null abstracts filled: by DOI where all works of it agree, else by a title that one record and one work share.

    records: id, doi, venue, year, title_key, abstract. works: doi, venue, year, title_key, abstract.
    """
    by_doi = works.where("doi is not null and abstract is not null").groupBy(F.lower("doi").alias("w_doi")).agg(F.count_distinct("abstract").alias("texts"), F.min("abstract").alias("doi_text"))
    one = works.where("doi is null and abstract is not null and title_key <> ''").groupBy("venue", "year", "title_key").agg(F.count("*").alias("works"), F.min("abstract").alias("title_text"))
    alone = records.groupBy("venue", "year", "title_key").agg(F.count("*").alias("sharers"))
    rows = records.join(by_doi, F.lower("doi") == F.col("w_doi"), "left").join(one, ["venue", "year", "title_key"], "left").join(alone, ["venue", "year", "title_key"], "left")
    reason = (
        F.when(F.col("abstract").isNotNull(), "had_abstract")
        .when(F.col("w_doi").isNotNull() & (F.col("texts") > 1), "doi_duplicate")
        .when(F.col("w_doi").isNotNull(), "doi")
        .when(F.col("works").isNull(), "no_work")
        .when((F.col("works") > 1) | (F.col("sharers") > 1), "title_ambiguous")
        .otherwise("title")
    )
    rows = rows.withColumn("how", reason)
    text = F.when(F.col("how") == "doi", F.col("doi_text")).when(F.col("how") == "title", F.col("title_text")).otherwise(F.col("abstract"))
    return rows.withColumn("abstract", text).select(*records.columns, "how")


def same_paper(listed: DataFrame, links: DataFrame) -> DataFrame:
    """(id): everything reachable from the listed ids over merges, twins and shared native ids (src, dst)."""
    groups = materialize(connected_components(links), "paper")
    reached = groups.join(listed.select(F.col("id").alias("node")), "node", "left_semi").select("component").distinct()
    return groups.join(reached, "component", "left_semi").select(F.col("node").alias("id")).unionByName(listed.select("id")).distinct()


def withhold(records: DataFrame, ids: DataFrame) -> DataFrame:
    """records whose abstracts are nulled where the id is listed, with ``withheld``."""
    marked = records.join(ids.select("id", F.lit(True).alias("withheld")).distinct(), "id", "left")
    hidden = F.coalesce("withheld", F.lit(False))
    return marked.withColumn("abstract", F.when(~hidden, F.col("abstract"))).withColumn("withheld", hidden)


def near_titles(rows: DataFrame) -> DataFrame:
    """(id_a, id_b, distance, verdict): all pairs of one venue and year whose title keys ``k`` are equal or alike.

    Likeness of 0.9 allows a tenth of the longer key as edits, and every edit breaks at most one of the pieces it is
    cut into. So the shorter key must hold at least as many of the pieces as there are more pieces than edits, and be
    at most a tenth shorter. Keys are compared once each, whatever the number of their rows.
    """
    digits = F.regexp_extract_all("k", F.lit(r"\d+"), F.lit(0))
    keys = rows.groupBy("venue", "year", "k").agg(F.count("*").alias("rows")).withColumn("no", F.monotonically_increasing_id())
    keys = materialize(keys.withColumn("n", F.char_length("k")).withColumn("digits", digits), "title-keys")
    sides = keys.where("n >= 10").select("no", "n", "k", F.encode("k", "UTF-8").alias("bytes"), F.xxhash64("venue", "year", "digits").alias("scope"))

    def size(n: Column) -> Column:
        """Letters of a piece: of n letters there are more pieces than a tenth of n."""
        return F.when(n < 20, 5).when(n < 30, 6).when(n < 40, 7).when(n < 90, 8).otherwise(9)

    def cuts(q: Column, step: Column) -> Column:
        def hashed(at):
            return F.xxhash64("scope", F.when(F.length("bytes") == F.col("n"), F.substring("bytes", at, q)).otherwise(F.encode(F.substring("k", at, q), "UTF-8")))

        return F.when(F.col("n") >= q, F.transform(F.sequence(F.lit(1), F.col("n") - q + 1, step), hashed)).otherwise(F.array().cast("array<bigint>"))

    n = F.col("n")
    edits, q, longer = F.floor(n / 10).cast("int"), size(n), size(F.floor(n * 10 / 9).cast("int") + 1)
    pieces = sides.select(F.col("no").alias("a"), n.alias("a_n"), (n - edits).alias("least"), (F.floor(n / q).cast("int") - edits).alias("need"), F.explode(cuts(q, q)).alias("h"))
    one = F.lit(1)
    grams = F.when(q == longer, cuts(q, one)).otherwise(F.concat(cuts(q, one), cuts(longer, one)))
    held = sides.select(F.col("no").alias("b"), n.alias("b_n"), F.explode(F.array_distinct(grams)).alias("h"))
    met = pieces.join(held, "h").where("b_n >= least and (b_n < a_n or b_n = a_n and b < a)")
    pairs = met.groupBy("a", "b").agg(F.count("*").alias("met"), F.first("need").alias("need")).where("met >= need").select("a", "b")

    one_side = lambda x: keys.select(*[F.col(c).alias(f"{x}_{c}") for c in ("no", "venue", "year", "k", "digits", "n")])
    alike = pairs.join(one_side("a"), F.col("a") == F.col("a_no")).join(one_side("b"), F.col("b") == F.col("b_no"))
    alike = alike.where("a_venue <=> b_venue and a_year <=> b_year and a_digits = b_digits")
    alike = alike.select("a", "b", F.expr("levenshtein(a_k, b_k, cast(floor(a_n / 10) as int))").cast("long").alias("distance")).where("distance >= 0")
    alike = materialize(alike, "near-titles")

    named = rows.select("id", F.col("venue").alias("v"), F.col("year").alias("y"), F.col("k").alias("key"))
    members = named.join(keys.select("venue", "year", "k", "no", "rows"), F.col("v").eqNullSafe(F.col("venue")) & F.col("y").eqNullSafe(F.col("year")) & (F.col("key") == F.col("k")))
    members = materialize(members.select("id", "no", "rows"), "title-members")
    a, b = members.select(F.col("id").alias("x"), F.col("no").alias("a")), members.select(F.col("id").alias("z"), F.col("no").alias("b"))
    same = members.where("rows > 1")
    exact = same.select(F.col("id").alias("x"), "no").join(same.select(F.col("id").alias("z"), "no"), "no").where("x < z")
    exact = exact.select(F.col("x").alias("id_a"), F.col("z").alias("id_b"), F.lit(0).cast("long").alias("distance"), F.lit("exact").alias("verdict"))
    similar = alike.join(a, "a").join(b, "b").select(F.least("x", "z").alias("id_a"), F.greatest("x", "z").alias("id_b"), "distance", F.lit("similar").alias("verdict"))
    return exact.unionByName(similar)
