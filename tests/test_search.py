import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.tokens import normalize
from quarry.functions.vocab import Vocabulary
from quarry.operators.compile import TooManyExpansions, expand, predicate
from quarry.operators.corpus import postings
from quarry.operators.highlight import highlight, matches, spans
from quarry.operators.search import Index
from quarry.plans.ast import And, Filter, Near, Not, Or, Phrase, Term, Wildcard, YearRange
from quarry.plans.canonical import canonicalize, render

WORDS = "trust trustworthy trusted benchmark benchmarks benchmarking model models modeling reliance évaluation naïve the of calibration 𝐀x".split()
VALUES = Vocabulary(venues=("ICLR", "ICML"))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for i in range(120):
        text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
        abstract = None if i % 17 == 0 else text(rng.randint(0, 14))
        out.append((f"fx:{i:04}", text(rng.randint(1, 5)), abstract, rng.choice(("ICLR", "ICML")), 2019 + i % 6, rng.choice(("main", "workshop", "unknown", "position")), rng.choice(("accepted", "rejected", "unknown")), "none" if abstract is None else "official"))
    out.append(("fx:9999", "calibration of trust reliance", "evaluation trust", "ICLR", 2020, "main", "accepted", "official"))
    return out


@pytest.fixture(scope="module")
def index(spark, rows):
    return Index.build(spark.createDataFrame(rows, "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"), VALUES)


def naive(rows, tree):
    names = ("id", "title", "abstract", "venue", "year", "track", "status", "abstract_kind")
    out = set()
    for r in rows:
        record = dict(zip(names, r))
        if tree is None or matches(record, {f: normalize(record[f]) for f in ("title", "abstract")}, tree):
            out.add(record["id"])
    return out


def tree_of(rng, depth=0):
    field = rng.choice((None, None, "title", "abstract"))
    token = lambda: normalize(rng.choice(WORDS))[0]

    def item(f=None):
        return Term(token(), f) if rng.random() < 0.6 else Wildcard(token()[:5], rng.choice("*$"), f)

    def leaf(f=None):
        return item(f) if rng.random() < 0.5 else Phrase(tuple(item() for _ in range(rng.randint(2, 3))), f)

    kind = rng.random()
    if depth < 2 and kind < 0.45:
        make = rng.choice((And, Or))
        return make(tuple(tree_of(rng, depth + 1) for _ in range(rng.randint(2, 3))))
    if depth < 2 and kind < 0.55:
        return Not(tree_of(rng, depth + 1))
    if kind < 0.65:
        return rng.choice((Filter("venue", ("ICLR",)), Filter("year", (YearRange(2019, 2020), YearRange(2023, 2023))), Filter("track", ("main", "workshop"))))
    if kind < 0.8:
        return Near(leaf(field), leaf(field), rng.randint(0, 3), field)
    return leaf(field)


def test_predicates_equal_naive_matching(spark, index, rows):
    rng = random.Random(11)
    trees = [tree_of(rng) for _ in range(60)]
    flags = index.corpus.select("id", *[predicate(t).alias(f"t{i}") for i, t in enumerate(trees)]).collect()
    for i, t in enumerate(trees):
        assert {r["id"] for r in flags if r[f"t{i}"]} == naive(rows, t), render(canonicalize(t))


def test_canonical_form_keeps_the_set(index, rows):
    rng = random.Random(12)
    for _ in range(60):
        t = tree_of(rng)
        assert naive(rows, t) == naive(rows, canonicalize(t))


def test_edges(index):
    ids = lambda q: {r["id"] for r in index.match(q + " track:(main OR workshop OR unknown OR position) status:(accepted OR rejected OR unknown)").select("id").collect()}
    assert "fx:9999" not in ids('"reliance evaluation"')
    assert "fx:9999" in ids('"trust reliance"')
    assert "fx:9999" not in ids("trust NEAR/0 trust")
    assert ids("benchmark$") >= ids("benchmark") | ids("benchmarks")
    assert not ids("zzzzz*")


def test_facets_and_exclusions(index, rows):
    found = index.parse("trust OR model$")
    facets = {(r["field"], r["value"]): r["n"] for r in index.facets(found.effective).collect()}
    names = ("id", "title", "abstract", "venue", "year", "track", "status", "abstract_kind")
    by_id = {r[0]: dict(zip(names, r)) for r in rows}
    for i, f in enumerate(("track", "status")):
        kept = And(tuple(c for c in found.effective.children if not (isinstance(c, Filter) and c.field == f)))
        expected = {}
        for x in naive(rows, kept):
            expected[by_id[x][f]] = expected.get(by_id[x][f], 0) + 1
        assert {v: n for (g, v), n in facets.items() if g == f} == expected
    totals = index.totals(found).first()
    buckets = index.exclusions(found).collect()
    assert totals["total"] == len(naive(rows, found.effective)) and totals["identified"] == len(naive(rows, found.identification))
    assert sum(r["n"] for r in buckets) == totals["removed"] == totals["identified"] - totals["total"]
    assert {("track", "unknown"), ("status", "unknown")} <= {(r["field"], r["value"]) for r in buckets}


def test_group_counts(index, rows):
    found = index.parse("(trust OR model*) calibration NOT reliance")
    counts = {r["group_no"]: (r["alone"], r["without"]) for r in index.group_counts(found.effective).collect()}
    a, b, *kept = found.effective.children
    assert counts[0] == (len(naive(rows, And((a, *kept)))), len(naive(rows, And((b, *kept)))))
    assert counts[1] == (len(naive(rows, And((b, *kept)))), len(naive(rows, And((a, *kept)))))


def test_expansion_cap(spark, index):
    vocab = spark.createDataFrame([("title", f"qca{i:03}") for i in range(200)] + [("title", f"qcb{i:03}") for i in range(201)], "field string, term string")
    assert len(expand(vocab, Wildcard("qca", "*"))["qca", "*"]) == 200
    with pytest.raises(TooManyExpansions):
        expand(vocab, Not(Wildcard("qcb", "*")))


def test_bm25_by_hand(spark):
    import math

    rows = [("a", "trust trust model", None), ("b", "model", "trust"), ("c", "other words", None)]
    full = [(i, t, x, "ICLR", 2020, "main", "accepted", "official") for i, t, x in rows]
    index = Index.build(spark.createDataFrame(full, "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"), VALUES)
    page = {r["id"]: r["score"] for r in index.page("trust").collect()}
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    mean_t, mean_a = 2.0, 1 / 3
    assert page["a"] == pytest.approx(2 * idf(1) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean_t)), abs=1e-8)
    assert page["b"] == pytest.approx(idf(1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / mean_a)), abs=1e-8)


def test_pages_partition_the_match_set(index):
    for sort in ("relevance", "year_desc", "year_asc", "title"):
        whole = [r["id"] for r in index.page("trust OR the", sort, 0, 1000).collect()]
        parts = [r["id"] for o in range(0, len(whole) + 7, 7) for r in index.page("trust OR the", sort, o, 7).collect()] if sort == "relevance" else whole
        assert parts == whole and len(set(whole)) == len(whole)
    with pytest.raises(ValueError):
        index.page("trust", "newest")


def test_highlights(index):
    found = index.parse('"trust reliance" OR zzz')
    rows = highlight(index.page('"trust reliance"', limit=200), found.effective).where("id = 'fx:9999'").collect()
    assert [(r["field"], r["start"], r["stop"]) for r in rows] == [("title", 15, 29)]
    assert spans({"title": "x", "abstract": None, "venue": "ICLR", "year": 2020, "track": "main", "status": "accepted", "abstract_kind": "none"}, Term("y")) is None


def test_postings(index):
    row = postings(index.corpus).where((F.col("id") == "fx:9999") & (F.col("term") == "trust") & (F.col("field") == "title")).first()
    assert row["positions"] == [2]


SCHEMA = "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"


def test_postings_find_the_same(spark, rows, tmp_path):
    """Candidates from postings are verified: the same matches as a scan, also laid out by venue and year."""
    from quarry.operators import search

    share, search.CANDIDATE_SHARE = search.CANDIDATE_SHARE, 1.0
    large, search.LAYOUT_ROWS = search.LAYOUT_ROWS, 10
    try:
        found = Index.build(spark.createDataFrame(rows, SCHEMA), VALUES, path=str(tmp_path / "index"), with_postings=True)
        rng = random.Random(21)
        used = 0
        for _ in range(12):
            t = tree_of(rng)
            used += found.candidates(t) is not None
            assert {r["id"] for r in found.match(t).select("id").collect()} == naive(rows, t), render(canonicalize(t))
        assert used > 3
        assert "PartitionFilters" in found.corpus.where("venue = 'ICLR'")._jdf.queryExecution().toString()
    finally:
        search.CANDIDATE_SHARE, search.LAYOUT_ROWS = share, large


def test_index_opens_again(spark, rows, tmp_path):
    from quarry.operators.search import IndexMismatch, index_version

    path = str(tmp_path / "index")
    built = Index.build(spark.createDataFrame(rows, SCHEMA), VALUES, "snap", path)
    again = Index.open(spark, path, verify=True)
    assert again.version == built.version == index_version("snap") and again.count("trust") == built.count("trust")
    assert again.values.values["venue"] == ("ICLR", "ICML") and again.meta()["records"] == len(rows)
    assert again.parity().count() == 0
    assert again.record("fx:0003")["title"] == rows[3][1] and again.record("none") is None
    some = spark.createDataFrame([("fx:0001",), ("fx:0002",), ("fx:0002",), ("gone",)], "id string")
    assert again.records(some).count() == 2 and again.count_value(some, "venue", rows[1][3]) == sum(r[3] == rows[1][3] for r in rows[1:3])
    assert again.token_streams(some).count() == sum(len(normalize(r[1])) + len(normalize(r[2])) for r in rows[1:3])
    with pytest.raises(Exception):
        Index.build(spark.createDataFrame(rows, SCHEMA), VALUES, "snap", path)  # never overwritten
    spark.createDataFrame(rows[:1], SCHEMA).withColumn("T_title", F.lit(" x ")).withColumn("T_abstract", F.lit("")).select("id", "T_title", "T_abstract").write.mode("append").parquet(path + "/corpus")
    with pytest.raises(IndexMismatch):
        Index.open(spark, path, verify=True)


def test_ranks(index, rows):
    import unicodedata as ud

    fold = lambda r: (ud.normalize("NFKC", r[1]).casefold(), r[0])
    got = {r["id"]: (r["ord"], r["title_rank"]) for r in index.ranks().collect()}
    ids = sorted(r[0] for r in rows)
    titles = [r[0] for r in sorted(rows, key=fold)]
    assert got == {i: (ids.index(i), titles.index(i)) for i in ids}
    page = [r["id"] for r in index.page("trust OR model OR the", "title", 0, 200).collect()]
    assert page == [i for i in titles if i in set(page)]


def test_ids_hash(index, rows):
    import hashlib

    ids = sorted(naive(rows, Term("trust")))
    assert index.ids_hash(Term("trust")).first()[0] == hashlib.sha256("\n".join(ids).encode()).hexdigest()
    assert index.ids_hash(Term("absent")).first()[0] == hashlib.sha256(b"").hexdigest()


def test_stored_lengths(spark):
    from quarry.operators.compile import stored_length

    # Lengths and what one byte keeps of them.
    known = {0: 0, 1: 1, 24: 24, 39: 39, 40: 40, 41: 40, 42: 42, 43: 42, 55: 54, 56: 56, 59: 56, 60: 60, 87: 84, 88: 88, 95: 88, 100: 96, 120: 120, 1000: 984}
    got = {r["n"]: r["s"] for r in spark.createDataFrame([(n,) for n in known], "n int").select("n", stored_length(F.col("n")).alias("s")).collect()}
    assert got == known
