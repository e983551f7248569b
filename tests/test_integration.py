import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import compare, resolve, snapshot
from quarry.operators.components import connected_components
from quarry.sources import export
from quarry.sources.ris import read_ris
from quarry.sources.tables import listing, page_track, read_works
from quarry.streaming.standing import claim_rates, fresh_claims, standing_query


def one(spark, schema, rows, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_components(spark):
    edges = [(1, 2), (3, 2), (4, 5), (6, 6), (5, 4), (None, 1)] + [(i, i + 1) for i in range(100, 160)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {i: 100 for i in range(100, 161)}


def test_claims(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    rows = [
        ("r1", "title", "dblp", "Old", None, at(1)),
        ("r1", "title", "dblp", "New title", None, at(2)),
        ("r1", "title", "openreview_v2", "NEW TITLE", None, at(1)),
        ("r1", "status", "openreview_v2", "rejected", None, at(1)),
        ("r1", "status", "pmlr", "accepted", None, at(1)),
        ("r2", "track", "ris", "main", None, at(1)),
    ]
    shown, conflicts = resolve.resolve(spark.createDataFrame(rows, "record_id string, field string, source string, value string, url string, fetched_at timestamp"))
    assert {(r["record_id"], r["field"]): (r["value"], r["source"]) for r in shown.collect()} == {("r1", "title"): ("NEW TITLE", "openreview_v2"), ("r1", "status"): ("accepted", "pmlr"), ("r2", "track"): ("main", "ris")}
    assert {(r["field"], r["value_b"], r["resolution"]) for r in conflicts.collect()} == {("title", "Old", "newest:dblp"), ("status", "rejected", "precedence:pmlr")}


def records(spark, rows):
    schema = "id string, venue string, year int, title string, abstract string, track string, status string, sources array<string>, forum_ids array<string>, proceedings_ids array<string>"
    return spark.createDataFrame(rows, schema)


def test_merging(spark):
    rows = [
        ("a", "ICLR", 2020, "One Title", None, "main", "accepted", ["openreview_v2"], ["F1"], []),
        ("b", "ICLR", 2020, "one title!", None, "main", "accepted", ["pmlr"], [], ["P1"]),
        ("c", "ICLR", 2020, "Other", None, "main", "accepted", ["ris"], ["F1"], []),
        ("d", "ICLR", 2020, "Twice", None, "main", "accepted", ["dblp"], [], []),
        ("e", "ICLR", 2020, "Twice", None, "main", "accepted", ["dblp"], [], []),
        ("f", "ICLR", 2020, "Track", None, "workshop", "accepted", ["openreview_v2"], [], []),
        ("g", "ICLR", 2020, "Track", None, "main", "accepted", ["pmlr"], [], ["P2"]),
        ("h", "ICLR", 2021, "One title", None, "main", "accepted", ["pmlr"], [], []),
        ("i", "ICLR", 2022, "Left name", "w " * 60, "main", "accepted", ["ris"], [], []),
        ("j", "ICLR", 2022, "Right name", "W, " * 60, "main", "accepted", ["pmlr"], [], []),
        ("k", "ICLR", 2022, "", None, "main", "accepted", ["pmlr"], [], []),
        ("l", "ICLR", 2022, "", None, "main", "accepted", ["dblp"], [], []),
    ]
    member, merges, refused = resolve.merge(records(spark, rows))
    assert {r["id"]: r["cluster"] for r in member.collect()} == {x: "a" for x in "abc"} | {x: x for x in "defghkl"} | {"i": "i", "j": "i"}
    assert {(r["survivor_id"], r["merged_id"], r["rule"]) for r in merges.collect()} == {("a", "c", "forum_link"), ("a", "b", "title_venue_year"), ("i", "j", "abstract_venue_year")}
    assert {(r["key"], r["resolution"]) for r in refused.collect()} == {("twice", "ambiguous_not_merged"), ("track", "track_not_merged")}


def merged(spark, rows):
    member, merges, refused = resolve.merge(records(spark, rows))
    groups = {}
    for r in member.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    return {k: "".join(sorted(v)) for k, v in groups.items() if len(v) > 1}, {(r["id_a"], r["id_b"], r["refusal"]) for r in refused.collect()}, merges


def test_rivals_of_a_listing_are_set_aside(spark):
    paper = lambda i, track, status, source, forum=(), listed=(): (i, "ICLR", 2020, "Same title", None, track, status, [source], list(forum), list(listed))
    groups, refused, _ = merged(spark, [paper("a", "workshop", "accepted", "openreview_v1", ["F1"]), paper("b", "main", "accepted", "openreview_v2", ["F2"]), paper("c", "main", "accepted", "pmlr", (), ["P1"])])
    assert groups == {"b": "bc"} and {x[2] for x in refused} == {"two_forum_ids"}
    groups, _, _ = merged(spark, [paper("a", "main", "rejected", "openreview_v1", ["F1"]), paper("b", "main", "accepted", "dblp"), paper("c", "main", "accepted", "pmlr", (), ["P1"]), paper("d", "unknown", "rejected", "openreview_v1", ["F3"])])
    assert groups == {"b": "bc"}
    groups, refused, _ = merged(spark, [paper("a", "main", "accepted", "openreview_v1", ["F1"]), paper("b", "main", "accepted", "openreview_v1", ["F2"]), paper("c", "main", "accepted", "pmlr", (), ["P1"])])
    assert groups == {} and len(refused) == 2  # which one is listed?


def test_imports_do_not_take_a_status(spark):
    paper = lambda i, status, source, forum=(), listed=(): (i, "ICLR", 2020, "Same title", None, "main", status, [source], list(forum), list(listed))
    assert merged(spark, [paper("a", "rejected", "openreview_v2", ["F1"]), paper("b", "accepted", "ris")])[0] == {}
    assert merged(spark, [paper("a", "rejected", "openreview_v2", ["F1"]), paper("b", "accepted", "ris", ["F1"])])[0] == {"a": "ab"}  # the forum link
    assert merged(spark, [paper("a", "rejected", "openreview_v2", ["F1"]), paper("b", "accepted", "ris"), paper("c", "accepted", "pmlr", (), ["P1"])])[0] == {"a": "abc"}  # beside a crawled listing
    assert merged(spark, [paper("a", "rejected", "ris"), paper("b", "accepted", "ris")])[0] == {}


def test_survivor_has_the_forum_id(spark):
    paper = lambda i, source, forum=(): (i, "ICLR", 2020, "Same title", None, "main", "accepted", [source], list(forum), [])
    groups, _, merges = merged(spark, [paper("a", "dblp"), paper("b", "openreview_v2", ["F1"]), paper("c", "pmlr")])
    assert groups == {"b": "abc"}
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("z",)], "id string")
    assert {tuple(r) for r in resolve.follow_merges(ids, merges).collect()} == {("a", "b"), ("b", "b"), ("c", "b"), ("z", "z")}
    chain = spark.createDataFrame([("b", "c", "x"), ("a", "b", "y")], "survivor_id string, merged_id string, rule string")
    assert {tuple(r) for r in resolve.follow_merges(ids, chain).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("z", "z")}


def test_the_same_id_again(spark):
    paper = lambda i, source, forum=(): (i, "ICLR", 2020, f"Title {i}", None, "main", "accepted", [source], list(forum), [])
    groups, _, merges = merged(spark, [paper("a", "dblp"), paper("a", "pmlr"), paper("a", "ojs"), paper("b", "openreview_v2", ["F"]), paper("b", "ris", ["F"]), paper("c", "dblp")])
    assert groups == {} and sorted(tuple(r) for r in merges.collect()) == [("a", "a", "native_id"), ("a", "a", "native_id"), ("b", "b", "forum_id")]


def test_a_title_of_very_many_records(spark):
    """Groups are decided from sums and extremes; a title that thousands share is refused without gathering them."""
    rows = [(f"r{i:05}", "ICLR", 2020, "Introduction", None, "main", "accepted", ["dblp"], [], []) for i in range(3000)]
    groups, refused, _ = merged(spark, rows)
    assert groups == {} and len(refused) == 2999 and {x[0] for x in refused} == {"r00000"}


def test_snapshots(spark):
    base = [("x", "t", None, "ICLR", 2020, "main", "accepted"), ("y", "t2", "a", "ICLR", 2020, "main", "accepted")]
    schema = "id string, title string, abstract string, venue string, year int, track string, status string"
    a = spark.createDataFrame(base, schema)
    b = spark.createDataFrame([base[0][:2] + ("now", "ICLR", 2020, "main", "rejected"), ("z", "t", None, "ICLR", 2020, "main", "accepted")], schema)
    assert snapshot.diff(a, a).count() == 0
    assert {(r["id"], r["change"], r["fields"]) for r in snapshot.diff(a, b).collect()} == {("x", "changed", "abstract,status"), ("y", "removed", ""), ("z", "added", "")}
    ids = snapshot.rekeyed(spark.createDataFrame([("o", "n1"), ("p", "n2")], "id string, native_id string"), spark.createDataFrame([("q", "n1"), ("p", "n2")], "id string, native_id string"))
    assert [tuple(r) for r in ids.collect()] == [("o", "q")]
    hidden = resolve.withhold(b, resolve.same_paper(spark.createDataFrame([("w",)], "id string"), spark.createDataFrame([("w", "v"), ("v", "x")], "src string, dst string")))
    assert {r["id"]: (r["abstract"], r["withheld"]) for r in hidden.collect()} == {"x": (None, True), "z": (None, False)}


def test_saved_search(spark, tmp_path):
    from quarry.functions.vocab import Vocabulary
    from quarry.operators.search import Index

    rows = [(f"p{i}", f"trust number{i}", None, "ICLR", 2020, "main", "accepted", "none") for i in range(5)]
    schema = "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"
    index = Index.build(spark.createDataFrame(rows, schema), Vocabulary())
    saved = snapshot.freeze(index, "trust", "native", str(tmp_path), "s1").first()
    assert saved["total"] == 5
    status, changed = snapshot.reopen(index, str(tmp_path), "s1")
    assert status == "reproduced" and changed.count() == 0
    with pytest.raises(Exception):
        snapshot.freeze(index, "trust", "native", str(tmp_path), "s1")
    smaller = Index.build(spark.createDataFrame(rows[1:], schema), Vocabulary(), snapshot_hash="other")
    status, changed = snapshot.reopen(smaller, str(tmp_path), "s1")
    assert status == "drifted:corpus" and [tuple(r) for r in changed.collect()] == [("p0", "removed")]


def test_ris_round_trip(spark, tmp_path):
    rows = [("p1", "A title", "An abstract\nin lines", "ICLR", 2020, "main", "accepted", "official"), ("p2", "=SUM(A1)", None, "ICML", 2021, "main", "rejected", "none")]
    df = spark.createDataFrame(rows, "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string")
    assert export.write(df, "ris", str(tmp_path / "ris"), expected=2) == 2
    back = {r["key"]: r for r in read_ris(spark, str(tmp_path / "ris")).collect()}
    assert back["p1"]["title"] == "A title" and back["p1"]["abstract"] == "An abstract in lines" and back["p2"]["year"] == 2021
    text = "TY  - JOUR\nTI  - T\nAU  - A, B\nAU  - C\nUR  - https://openreview.net/forum?id=abc_1\nUR  - https://doi.org/10.1000/XyZ.\nKW  - k\nPY  - 2019/01/02\nER  - \n"
    (tmp_path / "in.ris").write_text(text)
    got = read_ris(spark, str(tmp_path / "in.ris")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["authors"], r["forum_ids"], r["dois"], r["year"], r["native_ids"]) == (["A, B", "C"], ["abc_1"], ["10.1000/xyz"], 2019, ["doi-10.1000/xyz"])
    csv = [x["value"] for x in export.csv(df).orderBy("id").collect()]
    assert csv[1].startswith("p2,'=SUM(A1),") and '"An abstract\nin lines"' in csv[0]
    bib = [x["value"] for x in export.bibtex(df).orderBy("id").collect()]
    assert bib[0].startswith("@inproceedings{iclr2020a,") and bib[1].startswith("@misc{icml2021sum,")
    with pytest.raises(ValueError):
        export.write(df, "jsonl", str(tmp_path / "j"), expected=3)


def test_text_functions(spark):
    assert one(spark, "s string", [("a\x01 b \n c",)], T.one_line(F.col("s"))) == ["a b c"]
    assert one(spark, "s string", [("N/A",), ("cut short…",), ("x (cid:3) y",), (None,)], T.clean_abstract(F.col("s"))) == [None, None, "x y", None]
    assert one(spark, "s string", [("https://doi.org/10.1/ABC",), ("doi: 10.1234/Ab.C.",), ("https://dx.doi.org/10.1234/a%2Fb",), ("none",)], T.doi_key(F.col("s"))) == [None, "10.1234/ab.c", "10.1234/a/b", None]
    assert one(spark, "s string", [("https://openreview.net/pdf?x=1&id=Q_-1",), ("https://x.org/?id=1",)], T.forum_id(F.col("s"))) == ["Q_-1", None]
    assert one(spark, "s string", [("https://proceedings.mlr.press/v97/smith19a.html",), ("https://ojs.aaai.org/index.php/AAAI/article/view/123",), ("x",)], T.native_id(F.col("s"))) == ["pmlr-v97-smith19a", "ojs-123", None]
    assert one(spark, "s string", [("studies",), ("boxes",), ("models",), ("training",), ("glass",)], T.inflection_stem(F.col("s"))) == ["study", "box", "model", "train", "glass"]
    assert one(spark, "s string", [("Ada Lovelace",), ("Lovelace, Ada",)], T.surname(F.col("s"))) == ["lovelace", "lovelace"]
    assert one(spark, "a string, b string", [("deep nets 2", "deep nets 2"), ("deep neural nets", "deep neural netz"), ("part 1 of the set", "part 2 of the set")], T.title_verdict(F.col("a"), F.col("b"))) == ["exact", "similar", None]
    assert T.html_text("<p>a<b>b</b><p>c &lt; d<script>x</script> 1<2") == "ab c < d 1<2"
    assert T.metas('<meta name="Citation_Title" content="T"><meta name=x content=y>', "citation_title") == ["T"]
    assert T.cap_marks("e" + "́" * 20) == "e" + "́" * 8
    assert T.cap_length("aaaa bbbb cccc", 10) == "aaaa bbbb"
    maps = [({"b": [1], "a": [0, 2]},), ({"a": [0, 2]},), (None,)]
    assert one(spark, "m map<string,array<int>>", maps, T.rebuild(F.col("m"))) == ["a b a", None, None]


def test_sources(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"id":"w1","doi":"https://doi.org/10.1/A","title":"t","publication_year":2020,"abstract_inverted_index":{"x":[0],"y":[1]}}\n')
    assert tuple(read_works(spark, str(tmp_path / "w.jsonl")).first()) == ("w1", "10.1/a", "t", 2020, "x y")
    pages = spark.createDataFrame([(1, '<a href="/p/1">One <b>x</b></a><a class=q href=\'/p/2\'>Two</a>')], "page_id long, html string")
    assert [tuple(r) for r in listing(pages).collect()] == [(1, "/p/1", "One x"), (1, "/p/2", "Two")]
    ranges = spark.createDataFrame([(1, 10, "main"), (11, 20, "demo")], "lo int, hi int, track string")
    assert [r["range_track"] for r in page_track(spark.createDataFrame([(5,), (15,), (25,)], "page int"), ranges).orderBy("page").collect()] == ["main", "demo", None]


def test_comparison(spark):
    schema = "venue string, year int, forum_id string, native_id string, doi string, title_key string"
    corpus = spark.createDataFrame([("i1", "A", 2020, "f", None, "d", "t"), ("i2", "A", 2020, None, None, "e", "same"), ("i3", "A", 2020, None, None, None, "same")], "id string, " + schema)
    refs = spark.createDataFrame([(1, "B", 2021, "f", None, None, "zz"), (2, "A", 2020, None, None, "e", "same"), (3, "A", 2020, None, None, None, "same"), (4, "A", 2020, None, None, None, "")], "ref_id int, " + schema)
    assert {r["ref_id"]: (r["id"], r["rule"]) for r in compare.match_ladder(refs, corpus).collect()} == {1: ("i1", "forum_id"), 2: ("i2", "doi"), 3: (None, "ambiguous"), 4: (None, "unmatched")}
    assert one(spark, "a string, b string", [("x y", "x y"), ("X, y", "x y"), ("x y z", "x y"), ("x", "q")], compare.audit(F.col("a"), F.col("b"))) == ["exact", "near_exact", "truncated", "differs"]


def test_streams(spark, tmp_path):
    from quarry.functions.vocab import Vocabulary

    rows = [("a", "trust me", None, "ICLR", 2020, "main", "accepted", "none"), ("b", "other", None, "ICLR", 2020, "main", "accepted", "none")]
    schema = "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = standing_query(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "trust", Vocabulary())
    q = stream.writeStream.format("memory").queryName("standing").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r["id"] for r in spark.sql("select id from standing").collect()] == ["a"]
    at = dt.datetime(2024, 1, 1, 5)
    schema = "record_id string, field string, source string, value string, fetched_at timestamp"
    spark.createDataFrame([("r", "title", "dblp", "t", at), ("r", "title", "dblp", "t", at)], schema).write.parquet(str(tmp_path / "claims"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "claims"))
    for name, frame, mode, expected in (("fresh", fresh_claims(source), "append", 1), ("rates", claim_rates(source), "complete", 1)):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        assert spark.sql(f"select * from {name}").count() == expected
