import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.tree import PageTooLarge, parse
from quarry.functions.vocab import Vocabulary
from quarry.operators import attribution, classify, compare, resolve
from quarry.operators.search import Index
from quarry.plans.ast import And, Near, Not, Or, Phrase, Term, Wildcard
from quarry.plans.canonical import restricts
from quarry.plans.diagnose import clip, cost_of_counting, distinct_items, expansions_json, group_trees, scrub, terms_read, verified_clauses, verifies
from quarry.plans.parse import parse as parse_query
from quarry.service import Limits, Refused, Service, answer
from quarry.sources import crawled, snapshots


def column(spark, schema, rows, made):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(made).collect()]


# -- queries ---------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("q", "text"),
    [
        ("source:ICLR trust model | bias", '(((trust AND model AND venue:ICLR) OR bias)'),
        ("trust model -risk | bias", "(((trust AND model AND NOT risk) OR bias)"),
        ("trust and model | bias", '(((trust AND "and" AND model) OR bias)'),
        ("trust model | bias", '(("trust model" OR bias)'),
        ("bias | (trust model)", "((bias OR (trust AND model))"),
        ("(trust model | bias) risk", '(("trust model" OR bias) AND risk'),
        ("a1 (b1 c1) | d1 e1", None),
    ],
)
def test_scholar_phrases_are_set_off_on_both_sides(q, text):
    found = parse_query(q, "scholar")
    assert found.ok, found.errors
    if text:
        assert found.canonical.startswith(text), found.canonical


def test_detached_wildcards():
    for q in ("abcd⒈*", "vision-*", "x⑴*", "abc +*"):
        assert "PARSE_WILDCARD_DETACHED" in [d.code for d in parse_query(q).errors], q
    assert parse_query("vision*").ok and parse_query("naïve*").ok


def test_polarity():
    a, b = Term("a"), Term("b")
    assert restricts(a) and not restricts(Not(a)) and restricts(Not(Not(a)))
    assert restricts(And((a, Not(b)))) and not restricts(Or((a, Not(b)))) and not restricts(Not(And((Not(a), Not(b)))))


def test_costs():
    expansions = {("trust", "*"): ["trust", "trusted", "trusts"], ("trust", "$"): ["trust", "trusts"]}
    star, dollar, t = Wildcard("trust", "*"), Wildcard("trust", "$"), Term("trust")
    assert distinct_items(Phrase((t, star, dollar)), expansions) == [t]
    assert distinct_items(Near(star, Term("x"), 3), expansions) == [star, Term("x")]
    assert verifies(Phrase((t, star))) and not verifies(Phrase((t, t))) and verifies(Near(t, t, 1)) and not verifies(Near(t, Term("x"), 1)) and not verifies(None)
    tree = And((Or((t, star)), Phrase((t, star)), Not(Term("z"))))
    assert verified_clauses(tree) == [Phrase((t, star))] and terms_read(tree, expansions) == 9
    weight = lambda c: terms_read(c, expansions)
    alone_and_without = sum(weight(x) for pair in group_trees(tree) for x in pair if x is not None)
    assert cost_of_counting(tree, weight) == alone_and_without
    assert expansions_json(expansions) == {"trust$": ["trust", "trusts"], "trust*": ["trust", "trusted", "trusts"]}


def test_messages():
    assert clip("a  b\n c`d") == "a b c\\x60d" and clip("x" * 50) == "x" * 39 + "…" and clip("​" * 9, 20) == "\\u200b" * 3 + "…"
    assert scrub("GET https://me:pw@h/x?token=abc&y=1 my query", ["my query"]) == "GET https://[redacted]@h/x?token=[redacted]&y=1 [query]"
    assert "secret-value" not in scrub("Authorization: Bearer secret-value") and "a@b.org" not in scrub("mail a@b.org now")


# -- functions -------------------------------------------------------------------------------------------------
def test_functions(spark):
    rows = [(["Ada L", "Bob"], 2), (["Ada L and Bob"], 2), (["A, B, and C"], 3), (["and A", "B"], 2), (["A and B"], 5), (None, 1), (["", " "], None), (["and"], 0), (["A and B"], None)]
    got = [(r["a"]["names"], r["a"]["how"]) for r in spark.createDataFrame(rows, "e array<string>, n int").select(T.split_authors(F.col("e"), F.col("n")).alias("a")).collect()]
    assert got == [(["Ada L", "Bob"], "listed"), (["Ada L", "Bob"], "split"), (["A", "B", "C"], "split"), (["A", "B"], "split"), ([], "refused"), ([], "listed"), ([], "listed"), (["and"], "listed"), ([], "refused")]
    assert column(spark, "s string", [("10.1145/3.x",), ("10.1/x",), ("doi:10.1145/3",), (None,)], T.is_doi(F.col("s"))) == [True, False, False, False]
    assert column(spark, "s string", [("Straße",), ("ÉCOLE ｘ",), ("Plain",), (None,)], T.sort_title(F.col("s"))) == ["strasse", "école x", "plain", None]
    moments = column(spark, "t string, o string", [("2024-01-01T00:30:00", "+01:00"), ("2024-01-01 00:30:00", "-00:30"), ("2024-01-01T00:30:00", "+15:00"), ("x", "+01:00")], F.unix_timestamp(T.local_to_utc(F.col("t"), F.col("o"))))
    assert moments == [1704065400, 1704070800, None, None]


def test_classification(spark):
    ids = ["ICLR.cc/2024/Conference", "ICLR.cc/2023/Conference", "NeurIPS.cc/2024/workshop/x/Submission", "AAAI.org/2024/Conference", "ICML.cc/2012/Conference", None, "ICML.cc/2024/Conference/Post_Decision"]
    got = [(r["v"]["track"], r["v"]["status"], r["v"]["parsed"]) for r in spark.createDataFrame([(x,) for x in ids], "s string").select(classify.venue_id(F.col("s")).alias("v")).collect()]
    assert got == [("main", "accepted", True), ("main", "unknown", True), ("workshop", "unknown", True), ("unknown", "unknown", False), ("unknown", "unknown", False), ("unknown", "unknown", False), ("main", "unknown", True)]
    assert column(spark, "s string", [("NeurIPS.cc/2024/Creative_AI_Track",), ("NeurIPS.cc/2024/Creative_AI_Track/Submission",), ("NeurIPS.cc/2023/Creative_AI_Track",), ("ICLR.cc/2024/Creative_AI_Track",), (None,)], classify.creative(F.col("s"), F.lit(2024))) == [True, True, False, False, False]


def test_windows_and_captures(spark):
    kinds = {r["window"]: r["kind"] for r in attribution.window_kinds(spark.createDataFrame([("ris",), ("pmlr",)], "source string")).collect()}
    assert kinds == {"ris": "scholar_query_dates", "pmlr": "crawl", "*": "mixed"}
    kinds = {r["window"]: r["kind"] for r in attribution.window_kinds(spark.createDataFrame([("ris",), ("pmlr",)], "source string"), ["ris"], ["pmlr"]).collect()}
    assert kinds == {"ris": "scholar_query_dates_utc", "pmlr": "archive_captures", "*": "mixed_utc"}
    assert column(spark, "s string", [("https://web.archive.org/web/20200101000000id_/http://aaai.org/x",), ("http://aaai.org/x",)], attribution.archived_original(F.col("s"))) == ["http://aaai.org/x", None]


def test_reference_lists(spark):
    refs = spark.createDataFrame([(1, "k", "s1", "A", 2020), (2, "k", "s1", "A", 2020), (3, "m", "s2", "B", 2021)], "ref_id int, key string, search string, venue string, year int")
    assert {(r["ref_id"], r["copies"]) for r in compare.dedupe_refs(refs, "key").collect()} == {(1, 2), (3, 1)}
    assert [tuple(r) for r in compare.capped_searches(refs, cap=2).collect()] == [("A", 2020)]
    crawls = spark.createDataFrame([("s", "A", 2020, 5, 5, 0, 0), ("s", "A", 2020, 3, 2, 0, 0), ("s", "B", 2020, 1, 1, 0, 0), ("t", "B", 2020, None, 1, 0, 0)], "source string, venue string, year int, stated int, found int, skipped int, unfollowed int")
    assert {(r["source"], r["venue"]): r["complete"] for r in resolve.complete_crawls(crawls).collect()} == {("s", "A"): False, ("s", "B"): True, ("t", "B"): False}


# -- sources ---------------------------------------------------------------------------------------------------
def test_trees_are_bounded(monkeypatch):
    root = parse("<ul class='a b'><li>One<li id=x>Two <b>bold</b><script>no</script></ul><p>After")
    assert [e.text() for e in root.find_all("li")] == ["One", "Two bold"] and root.find("li", id="x").text() == "Two bold"
    assert root.find("ul").has_class("b") and root.find("table") is None
    deep = parse("<div>" * 50_000 + "x")
    assert deep.text() == "x" and sum(1 for _ in deep.iter()) == 50_001
    monkeypatch.setattr("quarry.functions.tree.MAX_ELEMENTS", 10)
    with pytest.raises(PageTooLarge):
        parse("<b>" * 11)


def test_listings(spark):
    page = "<html><span class='paper-count'>1,002 papers</span><div class=paper><p class=title>T &amp; U</p><span class=authors>A B, C</span><a href='/v97/x19a.html'>abs</a><a href='x19a.pdf'>pdf</a><a href='x-supp.pdf'>s</a><a href='https://openreview.net/forum?id=F_1'>o</a></div><div class=paper><a href='other'>no</a></div>"
    pages = spark.createDataFrame([("https://proceedings.mlr.press/v97/", page), ("https://proceedings.mlr.press/v98/", None)], "url string, html string")
    assert [tuple(r) for r in crawled.listing_entries(pages, "pmlr").collect()] == [("https://proceedings.mlr.press/v97/", 0, "https://proceedings.mlr.press/v97/x19a.html", "T & U", ["A B", "C"], "https://proceedings.mlr.press/v97/x19a.pdf", "F_1")]
    assert {tuple(r) for r in crawled.listing_report(pages, "pmlr").collect()} == {("https://proceedings.mlr.press/v97/", 1002, 1, 1), ("https://proceedings.mlr.press/v98/", None, 0, 0)}


def test_bad_answers(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"status":"failed","message-type":"work-list","message":{}}')
    with pytest.raises(Exception, match="not a work list"):
        crawled.crossref_works(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "t.toml").write_text('[a]\nutc_offset = "+01:00"\n[b]\nx = 1\n')
    assert crawled.lookup_table(spark, str(tmp_path / "t.toml")).count() == 2
    with pytest.raises(ValueError, match="b lacks utc_offset"):
        crawled.lookup_table(spark, str(tmp_path / "t.toml"), ("utc_offset",))


@pytest.mark.parametrize(
    ("site", "page", "expected"),
    [
        ("iclr_archive", "<ul><li><a href='http://arxiv.org/abs/1412.0001'>One paper</a><br><i>A B, C D</i></li><li>no link</li></ul>", ("http://arxiv.org/abs/1412.0001", "One paper", ["A B", "C D"])),
        ("icml_site", "<div class=paper><p class=title>One paper</p><span class=authors>A B</span><a href='papers/1.html'>abstract</a></div>", ("https://x.org/papers/1.html", "One paper", ["A B"])),
        ("aaai_archive", "<div class=paper><h5><a href='p1.php'>One paper</a></h5><p class=authors>A B, C</p></div>", ("https://x.org/p1.php", "One paper", ["A B", "C"])),
        ("neurips_older", "<ul class=paper-list><li><a href='/paper/1-Abstract.html'>One paper</a> <i>A B</i></li></ul>", ("https://x.org/paper/1-Abstract.html", "One paper", ["A B"])),
    ],
)
def test_markup_of_sites(site, page, expected):
    found, unlinked = crawled.entries_of(page, "https://x.org/", crawled.LISTINGS[site])
    assert [(e[0], e[1], e[2]) for e in found] == [expected] and unlinked == page.count("no link")


def test_caps_of_names(spark):
    rows = [("a", "T", ["k" * 3000, "s"], "10.1/" + "x" * 2000), ("b", "T", None, "10.1/x")]
    got = {r["id"]: r for r in snapshots.capped(spark.createDataFrame(rows, "id string, title string, keywords array<string>, doi string")).collect()}
    assert len(got["a"]["keywords"][0]) == 2000 and got["a"]["doi"] is None and got["a"]["cuts"] == ["keywords", "doi"]
    assert got["b"]["doi"] == "10.1/x" and got["b"]["keywords"] is None and got["b"]["cuts"] == []


RECORD = "id string, title string, abstract string, venue string, year int, track string, status string, source string, keywords array<string>"


def test_snapshots(spark, tmp_path):
    rows = [("b", "Title é" + "́" * 20, None, "ICLR", 2020, "main", "accepted", "x", ["k"] * 6000), ("a", "word " * 500, "a\tb", "ICLR", 2020, "main", "accepted", "x", None), ("c", None, None, "ICLR", 2020, "main", "accepted", "x", None)]
    path = str(tmp_path / "s")
    made = snapshots.write(spark.createDataFrame(rows, RECORD), path)
    assert made["record_count"] == 2 and made["cuts"] == 3 and made["counts"][0]["n"] == 2
    back = {r["id"]: r for r in snapshots.read(spark, path).collect()}
    assert len(back["a"]["title"]) <= 1000 and back["a"]["abstract"] == "a\tb" and len(back["b"]["keywords"]) == 5000 and back["b"]["abstract"] is None
    with pytest.raises(Exception):
        snapshots.write(spark.createDataFrame(rows, RECORD), path)
    with pytest.raises(ValueError, match="stands 2 times"):
        snapshots.write(spark.createDataFrame(rows + rows[:1], RECORD), str(tmp_path / "t"))
    snapshots.read(spark, path).limit(1).withColumn("title", F.lit("changed")).write.option("ignoreNullFields", False).mode("append").json(path + "/records")
    with pytest.raises(snapshots.SnapshotMismatch):
        snapshots.read(spark, path)
    where = snapshots.report(spark, "coverage", spark.createDataFrame([("A", [1, 2])], "venue string, ns array<int>"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(where + "/csv").first()["ns"] == "[1,2]" and spark.read.json(where + "/json").count() == 1


# -- service -----------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def service(spark):
    rows = [(f"p{i}", f"trust model{i}", "an abstract of trust" if i % 2 else None, "ICLR", 2020 + i % 2, "main", "accepted" if i % 3 else "rejected", "none") for i in range(9)]
    schema = "id string, title string, abstract string, venue string, year int, track string, status string, abstract_kind string"
    return Service(Index.build(spark.createDataFrame(rows, schema), Vocabulary()), withheld=frozenset({"p1"}))


def test_service(service, tmp_path):
    found = service.search("trust model*", facets=True, groups=True, marks=True)
    assert found["total"] == 6 and len(found["hits"]) == 6 and found["query"]["expansions"]["model*"][0] == "model0"
    assert next(h for h in found["hits"] if h["id"] == "p1")["abstract"] is None and found["groups"][0]["alone"] == 6 and found["highlights"]
    assert service.paper("p1")["withheld"] and service.paper("p3")["abstract"]
    with pytest.raises(Refused):
        service.paper("none")
    assert service.export("trust", "jsonl").count("\n") == 5 and '"id":"p1"' in service.export("trust", "jsonl")
    assert service.freeze("trust", "native", str(tmp_path), "s")["total"] == 6 and service.reopen(str(tmp_path), "s")["status"] == "reproduced"
    refs = service.index.corpus.sparkSession.createDataFrame([(1, "trust model1"), (2, "nothing known"), (3, "trust model0")], "ref_id int, title_key string")
    refs = refs.select("ref_id", F.lit("ICLR").alias("venue"), F.when(F.col("ref_id") == 1, 2021).otherwise(2020).alias("year"), *[F.lit(None).cast("string").alias(c) for c in ("forum_id", "native_id", "doi")], "title_key")
    compared = service.compare(refs, "trust")
    assert compared["rules"] == {"title": 2, "unmatched": 1} and compared["sides"]["kept"] == 1 and compared["sides"]["dropped"] == 1
    assert service.meta()["records"] == 9 and service.healthz()["ok"] and service.coverage()[-1]["n"] == 9


def test_requests(service):
    now = [0.0]
    limits = Limits(burst=3, per_minute=60, clock=lambda: now[0])
    get = lambda url, who="a": answer(service, limits, who, url)
    status, headers, body = get("/search?q=trust&limit=2")
    assert status == 200 and headers["Content-Type"] == "application/json" and len(json.loads(body)["hits"]) == 2
    assert get("/search?q=(trust")[0] == 422 and get("/nowhere")[0] == 404
    status, headers, body = get("/healthz")
    assert status == 429 and int(headers["Retry-After"]) >= 1 and json.loads(body)["code"] == "RATE_LIMITED"
    assert get("/healthz", "b")[0] == 200
    now[0] += 2
    assert get("/meta")[0] == 200 and get("/search?q=trust&limit=x")[0] == 422
    busy = Limits(slots=1, deadline=0.2)
    import threading

    gate = threading.Event()
    with pytest.raises(Refused) as late:
        busy.run(gate.wait)
    assert late.value.status == 504
    with pytest.raises(Refused) as full:
        busy.run(lambda: 1)
    assert full.value.status == 503
    gate.set()


def test_command_line(spark, tmp_path, capsys):
    from quarry.__main__ import main

    assert main(["parse", "trust OR"]) == 1 and "PARSE_EXPECTED_TERM" in capsys.readouterr().out
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps({"id": f"p{i}", "title": f"trust {i}", "abstract": "words" if i else None, "venue": "ICLR", "year": 2020, "track": "main", "status": "accepted", "source": "x", "abstract_kind": "official"}) for i in range(3)))
    assert main(["snapshot", str(tmp_path / "r.jsonl"), str(tmp_path / "s")]) == 0
    assert main(["index", str(tmp_path / "s"), str(tmp_path / "i"), "--postings"]) == 0
    capsys.readouterr()
    assert main(["search", str(tmp_path / "i"), "trust", "--limit", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["total"] == 3
    assert main(["export", str(tmp_path / "i"), "trust", str(tmp_path / "e"), "--format", "csv"]) == 0 and capsys.readouterr().out.strip() == "3"
    assert main(["parity", str(tmp_path / "i")]) == 0 and main(["verify", str(tmp_path / "s")]) == 0


# -- merging against brute force ------------------------------------------------------------------------------------
def brute_merge(rows):
    """The rules of merging, group by group in Python, over lists of records."""
    rejected, main = {"rejected", "withdrawn", "desk_rejected"}, {"main", "datasets_benchmarks", "position"}
    clusters = [[r] for r in sorted(rows)]
    field = lambda c, i: {x for r in c for x in r[i]}
    first = lambda c, i: min(c)[i]
    own = lambda c: field(c, 7) - {"ris"}
    key = lambda r: " ".join("".join(x if x.isalnum() else " " for x in r[3].lower()).split())

    def family(c):
        waits = field(c, 9) and first(c, 5) == "unknown" and not any(s.startswith("openreview") for s in field(c, 7))
        return "p" if first(c, 5) in main or waits else None

    def refused(group, linked):
        sources = [s for c in group for s in own(c)]
        if not linked and len(sources) > len(set(sources)):
            return True
        if len({x for c in group for x in field(c, 8)}) > 1 or len({x for c in group for x in field(c, 9)}) > 1:
            return True
        crawled = lambda c: any(r[9] and set(r[7]) - {"ris"} for r in c)
        if not linked and any(not crawled(c) and first(c, 6) in rejected and all(not own(x) for x in group if x is not c) for c in group):
            return True
        return any(field(c, 9) for c in group) and ({family(c) for c in group} != {"p"})

    def aside(c, group):
        listed = [x for x in group if field(x, 9)]
        families = {f for x in listed if (f := family(x))}
        if field(c, 9):
            return False
        return (first(c, 5) != "unknown" and (family(c) is None or (families and family(c) not in families))) or first(c, 6) in rejected

    moved = True
    while moved:
        moved = False
        for rule in ("forum", "title"):
            groups = {}
            for c in clusters:
                for k in field(c, 8) if rule == "forum" else {key(r) for r in c} - {""}:
                    groups.setdefault((c[0][1], c[0][2], k), []).append(c)
            links = []
            for group in groups.values():
                if len(group) < 2:
                    continue
                if not refused(group, rule == "forum"):
                    links.append(group)
                elif rule == "title" and any(field(c, 9) for c in group):
                    rest = [c for c in group if not aside(c, group)]
                    if len(rest) > 1 and not refused(rest, False):
                        links.append(rest)
            parent = {id(c): id(c) for c in clusters}

            def root(x):
                while parent[x] != x:
                    x = parent[x]
                return x

            for group in links:
                for c in group[1:]:
                    parent[root(id(c))] = root(id(group[0]))
            joined = {}
            for c in clusters:
                joined.setdefault(root(id(c)), []).append(c)
            after = []
            for group in joined.values():
                if len(group) > 1 and not refused(group, rule == "forum"):
                    after.append(sorted(r for c in group for r in c))
                    moved = True
                else:
                    after += group
            clusters = after
    return sorted("".join(r[0] + "," for r in sorted(c)) for c in clusters)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merging_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        listed = rng.random() < 0.3
        source = rng.choice(["pmlr", "neurips_proceedings"]) if listed else rng.choice(["openreview_v2", "openreview_v1", "dblp", "ris", "ris"])
        forum = [f"F{rng.randint(0, 25)}"] if source.startswith("openreview") or rng.random() < 0.15 else []
        rows.append((f"r{i:03}", "ICLR", rng.choice([2020, 2021]), f"Title {rng.randint(0, 22)}", None, rng.choice(["main", "main", "main", "workshop", "unknown"]), "accepted" if listed else rng.choice(["accepted", "accepted", "rejected", "unknown"]), [source], forum, [f"P{i}"] if listed else []))
    schema = "id string, venue string, year int, title string, abstract string, track string, status string, sources array<string>, forum_ids array<string>, proceedings_ids array<string>"
    member, merges, _ = resolve.merge(spark.createDataFrame(rows, schema))
    groups = {}
    for r in member.collect():
        groups.setdefault(r["cluster"], []).append(r["id"])
    assert sorted("".join(i + "," for i in sorted(g)) for g in groups.values()) == brute_merge(rows)
    assert merges.count() > 3
