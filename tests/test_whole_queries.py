import hashlib
import json

import pytest

import __spark_entry__
from quarry import catalog, queries
from quarry.operators import corpus, search
from quarry.operators.compile import TooManyExpansions, all_expansions
from quarry.operators.corpus import papers
from quarry.operators.search import Index
from quarry.plans.ast import Wildcard
from quarry.session import materialize


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    controls = "".join(map(chr, range(1, 32))).replace("\n", "")
    texts = ["plain title\nan abstract", "tab\there\r\nbody\r\nlines", f"all {controls}\x7f\u2028 of them\nand {controls[::-1]} again", 'kept \\u001F "quoted" \\\\\x1f\x1f\x0b\nx']
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_every_row_has_a_content_hash(spark, folder):
    expected = {}
    for r in papers(spark, folder).collect():
        fields = {k: r[k] for k in ("abstract", "status", "title", "track", "venue", "year")}
        text = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        expected[r["id"]] = hashlib.sha256(text.encode()).hexdigest()
    assert len(expected) == 4
    assert {r["id"]: r["content_hash"] for r in queries.content_hash(spark, folder).collect()} == expected


def test_inflections_cover_both_fields(spark, folder):
    rows = [(r["term"], r["stem"]) for r in queries.inflections(spark, folder).collect()]
    assert len(rows) == len(set(rows)) and {("lines", "line"), ("plain", "plain"), ("abstract", "abstract"), ("body", "body")} <= set(rows)


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Documents in which over 200 words begin with one stem, each in one record."""
    path = str(tmp_path_factory.mktemp("wide"))
    texts = [f"{'of' if i % 2 else 'in'} lement{i:03} x\n{'la' if i % 3 else 'les'} eaux" for i in range(310)]
    rows = [(i, t, ("en", "fr")[i % 2], "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(310) if i % 5 < 4], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def found(spark, folder, name: str) -> set[int]:
    return {int(r["id"][4:]) for r in __spark_entry__.queries()[name](spark, folder).select("id").collect()}


def by_default(i: int) -> bool:
    return i % 10 in (1, 2, 5, 6, 7, 8, 9) and i % 5 < 4


def test_phrase_wildcard_of_many_terms(spark, wide):
    assert found(spark, wide, "phrase_wildcard") == {i for i in range(310) if by_default(i) and (i % 2 or i % 3 == 0)}
    with pytest.raises(TooManyExpansions):  # the language's own limit stands
        queries.index(spark, wide).match("lement*")


def test_vocab_expand_of_many_terms(spark, wide):
    rows = [tuple(r) for r in __spark_entry__.queries()["vocab_expand"](spark, wide).select("wildcard", "term").collect()]
    assert sorted(rows) == [("lement*", f"lement{i:03}") for i in range(310)]
    assert all_expansions(queries.index(spark, wide).vocab, None).count() == 0


def test_postings_search_of_many_terms(spark, wide, monkeypatch):
    """By a scan, and by the postings of all 310 terms: the same."""
    expected = {i for i in range(310) if by_default(i) and (i % 2 or i % 3 == 0)}
    assert found(spark, wide, "postings_search") == expected
    monkeypatch.setattr(search, "CANDIDATE_SHARE", 1.0)
    held = catalog.posted(spark, wide).candidates(Wildcard("lement", "*", "title"))
    assert held.count() == 310 and catalog.posted(spark, wide).candidates(Wildcard("lement", "*", "abstract")).count() == 0
    assert catalog.posted(spark, wide).candidates(queries.tree(catalog.RARE).effective) is not None
    assert found(spark, wide, "postings_search") == expected


def test_wildcard_star_of_many_terms(spark, wide):
    assert found(spark, wide, "wildcard_star") == set(range(310))


def test_labels_reach_the_texts_of_an_index_without_a_shuffle(spark, tmp_path, monkeypatch):
    """The same records as by a plain join, whatever the ids; labels that cannot be packed are joined plainly."""
    ids = [-(2**63), -33, -32, -1, 0, 31, 32, 33, 95, 2**31, 2**63 - 1, None]
    kinds = [(1, 0), (0, 0), (1, 1), (0, 1), (None, None), (0, None), None]

    def data(name: str, extra: list) -> str:
        path = f"{tmp_path}/{name}"
        rows = [(i, f"title {i}\nabstract", "en", "s", 9) for i in ids]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
        labels = [(i, *kinds[n % 7]) for n, i in enumerate(ids) if kinds[n % 7]]
        spark.createDataFrame(labels + extra, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    def same(path: str, packed: str) -> int:
        frames = [papers(spark, path), papers(spark, path, packed=True)]
        assert ("SortMergeJoin" not in plan_of(frames[1]), "SortMergeJoin" in plan_of(frames[0])) == (packed == "packed", True)
        plain, found = (sorted(map(repr, f.collect())) for f in frames)
        assert found == plain
        return len(found)

    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    once, twice = data("once", [(7, 1, 0)]), data("twice", [(31, 1, 1)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert same(once, "packed") == 12
        assert same(twice, "plain") == 13  # two labels, two records
        at, index_plans = str(tmp_path / "once"), []
        monkeypatch.setattr(queries, "materialize", lambda df, *a, **k: index_plans.append(plan_of(df)) or materialize(df, *a, **k))
        queries.index(spark, at)
        assert len(index_plans) == 1 and "SortMergeJoin" not in index_plans[0]
        monkeypatch.setattr(corpus, "BROADCAST_SPANS", 5)
        assert same(once, "plain") == 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_index_keeps_no_second_copy_of_its_records(spark, wide):
    from pathlib import Path

    at = Path(queries.index(spark, wide).path.removeprefix("file://"))
    assert {p.suffixes[-2] for p in (at / "corpus").glob("*.parquet")} == {".zstd"}
    records = materialize(papers(spark, wide), "papers-once")
    Index.build(records, queries.VALUES, replaces=records)
    assert not list(at.parent.glob("papers-once-*"))
