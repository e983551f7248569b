import random
import re

from quarry.llm import decontamination as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(de.UPPER, de.LOWER)


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        k = min(13, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in grams:
                hit.update(range(i, i + k))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def data():
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(50)] + ["Éa", "éa", "ÄB", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(14, 40))) for i in range(6)] + [(6, "Two words"), (7, "x1"), (8, None), (9, "..."), (None, text(20))]
    items.append((10, items[0][1]))
    docs = [(i, text(rng.randint(0, 120))) for i in range(20)]
    for i in range(20, 34):
        part = words(items[i % 6][1])
        a = rng.randint(0, max(0, len(part) - 13))
        docs.append((i, text(rng.randint(0, 200)) + " " + "-".join(part[a : a + 20]).upper() + "! " + text(5)))
    docs += [(40, None), (41, ""), (42, "two WORDS"), (None, "two words"), (43, "y " * 30_000 + items[0][1]), (42, "two WORDS")]
    return docs, items


def test_equals_brute_force(spark, docs_of):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of([(i, t, "en", "s") for i, t in docs])
    for limit in (1 << 20, 0):  # also without the broadcast
        rows = de.judge(df, bench, broadcast_bytes=limit).select("id", "n_words", "n_hit", "items", "contaminated").collect()
        got = sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in rows)
        assert got == sorted((i is None, i or 0, *brute(t, items)) for i, t in docs)


def test_shuffle_carries_places_alone(spark, docs_of):
    """Without the broadcast no exchange before the grouping by text holds the words."""
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = de.hits(docs_of([(i, t, "en", "s") for i, t in docs]), bench, broadcast_bytes=0)._jdf.queryExecution().sparkPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

    def joins(node):
        if "SortMergeJoin" in node.nodeName() or "ShuffledHashJoin" in node.nodeName():
            yield [[c.name() for c in _seq(side.output())] for side in _seq(node.children())]
        for child in _seq(node.children()):
            yield from joins(child)

    def _seq(s):
        return [s.apply(i) for i in range(s.size())]

    sides = [side for join in joins(plan) for side in join if "probe" in side]
    assert sides and all("w" not in side for side in sides)


def test_drop_and_remove(spark, docs_of):
    docs, items = data()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of([(i, t, "en", "s") for i, t in docs])
    kept = de.drop_contaminated(df, bench)
    assert kept.columns == df.columns
    assert kept.count() == sum(not brute(t, items)[3] for _, t in docs)
    clean = de.remove_spans(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count()
    for r in clean.select("doc_id", "text").collect():
        old = [t for i, t in docs if i == r["doc_id"]][0]
        n, hit, _, _ = brute(old, items)
        assert len(words(r["text"])) == n - hit
        if not hit:
            assert r["text"] == old


def test_empty(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    df = docs_of([(1, "some words", "en", "s")])
    row = de.judge(df, bench).first()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)
    assert de.judge(docs_of([]), bench).count() == 0
