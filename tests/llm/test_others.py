import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import ann, htmltext, langid, substrings, urlfilter, warc
from quarry.session import fresh_path


# -- nearest neighbours ------------------------------------------------------------------------------------
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit(0)).withColumn("cell", F.lit(0))


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    points = (centres[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    points[700:760] = points[0]  # a hot vector
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [float("inf")] + [1.0] * 7), (2004, [1.0] * 3), (None, [1.0] * 8), (2100, [None] + [1.0] * 7)]
    found = ann.search(vectors(spark, rows + odd), part_rows=100).collect()
    exact = points.astype(np.float64)
    hit = 0
    for q in range(0, 1500, 100):
        mine = sorted((r["rank"], r["id"], r["score"]) for r in found if r["query_id"] == q)
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        true = np.lexsort((np.arange(1500), d))[:10]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-9 for _, i, s in mine) and q not in [i for _, i, _ in mine]
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & set(true.tolist()))
    assert hit >= 0.9 * 150
    assert [r["id"] for r in sorted((r for r in found if r["query_id"] == 0), key=lambda r: r["rank"])] == list(range(700, 710))
    assert {r["query_id"] for r in found} == set(range(0, 1500, 100))


def test_few_or_no_vectors(spark):
    assert ann.search(vectors(spark, [])).count() == 0
    few = ann.search(vectors(spark, [(0, [1.0, 2.0]), (1, [1.0, 3.0]), (1, [1.0, 3.0])])).collect()
    assert sorted((r["rank"], r["id"]) for r in few) == [(1, 1), (2, 1)]


def test_equal_vectors_of_one_id(spark):
    """A query whose own id holds the smallest places of its vector still finds the others."""
    rows = [(100, [1.0, 1.0])] * 12 + [(101, [1.0, 1.0]), (102, [1.0, 2.0]), (103, [5.0, 5.0]), (103, [5.0, 5.0])]
    found = ann.search(vectors(spark, rows)).collect()
    assert sorted((r["rank"], r["id"], round(r["score"], 6)) for r in found) == [(1, 101, 0.0), (2, 102, 1.0), (3, 103, 5.656854), (4, 103, 5.656854)]
    many = [(i, [2.0, 1.0]) for i in range(1, 40)] + [(200, [2.0, 1.0]), (200, [2.0, 3.0])]
    found = ann.search(vectors(spark, many)).collect()  # a query id with two vectors asks with each
    assert sorted((r["rank"], r["id"], r["score"]) for r in found) == sorted((i, i, s) for i in range(1, 11) for s in (0.0, 2.0))


def test_walk_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    cells, reached = ann.walk(a, b, np.ones((7, 5), int), 35)
    assert reached == max(a) + max(b)
    sums = [a[c // 5] + b[c % 5] for c in cells]
    assert sums == sorted(sums) and len(set(cells)) == 35


# -- archives ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("published", [False, True])
def test_archives_round_trip(spark, published):
    big = "é" * 600
    trap = "x" * 1200 + "\r\n\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello"
    rows = [(1, "http://a/", big), (2, None, big), (5, "http://b/ c\r\n", big), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", trap), (8, "u", trap), (None, "u", big), (9, "u", ""), (5, "http://b/", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("original", F.lit("clash")).withColumn("value", F.lit("clash"))
    path = fresh_path(spark, "warc")
    warc.write(pages.repartition(2), path, file_bytes=3000)
    if published:
        warc.publish(spark, path)
        files = sorted(glob.glob(path.removeprefix("file://") + "/*.warc.gz"))
        assert len(files) > 2
        texts = [gzip.open(f).read() for f in files]  # ordinary readers see one stream of records
        assert sum(t.count(b"WARC-Type: warcinfo") for t in texts) >= 2
        assert sum(len(list(warc.parse(t))) for t in texts) == len(rows)
    records = warc.read(spark, path, with_payload=True)
    kept = {r["page_id"]: r["payload"] for r in records.where("record_type = 'response'").collect()}
    assert kept[5] == big and kept[8] == trap and kept[6] == "" and kept[3] == "small"
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in warc.resolved(records).collect())
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, x in rows if j is not None and x == h and len(data) >= 1000]
        again = i is not None and bool(same) and i < max(same)
        expected.append((i is None, i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else 0))
    assert got == sorted(expected)


def test_payloads_are_not_joined_by_digest(spark):
    """Only headers are shuffled by digest; the pages meet the revisits by id and digest."""
    pages = spark.createDataFrame([(i, "u", "x" * 1200 if i % 3 else "y" * i) for i in range(50)], "page_id long, url string, html string")
    heads = warc.headers(pages)
    plan = warc.revisits(heads)._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Join" in line or "Aggregate" in line]
    assert shuffled and not any("html" in line for line in shuffled)
    assert warc.revisits(heads).count() == sum(1 for i in range(50) if i % 3) - 1


def test_separator_is_an_empty_member():
    assert gzip.decompress(warc.SEPARATOR) == b""
    both = warc.member(b"one") + warc.SEPARATOR + warc.member(b"two") + warc.SEPARATOR
    assert gzip.decompress(both) == b"onetwo" and both.split(warc.SEPARATOR)[:2] == [warc.member(b"one"), warc.member(b"two")]


def test_no_pages(spark):
    path = fresh_path(spark, "warc")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolved(warc.read(spark, path)).count() == 0


# -- html ------------------------------------------------------------------------------------------------------
ARTICLE = "<h1>Title of it</h1><p>First   paragraph&amp;more &lt;x&gt;.<p>Second <a href=x>link</a>\n text.<ul><li>One<li>Two</ul>"
TEXT = "Title of it\n\nFirst paragraph&more <x>.\n\nSecond link text.\n\nOne\n\nTwo"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("just text", "just text"),
        (f"<body><nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>Foot</footer>", TEXT),
        (f"<body><header>Site</header><div id=main class=content>{ARTICLE}</div><div class='sidebar'><p>Other long text of a sidebar here</p></div><div id=comments><p>Reader says many things here indeed</p></div>", TEXT),
        (f"<body><div class='cookie-notice'>We use cookies and say so at length</div><form><p>Form words</p></form><article>{ARTICLE}<script>var t='</p>';</script><style>p{{}}</style><aside>Aside</aside></article>", TEXT),
        (f"<body><article>{ARTICLE}", TEXT),
        ("<p>unclosed <b>bold<p>next &am", "unclosed bold\n\nnext &am"),
        ('<body><article><p title="a > b">quoted</p><p>and <broken</p></article>', "quoted\n\nand"),
    ],
)
def test_main_text(page, text):
    assert htmltext.extract(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id=aspnetForm action=x><input name=v><div class=header>Site</div><div id=content>{ARTICLE}</div><div class=footer>Foot</div></form>",
        f"<body><div class='layout has-sidebar'><div class=sidebar><p>Side words</p></div><article>{ARTICLE}</article></div>",
        f"<body><div class='widget Blog'>{ARTICLE}</div><div class=widget>Other</div>",
        f"<body><div id='page-with-header'><div id=header>Site</div><main>{ARTICLE}</main></div>",
        f"<body><article>{ARTICLE}</article><div id=comments><p>{'Readers say more than the article does. ' * 9}</p></div>",
        f"<body><form><article>{ARTICLE}</article><div id=comments><p>{'Readers say more than the article does. ' * 9}</p></div></form>",
    ],
)
def test_wrapped_articles_stay(page):
    assert htmltext.extract(page) == TEXT


LONG = "Readers say more than the article does. " * 4


@pytest.mark.parametrize(
    "page",
    [
        f"<body><main>{ARTICLE}<p class='advert'>Buy now</p></main>",
        f"<body><main>{ARTICLE}<article class='comment'><p>{LONG}</p></article></main>",
        f"<body><div id=main>{ARTICLE}</div><article class='comment'><p>{LONG}</p></article>",
        f"<body><article>{ARTICLE}<article class='comment'><p>First</p></article><article class='comment'><p>Second</p></article></article>",
        f"<body><p>Hm.</p><div class='share-price'>{ARTICLE}</div>".replace("<p>Hm.</p>", "<nav>Hm.</nav>"),
        f"<body><div class='related-work'>{ARTICLE}</div><div class=footer><p>Word</p></div>",
        f"<body><main>{ARTICLE}<ul><li><a href=1>Some other page</a><li><a href=2>And one more</a><li><a href=3>Third</a></ul></main>",
        f"<body><main><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Sports</a></div>{ARTICLE}</main>",
        f"<body><div class='share-price'>{ARTICLE}</div><div class=comments><p>{LONG}</p></div>",
    ],
)
def test_evidence_against_elements(page):
    assert htmltext.extract(page) == TEXT


def test_lists_with_links_and_text_stay():
    page = "<body><article><p>Words of the article that go on for a while.</p><ul><li>Some work by many people, <a href=1>link</a>, 2020<li>Another work that people did, <a href=2>link</a>, 2021</ul></article>"
    assert htmltext.extract(page).endswith("while.\n\nSome work by many people, link, 2020\n\nAnother work that people did, link, 2021")


def brute_densities(tree):
    """Composite text density and sums of children, node by node from the definition."""
    n = len(tree.parent)
    inside = lambda i, j: i == j or (j > 0 and inside(i, tree.parent[j]))
    total = lambda x, i: sum(x[j] for j in range(n) if inside(i, j))
    body = tree.tag.index("body")
    share = total(tree.link_chars, body) / total(tree.chars, body)
    dense = []
    for i in range(n):
        c, t, lc, lt = (total(x, i) for x in (tree.chars, tree.tags, tree.link_chars, tree.link_tags))
        base = np.log(c / max(c - lc, 1) * lc + share * c + np.e) if c else 1
        dense.append(c / max(t, 1) * max(0, np.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1)) / base) if c else 0.0)
    return dense, [sum(dense[j] for j in range(1, n) if tree.parent[j] == i) for i in range(n)]


def test_region_has_the_largest_density_sum():
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    for _ in range(30):
        side = "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(rng.randint(2, 9)))
        parts = "".join(f"<p>{words(rng.randint(15, 60))} <a href=y>{words(1)}</a></p>" for _ in range(rng.randint(3, 8)))
        page = f"<body><div><ul>{side}</ul></div><div><div id=hold>{parts}</div></div><div><p>{words(3)}</p></div>"
        tree = htmltext.parse(page)
        _, sums = brute_densities(tree)
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        assert htmltext.extract(page).count("\n\n") == parts.count("<p>") - 1
        assert sum(p == best and tree.tag[i] == "p" for i, p in enumerate(tree.parent)) == parts.count("<p>")


def test_attributes_are_not_read_inside_quotes():
    page = "<body><article><p>See <a title='the hidden gem' href=x>this</a> and <span title=\"a class=ad b\">that</span>.<div title='a hidden x'>Block</div><div hidden>gone</div><div data-x=1 HIDDEN=''>gone</div></article>"
    assert htmltext.extract(page) == "See this and that.\n\nBlock"


def test_nested_doubtful_elements_are_linear():
    deep = "<div class=widget>" * 20_000 + "<p>deep text"
    assert htmltext.extract(deep) == "deep text"


def test_html_is_linear_and_whole(spark):
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    assert htmltext.extract(deep) == "deep"
    assert htmltext.extract('<a "' * 20_000) == ""
    long = "<article>" + "".join(f"<p>paragraph {i} here</p>" for i in range(20_000)) + "</article>"
    assert htmltext.extract(long).count("\n\n") == 19_999
    pages = spark.createDataFrame([(1, "u", "<p>x</p>"), (1, "u", "<p>x</p>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    rows = htmltext.main_text(pages).collect()
    assert sorted((r["text"], r["n_chars"]) for r in rows) == [("", 0), ("x", 1), ("x", 1)]
    assert htmltext.main_text(pages.limit(0)).count() == 0


# -- language ----------------------------------------------------------------------------------------------------
def language_rows(n=240):
    rng = random.Random(2)
    parts = {"aa": ["ing", "the", "er", "tion"], "bb": ["eau", "ère", "oux", "ment"], "cc": ["ung", "sch", "ä", "keit"]}
    return [(i, " ".join("".join(rng.choice(parts[l]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), l, "s") for i in range(n) for l in [rng.choice("abc") * 2]]


def test_language_held_out_accuracy(spark, docs_of):
    rows = language_rows()
    docs = docs_of(rows + [(900, None, "aa", "s"), (901, "123 ... 456", "aa", "s"), (902, "ing the " * 30_000, None, "s"), (None, "schung", None, None), (903, "x" * 100_000, None, "s")])
    train = langid.sample(docs)
    assert all(label for _, label in train) and len(train) <= 3 * langid.PER_LABEL
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert not {t for _, t, *_ in [r for r in rows if r[0] in held]} & {t for t, _ in train}
    net = langid.train(train)
    got = {r["doc_id"]: (r["h"], r["judged"]["lang_pred"], r["judged"]["score"]) for r in langid.predict(docs, net).select("doc_id", langid.held_out(F.col("doc_id")).alias("h"), "judged").collect()}
    assert {i for i, g in got.items() if i is not None and i < 900 and g[0]} == held
    assert np.mean([got[i][1] == l for i, _, l, _ in rows if i in held]) > 0.95
    assert got[900][1:] == (langid.UND, 0.0) and got[901][1:] == (langid.UND, 0.0) and got[902][1] == "aa" and got[None][1] == "cc"
    assert all(0 <= g[2] <= 1 for g in got.values())
    kept = langid.keep_recognised(docs)
    assert kept.columns == docs.columns and not {900, 901} & {r["doc_id"] for r in kept.select("doc_id").collect()}


def test_gradients():
    net = langid.Network.fresh(["a", "b", "c"], 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, mask = langid._padded([b"hello", b"abc", b"zz"])
    target = np.array([0, 1, 2])
    _, g, _ = net.gradients(ids, mask, target)
    for k, v in net.w.items():
        at = (104, 3) if k == "emb" else tuple(s // 2 for s in v.shape)
        old, step = v[at], 1e-4
        v[at] = old + step
        up = net.gradients(ids, mask, target)[0]
        v[at] = old - step
        down = net.gradients(ids, mask, target)[0]
        v[at] = old
        assert (up - down) / (2 * step) == pytest.approx(g[k][at], abs=1e-5)
    p, _ = net.forward(ids, mask)
    assert net.sums([b"hello", b"abc", b"zz"]) == pytest.approx((p * mask[:, :, None]).sum(axis=1), abs=1e-4)


def brute_sums(net, text):
    """One pass over all bytes in each direction, byte by byte, in double precision."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    n, size = len(text), langid.HIDDEN
    states = {}
    for d, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
        h, states[d] = np.zeros(size), np.zeros((n, size))
        for i in order:
            x, u = w["emb"][text[i]] @ w[d + "x"] + w[d + "b"], h @ w[d + "h"]
            z, r = sigmoid(x[:size] + u[:size]), sigmoid(x[size : 2 * size] + u[size : 2 * size])
            h = h + z * (np.tanh(x[2 * size :] + r * u[2 * size :]) - h)
            states[d][i] = h
    p = np.exp(np.concatenate([states["f"], states["b"]], axis=1) @ w["out"] + w["bias"])
    return (p / p.sum(axis=1, keepdims=True)).sum(axis=0)


@pytest.mark.parametrize(("piece", "run_up", "block"), [(8192, 512, 1 << 20), (40, 8, 1 << 20), (40, 8, 150), (16, 1, 64)])
def test_state_runs_through_the_whole_text(monkeypatch, piece, run_up, block):
    for name, value in (("PIECE", piece), ("RUN_UP", run_up), ("BLOCK", block)):
        monkeypatch.setattr(langid, name, value)
    net = langid.Network.fresh(["a", "b", "c"], 4)
    net.w["fb"][: langid.HIDDEN] -= 3  # long memory: a guess from a short run-up is wrong
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"abc def\xc3\xa9") for _ in range(n)) for n in (1, 700, 39, 40, 41, 333, 80, 5)]
    got = net.sums(texts)
    for text, row in zip(texts, got):
        assert row == pytest.approx(brute_sums(net, text), abs=2e-3 * len(text) ** 0.5)
        assert row.sum() == pytest.approx(len(text), rel=1e-4)


def test_sample_of_repeated_ids(spark, docs_of):
    rows = [(3, f"{'schung ' * 9}{i}", "aa", "s") for i in range(5000)] + [(i, "eau ment", "bb", "s") for i in range(3000)]
    found = langid.sample(docs_of(rows), per_label=50)
    assert sum(label == "aa" for _, label in found) == 50 and {t for t, label in found if label == "bb"} == {"eau ment"}
    assert sum(len(t) for t, label in langid.sample(docs_of(rows), sample_bytes=300) if label == "aa") <= 300


def test_nothing_learned(spark, docs_of):
    docs = docs_of([(1, "some text", None, "s")])
    net = langid.train(langid.sample(docs))
    assert net is None and langid.predict(docs, net).first()["judged"]["lang_pred"] == langid.UND
    assert langid.predict(docs_of([]), net).count() == 0


# -- substrings ----------------------------------------------------------------------------------------------------
def brute_removed(rows, window):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - window + 1) if i is not None else ():
            g = tuple(w[a : a + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i is None, i or 0, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def passages():
    rng = random.Random(9)
    text = lambda n: [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
    common = text(60)
    rows = []
    for i in range(40):
        words = text(rng.randint(0, 150))
        if i % 3 == 0:
            words[rng.randint(0, len(words)) :][:0] = common
            words = words + common[rng.randint(0, 20) : rng.randint(40, 60)] + text(rng.randint(0, 40))
        if i % 7 == 0 and rows:
            words = words + rows[rng.randrange(len(rows))][1].split()
        rows.append((i, " ".join(words)))
    rows += [(50, None), (51, ""), (52, "a b"), (None, rows[3][1]), (3, rows[3][1]), (53, "z " * 3000), (54, "z " * 3000), (55, rows[0][1].upper())]
    return rows


@pytest.mark.parametrize("kw", [{}, {"shard_runs": 2}, {"shard_runs": 2, "most_shards": 1, "broadcast_spans": 0}])
def test_repeated_passages(spark, docs_of, kw):
    rows = passages()
    found = substrings.deduplicate(docs_of([(i, t, "en", "s") for i, t in rows]), **kw).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)
    assert got == brute_removed(rows, 50)


def test_colliding_hashes_do_not_remove(spark, docs_of):
    """Two sequences whose polynomial hashes modulo 2^64 agree (Thue-Morse words) are not taken for equal."""
    bit = lambda i: i.bit_count() & 1
    one = ["ab"[bit(i)] for i in range(4096)]
    two = ["ba"[bit(i)] for i in range(4096)]
    join = lambda w: " ".join(w)
    h = substrings._Hashes([[w.encode() for w in one], [w.encode() for w in two]])
    whole = h.of(np.array([0, 4096]), np.array([4095, 8191]))
    assert whole[0] == whole[1]
    found = substrings.deduplicate(docs_of([(1, join(one), "en", "s"), (2, join(two), "en", "s")])).collect()
    got = sorted((r["id"] is None, r["id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found)
    assert got == brute_removed([(1, join(one)), (2, join(two))], 50)


def test_minimizers_do_not_depend_on_the_surroundings():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 1 << 63, 2_300_000).astype(np.uint64)
    grams[5:900] = 7
    whole = substrings._lowest(grams, 43)
    for at in (0, 3, 400, (1 << 20) - 50, 2_200_000):
        assert whole[at : at + 20].tolist() == (at + substrings._lowest(grams[at : at + 20 + 42], 43)).tolist()


def test_automaton_spans():
    rng = random.Random(4)
    for _ in range(60):
        seqs = [[rng.choice("ab") for _ in range(rng.randint(0, 25))] for _ in range(3)]
        automaton = substrings.SuffixAutomaton()
        for s in seqs:
            automaton.add(s)
        grams = {tuple(s[i : i + 4]) for s in seqs for i in range(len(s) - 3)}
        words = [rng.choice("abc") for _ in range(30)]
        covered = {j for i in range(27) if tuple(words[i : i + 4]) in grams for j in range(i, i + 4)}
        assert {j for a, b in automaton.spans(words, 4) for j in range(a, b)} == covered


def test_outside_reference(spark, docs_of):
    rows = passages()
    reference = docs_of([(0, rows[0][1], "en", "s"), (1, None, "en", "s")])
    found = substrings.against_reference(docs_of([(7, "q r " + rows[0][1], "en", "s"), (8, "q r", "en", "s")]), reference, shard_words=20).collect()
    n = len(rows[0][1].split())
    assert {r["id"] for r in found} == {7} and max(r["stop"] for r in found) == n + 2
    with pytest.raises(ValueError):
        substrings.against_reference(reference, reference, most_words=1)
    assert substrings.deduplicate(docs_of([])).count() == 0


# -- urls ----------------------------------------------------------------------------------------------------------
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "http://a.www.example.com/en/q", "http://example.com", "http://example.com?x=/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://xnet/fr/", "http://com/", "a://b://c.net/es/", "http://É.NET/fr/", "http://x.org/en/\nq", "http://" + "a." * 300 + "com/p"]


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *((max(fits)[1], max(fits)[2]) if fits else (None, "allow"))


def test_urls(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, "http://x.net/fr/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit("clash")).withColumn("host", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for bits in (urlfilter.MAX_BITS, 0):  # also joined
        got = {r["id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages, rules, bits_per_key=2, max_bits=bits).collect()}
        assert got == {i: brute_rule(u) for i, u in rows}
    none = urlfilter.judge(pages, rules.limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"} and urlfilter.judge(pages.limit(0), rules).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("cast(substring(key, 2) as int) % 7 = 0").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    cascade = urlfilter.build_cascade(universe, listed, bits_per_key=3)
    rows = universe.select("key", *[h.alias(f"h{i}") for i, h in enumerate(urlfilter.key_hashes(F.col("key")))]).toPandas()
    said = cascade.test(rows["h0"].to_numpy(np.int64), rows["h1"].to_numpy(np.int64))
    assert len(cascade.levels) > 1
    assert set(rows["key"][said]) == {f"k{i}" for i in range(0, 3000, 7)}
