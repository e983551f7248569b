"""Main text of HTML pages by composite text density.

Every DOM node gets a link-adjusted density: characters per tag, scaled down
where much of its text is link text. The densities of a node's children are
summed, and the node with the largest sum holds the article. The smallest
density on the path from body to that node is the threshold: the region grows
to an enclosing article or main element, or to a parent whose further text is
headings or at least that dense; and lists and other groups of links inside it
that are under the threshold are pruned.

Elements that are boilerplate by what they are (menus, headers, footers, asides,
forms, scripts, styles; adverts, notices and others by role) count for nothing.
A class or id that names boilerplate, on whatever element, is evidence: the text
of such an element counts for ``WEIGHTS``, less if the name is one word by itself
("comment") than if it is part of another ("share-price"). The element stays if
it holds an article or main element without such a name, or if its weighted text
outside links is over half of that of its surroundings, and no other article
stands beside it. A form is treated like a compound name.

Blocks are joined in page order by two newlines; white space inside a block
becomes one space.

Defined results:
- null or empty html, or no text left: the empty text, 0 characters;
- broken markup: tags are closed as browsers do for paragraphs, list items and table parts; an unclosed element ends with its parent; cut-off tags are dropped;
- very long pages: time and memory grow in proportion;
- ties between sums: the outer, earlier node;
- null ids and urls are kept; repeated rows: each is returned; empty table: empty result;
- other columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("script style noscript template iframe noembed noframes object svg canvas math audio video map head title nav header footer aside form button select option textarea input label fieldset dialog menu".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CELL = frozenset(("td", "th", "br"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open element a start tag closes, and what stops the search for it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead"}, "thead": {"tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "thead": {"table"}}
KEPT = frozenset("html body main h1".split())
GROUPS = frozenset("ul ol dl div section table tbody tr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login pagination pager skip".split()
)

#: What a character counts in an element that a class or id speaks against: as part of a name, as a name by itself.
WEIGHTS = (1.0, 1.0, 0.25)

_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _attributes(attrs: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(attrs):
        found.setdefault(name.lower(), (a or b or c).lower())
    return found


def _hinted(found: dict[str, str]) -> int:
    """How a class or id speaks against the element: 0 not at all, 1 as part of a name, 2 as a name by itself."""
    names = [n for at in ("class", "id") if at in found for n in found[at].split()]
    if any(n in HINTS for n in names):
        return 2
    return int(any(not HINTS.isdisjoint(_SPLIT.split(n)) for n in names))


def _unwanted(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether the element is boilerplate for certain, and how doubtful it is else."""
    if tag in DROPPED and tag != "form":
        return True, 0
    if tag in KEPT or not attrs.strip():
        return False, int(tag == "form")
    found = _attributes(attrs)
    sure = "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in ROLES
    return sure, max(int(tag == "form"), _hinted(found))


class _Tree:
    """Nodes in page order: parent, tag, own characters; text is kept as (node, piece) with None for a break."""

    def __init__(self) -> None:
        self.parent, self.tag, self.chars, self.link_chars, self.tags, self.link_tags = [-1], ["#root"], [0], [0], [0], [0]
        self.text: list[tuple[int, str | None]] = []
        self.doubtful, self.article = [0], [False]


def parse(page: str) -> _Tree:
    tree = _Tree()
    stack: list[tuple[str, int]] = [("#root", 0)]  # node -1: inside something dropped
    at, size, links, quotes = 0, len(page), 0, True
    lower: str | None = None

    def say(piece: str) -> None:
        node = stack[-1][1]
        if node < 0 or not piece:
            return
        if "&" in piece:
            piece = entities.unescape(piece)
        tree.text.append((node, piece))
        n = len(piece) if not piece.isspace() else 0
        tree.chars[node] += n
        if links:
            tree.link_chars[node] += n

    def cut(to: int) -> None:
        nonlocal links
        while len(stack) > to:
            tag, node = stack.pop()
            links -= tag == "a"
            if node >= 0 and tag in BLOCK:
                tree.text.append((node, None))

    while at < size:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        if found[1]:
            end = page.find("-->", found.end())
            at = end + 3 if end >= 0 else size
            continue
        if found[2]:
            end = page.find(">", found.end())
            at = end + 1 if end >= 0 else size
            continue
        tag = found[4].lower()
        rest = _REST.match(page, found.end()) if quotes else None
        if rest:
            end = rest.end() - 1
        else:  # an unclosed quote: once seen, quotes no longer count
            quotes = quotes and page.find(">", found.end()) < 0
            end = page.find(">", found.end())
            if end < 0:
                break
        attrs = page[found.end() : end]
        at = end + 1
        if found[3]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    cut(i)
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i][0]
                if open_tag == "p":
                    cut(i)
                    break
                if open_tag in BLOCK or open_tag in ("td", "th", "button", "object"):
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in CLOSES[tag]:
                    cut(i)
                    break
                if stack[i][0] in SCOPE[tag]:
                    break
        above = stack[-1][1]
        if above >= 0 and (tag in CELL or tag in BLOCK):
            tree.text.append((above, " " if tag in CELL else None))
        if tag in VOID:
            if above >= 0:
                tree.tags[above] += 1
            continue
        dropped, doubtful = (True, 0) if above < 0 else _unwanted(tag, attrs)
        if attrs.endswith("/") and (dropped or doubtful) and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            lower = lower if lower is not None else page.lower() if len(page.lower()) == size else page
            end = lower.find("</" + tag, at)
            if end < 0 and tag in ("script", "style"):
                break
            if end >= 0:
                close = page.find(">", end)
                at = close + 1 if close >= 0 else size
            continue
        if dropped:
            stack.append((tag, -1))
        else:
            tree.parent.append(above)
            tree.tag.append(tag)
            tree.chars.append(0)
            tree.link_chars.append(0)
            tree.tags.append(1)
            tree.link_tags.append(int(tag == "a"))
            tree.doubtful.append(doubtful)
            tree.article.append(tag in ("article", "main") and not _hinted(_attributes(attrs)))
            stack.append((tag, len(tree.parent) - 1))
        links += tag == "a"
    cut(1)
    return tree


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Composite text density of one node; body_share is body's link characters over its characters."""
    if not chars:
        return 0.0
    tags, lc, lt, plain = max(tags, 1), max(link_chars, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + body_share * chars + math.e)
    return chars / tags * max(0.0, math.log(max(chars / lc * tags / lt, 1.0)) / base) if base > 0 else 0.0


def _left_out(tree: _Tree) -> list[bool]:
    """Per node, whether it lies in a doubtful element that does not hold the article."""
    n = len(tree.parent)
    plain = [a - b for a, b in zip(tree.chars, tree.link_chars)]
    own = plain[:]  # without the doubtful elements below
    weighed = [0.0] * n  # what the outermost doubtful elements below count for
    articles = [0] * n  # in the subtree
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        articles[i] += tree.article[i] and plain[i] > 0
        articles[p] += articles[i]
        plain[p] += plain[i]
        if tree.doubtful[i]:
            weighed[p] += WEIGHTS[tree.doubtful[i]] * plain[i]
        else:
            own[p] += own[i]
            weighed[p] += weighed[i]
    within = [0] * n  # the nearest doubtful element, the node itself included; 0: none
    around = [0] * n  # articles with text of their own that enclose the node
    beside = [0] * n  # such articles by nearest doubtful element; then also those of the elements around it
    for i in range(1, n):
        p = tree.parent[i]
        within[i] = i if tree.doubtful[i] else within[p]
        around[i] = around[p]
        if tree.article[i] and own[i] > 0:
            around[i] += 1
            beside[within[i]] += 1
    out = [False] * n
    for i in range(1, n):
        p = tree.parent[i]
        out[i] = out[p]
        if tree.doubtful[i]:
            around_it = within[p]  # the doubtful element around it, or the page
            holds = articles[i] > 0 or 2 * WEIGHTS[tree.doubtful[i]] * plain[i] > own[around_it] + weighed[around_it]
            out[i] = out[i] or not holds or beside[within[p]] > around[p]
            beside[i] += beside[within[p]]
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    tree = parse(page)
    n = len(tree.parent)
    out = _left_out(tree) if any(tree.doubtful) else [False] * n
    chars, tags, link_chars, link_tags = ([0 if o else v for v, o in zip(x, out)] for x in (tree.chars, tree.tags, tree.link_chars, tree.link_tags))
    last = list(range(n))
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        for x in (chars, tags, link_chars, link_tags):
            x[p] += x[i]
        last[p] = max(last[p], last[i])
    if not chars[0]:
        return ""
    body = next((i for i in range(n) if tree.tag[i] == "body" and not out[i]), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    dense = [density(chars[i], tags[i], link_chars[i], link_tags[i], share) for i in range(n)]
    sums = [0.0] * n
    for i in range(1, n):
        sums[tree.parent[i]] += dense[i]
    if not chars[body]:
        body = 0
    best = max(range(body, last[body] + 1), key=lambda i: (sums[i], -i))
    path = [best]
    while path[-1] not in (body, 0):
        path.append(tree.parent[path[-1]])
    least = min(dense[i] for i in path)
    inside = [i for i in path if tree.article[i]]
    region = inside[0] if inside else best
    if not inside:
        for up in path[1:]:
            if tree.tag[up] in ("body", "html", "#root"):
                break
            extra = chars[up] - chars[region]
            heads = sum(chars[i] for i in range(up + 1, last[up] + 1) if tree.tag[i] in HEADING and not region <= i <= last[region])
            rest = density(extra, tags[up] - tags[region], link_chars[up] - link_chars[region], link_tags[up] - link_tags[region], share)
            if extra > heads and rest < least:
                break
            region = up
    for i in range(region + 1, last[region] + 1):  # parents come first
        links = tree.tag[i] in GROUPS and link_tags[i] > 1 and 2 * link_chars[i] > chars[i] and dense[i] < least
        out[i] = out[i] or out[tree.parent[i]] or links
    blocks: list[str] = []
    now: list[str] = []
    for node, piece in tree.text:
        if out[node] or not region <= node <= last[region]:
            continue
        if piece is None:
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        else:
            now.append(piece)
    blocks.append(" ".join("".join(now).split()))
    return "\n\n".join(b for b in blocks if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = [extract(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
