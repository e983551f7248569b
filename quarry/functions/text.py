"""Scalar functions on text, urls and identifiers, as Spark columns wherever the JVM can express them."""

from __future__ import annotations

import re
import unicodedata as ud
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_MARKS = 8
#: Hosts of proceedings sites.
SITES = {"proceedings.neurips.cc": "NeurIPS", "papers.nips.cc": "NeurIPS", "papers.neurips.cc": "NeurIPS", "proceedings.iclr.cc": "ICLR", "proceedings.mlr.press": "ICML", "ojs.aaai.org": "AAAI", "aaai.org": "AAAI", "dl.acm.org": "FAccT"}


def one_line(s: Column) -> Column:
    """Control characters become spaces, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"\p{Cc}", " "), r"(?U)\s+", " "))


def clean_abstract(s: Column) -> Column:
    """Repairs (cid:n) debris; placeholders and cut snippets become null."""
    text = one_line(F.regexp_replace(s, r"\(cid:\d+\)", " "))
    bad = F.lower(text).isin("n/a", "na", "none", "null", "tbd", "no abstract", "no abstract available", "abstract", "-") | text.rlike("^(…|\\.\\.\\.)|(…|\\.\\.\\.)$")
    return F.when((text != "") & ~bad, text)


def cap_marks(text: str | None) -> str | None:
    """At most MAX_MARKS combining marks in a row."""
    if text is None or text.isascii():
        return text
    out, run = [], 0
    for c in text:
        run = run + 1 if ud.combining(c) else 0
        if run <= MAX_MARKS:
            out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def cap_marks_column(s: pd.Series) -> pd.Series:
    return s.map(cap_marks)


def cap_length(text: str | None, most: int) -> str | None:
    """Cut before the last space that fits, counted in NFKD characters."""
    if text is None or len(text) * 18 <= most or len(ud.normalize("NFKD", text)) <= most:
        return text
    held, space = 0, 0
    for i, c in enumerate(text):
        if c == " ":
            space = i
        held += len(ud.normalize("NFKD", c))
        if held > most:
            return text[: space or i].rstrip()
    return text


def cap_list(items: Column, most: int) -> Column:
    return F.slice(items, 1, most)


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else ud.normalize("NFKC", x).casefold())


def sort_title(title: Column) -> Column:
    """The key of the title order: NFKC, then case folded. ASCII stays in the JVM and reaches Python as nulls."""
    plain = F.octet_length(title) == F.char_length(title)
    return F.when(plain, F.lower(title)).otherwise(_folded(F.when(~plain, title)))


def inflection_stem(token: Column) -> Column:
    """One English inflection removed by fixed rules; short tokens stay."""
    long = F.char_length(token) > 4
    cut = lambda n, add="": F.concat(F.expr("''"), F.substring(token, F.lit(1), F.char_length(token) - n), F.lit(add))
    return (
        F.when(long & token.rlike("ies$"), cut(3, "y"))
        .when(long & token.rlike("(ss|sh|ch|x|z)es$"), cut(2))
        .when(long & token.rlike("[^s]s$"), cut(1))
        .when((F.char_length(token) > 5) & token.rlike("ing$"), cut(3))
        .when(long & token.rlike("ed$"), cut(2))
        .otherwise(token)
    )


def surname(name: Column) -> Column:
    """Family name for comparison: the part before a comma, else the last word, lower-cased letters only."""
    last = F.when(F.contains(name, F.lit(",")), F.split_part(name, F.lit(","), F.lit(1))).otherwise(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    found = F.regexp_replace(F.lower(last), r"[^\p{L}]", "")
    return F.when(found != "", found)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)


def title_verdict(a: Column, b: Column, least: float = 0.9) -> Column:
    """exact, similar (enough alike, the same digits) or null, for title keys."""
    digits = lambda c: F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))
    return F.when(a == b, "exact").when((similarity(a, b) >= least) & (digits(a) == digits(b)), "similar")


# -- urls and identifiers ----------------------------------------------------------------------------------
def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site(url: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SITES.items() for x in pair])
    return table[F.regexp_replace(host(url), r"^www\.", "")]


def forum_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"^https?://(?:www\.)?openreview\.net/(?:forum|pdf|attachment|revisions)\?(?:[^#]*&)?id=([A-Za-z0-9_-]+)", 1)
    return F.when(found != "", found)


def doi_key(text: Column) -> Column:
    """The bare lower-case DOI of a DOI, its label or its link."""
    plain = F.regexp_replace(F.trim(text), r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)", "")
    decoded = F.when(plain.rlike("%[0-9A-Fa-f]{2}"), F.try_url_decode(plain)).otherwise(plain)
    found = F.regexp_extract(F.lower(decoded), r"^(10\.\d{4,9}/\S+?)[.,;]*$", 1)
    return F.when(found != "", found)


def native_id(url: Column) -> Column:
    """nips-, iclr-, pmlr-, ojs- or doi- id of a proceedings link."""
    nips = F.regexp_extract(url, r"^https?://(?:papers\.n(?:eur)?ips\.cc|proceedings\.neurips\.cc)/.*?([0-9a-f]{32})", 1)
    iclr = F.regexp_extract(url, r"^https?://proceedings\.iclr\.cc/.*?([0-9a-f]{32})", 1)
    pmlr = F.regexp_extract(url, r"^https?://proceedings\.mlr\.press/v(\d+/[A-Za-z0-9-]+?)(?:\.html|/|$)", 1)
    ojs = F.regexp_extract(url, r"^https?://ojs\.aaai\.org/index\.php/[A-Za-z]+/article/view/(\d+)", 1)
    doi = doi_key(F.when(url.rlike(r"^https?://(dx\.)?doi\.org/"), url))
    return (
        F.when(nips != "", F.concat(F.lit("nips-"), nips))
        .when(iclr != "", F.concat(F.lit("iclr-"), iclr))
        .when(pmlr != "", F.concat(F.lit("pmlr-v"), F.replace(pmlr, F.lit("/"), F.lit("-"))))
        .when(ojs != "", F.concat(F.lit("ojs-"), ojs))
        .when(doi.isNotNull(), F.concat(F.lit("doi-"), doi))
    )


def names_native(url: Column, native: Column) -> Column:
    """Whether a link is the page of the paper with this native id, also one that stops after the page's hash."""
    tail = r"^https?://(?:papers\.n(?:eur)?ips\.cc|proceedings\.(?:neurips|iclr)\.cc)(?:/paper_files)?/paper/[0-9]{4}/hash/([0-9a-fA-F]{32})/?$"
    hashed = F.lower(F.regexp_extract(url, tail, 1))
    prefix = F.when(host(url).startswith("proceedings.iclr"), "iclr-").otherwise("nips-")
    return F.coalesce(native_id(url) == native, F.lit(False)) | F.coalesce((hashed != "") & (F.concat(prefix, hashed) == native), F.lit(False))


def is_doi(s: Column) -> Column:
    """Whether a text is a bare DOI: a registrant of four to nine digits, a slash, no white space."""
    return F.coalesce(s.rlike(r"^10\.\d{4,9}(\.\d+)*/\S+$"), F.lit(False))


def is_url(s: Column) -> Column:
    return F.coalesce(s.rlike(r"^https?://[^\s/?#]+[^\s]*$"), F.lit(False))


def start_page(pages: Column) -> Column:
    found = F.regexp_extract(pages, r"(\d+)", 1)
    return F.when(found != "", found.cast("int"))


_NEEDS_SPLIT = r"^and\s|\sand\s|\sand$"


def split_authors(entries: Column, count: Column) -> Column:
    """struct (names, how): names as listed if no entry joins two; else split at commas and "and", if that gives ``count`` names; else refused."""
    kept = F.filter(entries, lambda x: F.trim(x) != "")
    needs = F.exists(kept, lambda x: x.rlike(_NEEDS_SPLIT))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^and(\s+|$)", ""), r"(^|\s+)and$", "")
    pieces = F.flatten(F.transform(kept, lambda x: F.transform(F.split(bare(x), r",\s+and\s+|,|\s+and\s+"), lambda p: F.trim(p))))
    names = F.filter(pieces, lambda x: x != "")
    fine = F.coalesce((F.size(names) == count) & ~F.exists(names, lambda x: x.rlike(_NEEDS_SPLIT)), F.lit(False))
    none = F.array().cast("array<string>")
    return F.when(entries.isNull(), F.struct(none.alias("names"), F.lit("listed").alias("how"))).otherwise(
        F.struct(F.when(~needs, kept).when(fine, names).otherwise(none).alias("names"), F.when(~needs, "listed").when(fine, "split").otherwise("refused").alias("how"))
    )


def local_to_utc(local: Column, offset: Column) -> Column:
    """The moment of a local wall time (text) at an offset of ±HH:MM up to fourteen hours; null where either is malformed."""
    minutes = F.regexp_extract(offset, r"^[+-](\d\d):(\d\d)$", 1).try_cast("int") * 60 + F.regexp_extract(offset, r"^[+-](\d\d):(\d\d)$", 2).try_cast("int")
    fine = offset.rlike(r"^[+-]\d\d:[0-5]\d$") & (minutes <= 14 * 60)
    signed = F.when(offset.startswith("-"), -minutes).otherwise(minutes)
    return F.when(fine, F.try_to_timestamp(F.concat(F.regexp_replace(local, "T", " "), F.lit("Z"))) - F.make_dt_interval(mins=signed))


def utc_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# -- html and inverted indexes -----------------------------------------------------------------------------
#: Tags that separate words.
BLOCKS = frozenset("address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.metas: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in BLOCKS:
            self.parts.append(" ")
        elif tag == "meta":
            found = dict(attrs)
            if found.get("name") and found.get("content") is not None:
                self.metas.append((found["name"].lower(), found["content"]))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.parts.append(" ")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


_BARE = re.compile(r"<(?![A-Za-z/!?])")


def html_text(fragment: str | None) -> str | None:
    """Text of an HTML fragment: block tags separate, inline ones vanish, scripts and styles go, entities are decoded once."""
    if fragment is None:
        return None
    parser = _Text()
    parser.feed(_BARE.sub("&lt;", fragment))
    parser.close()
    return " ".join("".join(parser.parts).split())


def metas(page: str, name: str) -> list[str]:
    parser = _Text()
    parser.feed(page)
    return [content for n, content in parser.metas if n == name.lower()]


@F.pandas_udf(T.StringType())
def html_text_column(s: pd.Series) -> pd.Series:
    return s.map(html_text)


def rebuild(inverted: Column) -> Column:
    """Text of a map word -> positions; null where positions have gaps or clash."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    ordered = F.array_sort(pairs)
    whole = F.forall(F.arrays_zip(ordered.alias("x"), F.sequence(F.lit(0), F.size(ordered) - 1).alias("i")), lambda z: z["x"]["p"] == z["i"])
    return F.when((F.size(pairs) > 0) & whole, F.array_join(F.transform(ordered, lambda x: x["w"]), " "))
