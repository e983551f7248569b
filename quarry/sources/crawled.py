"""Sources of crawled records: cached API answers, listings of proceedings sites, bibliography releases.

Every reader declares its schema and works on cached files; nothing is fetched.
Large files are split where their records end, so one file is read by many tasks.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import one_line, split_authors
from quarry.functions.tree import Element, metas, parse
from quarry.operators.classify import presentation, venue_id, venue_string

_FIELD = "struct<value:string>"
NOTES_V2 = f"notes array<struct<id:string,forum:string,number:long,invitations:array<string>,cdate:long,content:struct<title:{_FIELD},authors:struct<value:array<string>>,abstract:{_FIELD},keywords:struct<value:array<string>>,venue:{_FIELD},venueid:{_FIELD}>>>, count long"
NOTES_V1 = "notes array<struct<id:string,forum:string,number:long,invitation:string,cdate:long,content:struct<title:string,authors:string,authorids:string,abstract:string,keywords:string,venue:string,venueid:string>>>, count long"


def _listed(text: Column) -> Column:
    """A JSON list of texts, or one text, as an array."""
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.when(F.trim(text) != "", F.array(text)))


def openreview_v2(spark: SparkSession, path: str) -> DataFrame:
    """A row per note of cached answers: forum_id, title, authors, abstract, keywords, venueid, track, status, venue, year, presentation."""
    notes = spark.read.schema(NOTES_V2).option("multiLine", True).json(path).select(F.explode("notes").alias("n"))
    c = F.col("n.content")
    rows = notes.select(
        F.coalesce("n.forum", "n.id").alias("forum_id"),
        one_line(c["title"]["value"]).alias("title"),
        c["authors"]["value"].alias("authors"),
        one_line(c["abstract"]["value"]).alias("abstract"),
        c["keywords"]["value"].alias("keywords"),
        c["venueid"]["value"].alias("venueid"),
        c["venue"]["value"].alias("venue_raw"),
        venue_id(c["venueid"]["value"]).alias("v"),
    )
    shown = F.when((F.col("v.status") == "accepted") & (F.col("v.track") != "workshop"), presentation(F.col("v.venue"), F.col("v.year"), F.col("v.track"), F.col("venue_raw")))
    return rows.withColumn("presentation", shown["value"]).select(*rows.columns[:-1], "v.track", "v.status", "v.venue", "v.year", "presentation")


def openreview_v1(spark: SparkSession, path: str) -> DataFrame:
    """A row per note of the older API. Authors may be one text; status comes from the venue string, track and year from either."""
    notes = spark.read.schema(NOTES_V1).option("multiLine", True).json(path).select(F.explode("notes").alias("n"))
    c = F.col("n.content")
    rows = notes.select(
        F.coalesce("n.forum", "n.id").alias("forum_id"),
        one_line(c["title"]).alias("title"),
        split_authors(_listed(c["authors"]), F.size(_listed(c["authorids"]))).alias("a"),
        one_line(c["abstract"]).alias("abstract"),
        _listed(c["keywords"]).alias("keywords"),
        c["venueid"].alias("venueid"),
        c["venue"].alias("venue_raw"),
        venue_id(c["venueid"]).alias("v"),
        venue_string(c["venue"]).alias("s"),
    )
    pick = lambda name: F.coalesce(F.col(f"s.{name}"), F.col(f"v.{name}")).alias(name)
    track = F.when(F.col("v.parsed") & (F.col("v.track") != "other"), F.col("v.track")).otherwise(F.col("s.track"))
    return rows.select("forum_id", "title", F.col("a.names").alias("authors"), F.col("a.how").alias("authors_how"), "abstract", "keywords", "venueid", "venue_raw", track.alias("track"), F.col("s.status").alias("status"), pick("venue"), pick("year"))


# -- listings of proceedings sites -----------------------------------------------------------------------------
@dataclass(frozen=True)
class Listing:
    """How a site lists papers: the blocks of entries, the link that makes one, where its title and authors stand."""

    block: tuple[str, str | None]
    link: str
    title: tuple[str, str | None] | None = None  # None: the link's own text
    authors: tuple[str, str | None] = ("i", None)
    within: tuple[str, str | None] | None = None
    pdf: str | None = None


#: The markup of the sites.
LISTINGS = {
    "neurips": Listing(("li", None), r"-Abstract", authors=("span", "paper-authors"), within=("ul", "paper-list")),
    "neurips_older": Listing(("li", None), r"-Abstract", authors=("i", None), within=("ul", "paper-list")),
    "pmlr": Listing(("div", "paper"), r"/v\d+/[A-Za-z0-9-]+\.html$", ("p", "title"), ("span", "authors"), pdf=r"(?<!-supp)\.pdf$"),
    "iclr_archive": Listing(("li", None), r"arxiv\.org/abs/|openreview\.net/forum", authors=("i", None)),
    "icml_site": Listing(("div", "paper"), r"\.(?:html|pdf)$", ("p", "title"), ("span", "authors")),
    "aaai_archive": Listing(("div", "paper"), r"\.php$|\.html$", ("h5", None), ("p", "authors")),
}
ENTRIES = "page_url string, at int, href string, title string, authors array<string>, pdf string, forum_id string"
_FORUM = re.compile(r"openreview\.net/(?:forum|pdf)\?(?:.*&)?id=([A-Za-z0-9_-]+)")


def entries_of(page: str | None, base: str | None, how: Listing) -> tuple[list[tuple], int]:
    """(entries of a listing in page order; how many blocks have no link)."""
    root = parse(page)
    if how.within:
        root = root.find(how.within[0], class_=how.within[1]) or Element("#none", {})
    found: list[tuple] = []
    unlinked = 0
    for block in root.find_all(how.block[0], class_=how.block[1]):
        links = [(a, urljoin(base or "", a.attributes.get("href", ""))) for a in block.find_all("a")]
        main = next(((a, href) for a, href in links if re.search(how.link, href)), None)
        forums = {m[1] for _, href in links if (m := _FORUM.search(href))}
        if main is None or len(forums) > 1:
            unlinked += 1
            continue
        title = block.find(how.title[0], class_=how.title[1]) if how.title else main[0]
        authors = block.find(how.authors[0], class_=how.authors[1])
        names = [n for n in (" ".join(p.split()) for p in (authors.text() if authors else "").split(",")) if n]
        pdf = next((href for _, href in links if how.pdf and re.search(how.pdf, href)), None)
        found.append((main[1], title.text() if title else "", names, pdf, next(iter(forums), None)))
    return found, unlinked


def listing_entries(pages: DataFrame, site: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_url, at, href, title, authors, pdf, forum_id) of every entry of some listing pages."""
    how = LISTINGS[site]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(url, i, *e) for i, e in enumerate(entries_of(page, url, how)[0])]
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return pages.select(url_col, html_col).mapInArrow(run, ENTRIES)


def listing_report(pages: DataFrame, site: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_url, stated, found, unlinked): what each page says it lists, and what was read."""
    how = LISTINGS[site]

    @F.pandas_udf("struct<stated:long,found:long,unlinked:long>")
    def report(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        out = []
        for url, page in zip(urls, pages):
            found, unlinked = entries_of(page, url, how)
            count = parse(page).find("span", class_="paper-count")
            stated = re.match(r"([\d,]+) paper", count.text()) if count else None
            out.append((int(stated[1].replace(",", "")) if stated else None, len(found), unlinked))
        return pd.DataFrame(out, columns=["stated", "found", "unlinked"]).astype("Int64")

    return pages.select(F.col(url_col).alias("page_url"), report(F.col(url_col), F.col(html_col)).alias("r")).select("page_url", "r.*")


#: Where a paper's page holds its abstract.
ABSTRACTS = {"neurips": ("p", {"class_": "paper-abstract"}), "pmlr": ("div", {"id": "abstract"}), "icml_site": ("div", {"id": "abstract"}), "aaai_archive": ("div", {"class_": "attribute-output"})}


def paper_pages(pages: DataFrame, site: str, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, title, authors, abstract, pdf, doi) of papers' own pages: citation tags, and the abstract's element."""
    tag, where = ABSTRACTS[site]

    @F.pandas_udf("struct<title:string,authors:array<string>,abstract:string,pdf:string,doi:string>")
    def read(pages: pd.Series) -> pd.DataFrame:
        out = []
        for page in pages:
            root = parse(page)
            one = lambda name: next((x for x in metas(root, name) if x), None)  # noqa: E731, B023
            abstract = root.find(tag, **where)
            out.append((one("citation_title"), [x for x in metas(root, "citation_author") if x], abstract.text() if abstract else None, one("citation_pdf_url"), one("citation_doi")))
        return pd.DataFrame(out, columns=["title", "authors", "abstract", "pdf", "doi"])

    return pages.select(F.col(url_col).alias("url"), read(F.col(html_col)).alias("r")).select("url", "r.*")


# -- bibliography releases ---------------------------------------------------------------------------------------
@F.pandas_udf(T.StringType())
def _decoded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else entities.unescape(x))


def decoded(text: Column) -> Column:
    """Character references read; texts without one stay in the JVM."""
    needs = F.contains(text, F.lit("&"))
    return F.when(needs, _decoded(F.when(needs, text))).otherwise(text)


def _texts(record: Column, tag: str) -> Column:
    """The texts of all elements of a name, without markup inside, in one line."""
    found = F.regexp_extract_all(record, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " ")))


def _all_decoded(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Decode array columns in one pass, through JSON, where any holds a reference."""
    for c in columns:
        joined = F.array_join(c, "\u001f", "")
        rows = rows.withColumn(c, F.when(F.size(c) > 0, F.split(decoded(joined), "\u001f")).otherwise(F.col(c)))
    return rows


def dblp(spark: SparkSession, path: str, kind: str = "inproceedings", streams: tuple[str, ...] = ()) -> DataFrame:
    """(key, mdate, authors, title, pages, year, booktitle, ee, crossref) of a release's records of one kind, of some key prefixes.

    The file is split where such records end; character references are HTML's.
    """
    raw = spark.read.option("lineSep", f"</{kind}>").text(path)
    start = rf"(?s)<{kind}\s([^>]*)>(.*)$"
    rows = raw.select(F.regexp_extract("value", start, 1).alias("a"), F.regexp_extract("value", start, 2).alias("r")).where("a <> ''")
    rows = rows.withColumn("key", F.regexp_extract("a", r'key="([^"]*)"', 1)).withColumn("mdate", F.regexp_extract("a", r'mdate="([^"]*)"', 1))
    if streams:
        wanted = [F.startswith("key", F.lit(s)) for s in streams]
        for extra in wanted[1:]:
            wanted[0] = wanted[0] | extra
        rows = rows.where(wanted[0])
    lists = {"authors": "author", "ee": "ee", "titles": "title"}
    rows = rows.select("key", "mdate", "r", *[_texts(F.col("r"), tag).alias(name) for name, tag in lists.items()])
    rows = _all_decoded(rows, list(lists))
    one = lambda tag: F.get(_texts(F.col("r"), tag), F.lit(0))
    return rows.select("key", "mdate", "authors", F.get("titles", F.lit(0)).alias("title"), one("pages").alias("pages"), one("year").try_cast("int").alias("year"), one("booktitle").alias("booktitle"), "ee", one("crossref").alias("crossref"))


def oai_records(spark: SparkSession, path: str) -> DataFrame:
    """(article, deleted, set_spec, title, creators, description, doi, article_url, volume) of cached OAI-PMH answers, English texts first."""
    raw = spark.read.option("lineSep", "</record>").text(path).where(F.contains("value", F.lit("<header")))
    texts = lambda tag: _texts(F.col("value"), tag)
    english = lambda tag: F.coalesce(F.nullif(F.trim(F.regexp_extract("value", rf'(?s)<{tag}\s[^>]*xml:lang="en[^"]*"[^>]*>(.*?)</{tag}>', 1)), F.lit("")), F.get(texts(tag), F.lit(0)))
    idents = texts("dc:identifier")
    first = lambda a, test: F.get(F.filter(a, test), F.lit(0))
    return raw.select(
        F.regexp_extract("value", r"<identifier>\s*oai:[^<]*article/(\d+)\s*</identifier>", 1).try_cast("long").alias("article"),
        F.rlike("value", F.lit(r'<header[^>]*status="deleted"')).alias("deleted"),
        F.get(texts("setSpec"), F.lit(0)).alias("set_spec"),
        decoded(english("dc:title")).alias("title"),
        F.filter(texts("dc:creator"), lambda x: x != "").alias("creators"),
        decoded(english("dc:description")).alias("description"),
        first(idents, lambda x: x.rlike(r"^10\.\d{4,9}/\S+$")).alias("doi"),
        first(idents, lambda x: x.rlike(r"^https?://[^/]+/.*article/view/")).alias("article_url"),
        F.regexp_extract(F.array_join(texts("dc:source"), " "), r"(?i)vol\.?\s*(\d+)", 1).try_cast("int").alias("volume"),
    )


WORKS = "status string, `message-type` string, message struct<items:array<struct<DOI:string,type:string,title:array<string>,subtitle:array<string>,author:array<struct<given:string,family:string,name:string>>,page:string>>,`total-results`:long,`next-cursor`:string>"


def crossref_works(spark: SparkSession, path: str) -> DataFrame:
    """(doi, type, title, authors, unnamed, page) of cached answers; an answer that is not a work list is an error."""
    answers = spark.read.schema(WORKS).option("multiLine", True).json(path)
    sound = (F.col("status") == "ok") & (F.col("message-type") == "work-list")
    checked = answers.where(F.when(F.coalesce(sound, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a cached answer is not a work list")).cast("boolean")))
    w = checked.select(F.explode("message.items").alias("w"))
    clean = lambda a: F.filter(F.transform(a, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", ""), r"\s+", " "))), lambda t: t != "")
    title, sub = F.get(clean(F.col("w.title")), F.lit(0)), F.get(clean(F.col("w.subtitle")), F.lit(0))
    whole = F.when(sub.isNull() | F.contains(F.lower(title), F.lower(sub)), title).otherwise(F.concat(title, F.lit(": "), sub))
    person = lambda a: F.coalesce(F.nullif(F.concat_ws(" ", F.trim(a["given"]), F.trim(a["family"])), F.lit("")), F.nullif(F.trim(a["name"]), F.lit("")))
    people = F.coalesce("w.author", F.array().cast("array<struct<given:string,family:string,name:string>>"))
    names = F.filter(F.transform(people, person), lambda x: x.isNotNull())
    return w.select(F.lower(F.trim("w.DOI")).alias("doi"), F.col("w.type").alias("type"), decoded(whole).alias("title"), names.alias("authors"), (F.size(people) - F.size(names)).alias("unnamed"), F.col("w.page").alias("page"))


def lookup_table(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """(name, row): the named tables of a small TOML file, each as JSON; a table without a required key is an error."""
    import tomllib

    tables = tomllib.loads(spark.read.text(path, wholetext=True).first()[0])  # a file kept by hand
    for name, row in tables.items():
        lacking = [k for k in required if not isinstance(row, dict) or k not in row]
        if lacking:
            raise ValueError(f"{name} lacks {', '.join(lacking)}")
    return spark.createDataFrame([(name, json.dumps(row, sort_keys=True, default=str)) for name, row in tables.items()], "name string, row string")
