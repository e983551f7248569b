"""RIS: a DataFrame reader for tagged bibliographic files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import doi_key, forum_id, native_id

#: The line tags that are read, and the columns they fill.
TAGS = {"TI": "title", "T1": "title", "AB": "abstract", "T2": "venue_raw", "JO": "venue_raw", "PY": "year_raw", "ID": "key"}


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, title, abstract, authors, venue_raw, year, urls, forum_ids, native_ids, dois, keywords.

    Records end with an ER line; the file is split there, so large files are read in parallel.
    """
    raw = spark.read.option("lineSep", "ER  -").text(path)
    lines = F.regexp_extract_all("value", F.lit(r"(?m)^[ \t]*([A-Z][A-Z0-9])  ?- ?(.*?)[ \t\r]*$"), F.lit(0))
    rows = raw.select(lines.alias("l")).where(F.size("l") > 0)
    tagged = F.transform("l", lambda x: F.struct(F.substring(F.ltrim(x), 1, 2).alias("tag"), F.trim(F.regexp_replace(x, r"^[ \t]*[A-Z][A-Z0-9]  ?- ?", "")).alias("v")))
    rows = rows.select(F.filter(tagged, lambda x: x["v"] != "").alias("l"))
    all_of = lambda *tags: F.transform(F.filter("l", lambda x: x["tag"].isin(list(tags))), lambda x: x["v"])
    one = lambda *tags: F.get(all_of(*tags), F.lit(0))
    by_column = {c: one(*[t for t, name in TAGS.items() if name == c]) for c in dict.fromkeys(TAGS.values())}
    links = all_of("UR", "L1", "L2")
    keep = lambda a: F.array_distinct(F.filter(a, lambda x: x.isNotNull()))
    return rows.select(
        *[v.alias(c) for c, v in by_column.items() if c != "year_raw"],
        F.regexp_extract(F.coalesce(by_column["year_raw"], F.lit("")), r"^(\d{4})", 1).try_cast("int").alias("year"),
        all_of("AU", "A1").alias("authors"),
        all_of("KW").alias("keywords"),
        links.alias("urls"),
        keep(F.transform(links, forum_id)).alias("forum_ids"),
        keep(F.transform(links, native_id)).alias("native_ids"),
        keep(F.transform(F.concat(all_of("DO"), links), doi_key)).alias("dois"),
    )
