"""Export sinks: RIS, CSV, BibTeX and JSON lines, as one text value per record in id order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.operators.ranking import global_rank

#: Column order of the CSV export, and what a spreadsheet would run.
CSV_COLUMNS = ("id", "title", "abstract", "venue", "year", "track", "status", "abstract_kind")
FORMULA = r"^[=+\-@\t\r]"


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "))


def ris(records: DataFrame) -> DataFrame:
    """(id, value): tagged lines in a fixed order."""
    line = lambda tag, c: F.when(_flat(c) != "", F.concat(F.lit(f"{tag}  - "), _flat(c)))
    value = F.concat_ws("\n", F.lit("TY  - CONF"), line("TI", F.col("title")), line("AB", F.col("abstract")), line("PY", F.col("year").cast("string")), line("T2", F.col("venue")), line("ID", F.col("id")), F.lit("ER  - "))
    return records.select("id", value.alias("value"))


def csv(records: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """(id, value): quoted cells; a cell that a spreadsheet would run gets an apostrophe."""

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        safe = F.when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)
        return F.when(safe.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return records.select("id", F.concat_ws(",", *[cell(c) for c in columns]).alias("value"))


def jsonl(records: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """(id, value): one JSON object per record, keys sorted, nulls kept."""
    return records.select("id", F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"))


def bibtex_keys(records: DataFrame) -> DataFrame:
    """(id, bib_key): venue, year and first title word; repeats get a, b, … in id order, aa after z."""
    word = F.regexp_extract(F.lower("title"), "([a-z0-9]+)", 1)
    base = F.concat(F.lower("venue"), F.col("year").cast("string"), F.when(word != "", word).otherwise("untitled"))
    numbered = global_rank(records.select("id", base.alias("base")), ["base", "id"], "at")  # no task holds all records of one base
    firsts = numbered.groupBy("base").agg(F.min("at").alias("first"), F.count("*").alias("many"))
    keyed = numbered.join(firsts, "base", "left").withColumn("n", F.col("at") - F.col("first"))
    letter = lambda i: F.expr(f"char(97 + cast({i} as int))")
    suffix = F.when(F.col("n") < 26, letter("n")).otherwise(F.concat(letter("floor(n / 26) - 1"), letter("n % 26")))
    return keyed.select("id", F.when(F.col("many") > 1, F.concat("base", suffix)).otherwise(F.col("base")).alias("bib_key"))


def bibtex(records: DataFrame) -> DataFrame:
    """(id, value): one entry per record; braces in values are balanced by removing them."""
    clean = lambda c: F.regexp_replace(_flat(c), r"[{}\\]", "")
    kind = F.when(F.col("status") == "accepted", "@inproceedings{").otherwise("@misc{")
    joined = records.join(bibtex_keys(records), "id")
    field = lambda name, c: F.when(clean(c) != "", F.concat(F.lit(f"  {name} = {{"), clean(c), F.lit("},")))
    value = F.concat_ws("\n", F.concat(kind, F.col("bib_key"), F.lit(",")), field("title", F.col("title")), field("booktitle", F.col("venue")), field("year", F.col("year").cast("string")), field("abstract", F.col("abstract")), F.lit("}"))
    return joined.select("id", value.alias("value"))


FORMATS = {"ris": ris, "csv": csv, "bibtex": bibtex, "jsonl": jsonl}


def write(records: DataFrame, form: str, path: str, expected: int | None = None) -> int:
    """Write all records in id order as text under path; a count other than expected is an error."""
    seen = Observation()
    rows = FORMATS[form](records).orderBy("id").observe(seen, F.count("*").alias("n"))
    rows.select("value").write.mode("errorifexists").text(path)
    written = seen.get["n"]
    if expected is not None and written != expected:
        raise ValueError(f"{written} records written, {expected} expected")
    return written
