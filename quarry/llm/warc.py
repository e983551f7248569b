"""WARC archives with revisit records: written deduplicated, read back and resolved.

Payload headers (digest, length, id) are shuffled by digest; of equal payloads
of at least ``least`` bytes the row with the largest id becomes the response
and the others become revisit records that refer to it. Only the headers of
revisits are joined back to the pages, by id and digest, so a payload moves once
at most. Records get fresh headers.

Each record is a gzip member of its own, each partition starts with a warcinfo
record, and files roll at about ``FILE_BYTES`` of payload. Members go through
Spark's own file writer, so archives are committed once even if executors are
lost, on whatever store holds the folder; between them the writer sets its line
separator, an empty gzip member, which readers of archives pass over and at which
Spark's reader can split a file of any size. ``publish`` gives the files the usual
names; archives so named, or from elsewhere, are read whole, one at a time.

Reading parses records by Content-Length, shuffles revisits and responses by
payload digest and joins each revisit to its original.

Defined results:
- null html: the empty payload; null url: a urn made from the id;
- null id: such rows are responses and never another row's original;
- repeated rows: copies of the row with the largest id (the tie) are all responses;
- very long payloads: up to what one string value may hold; a task holds a batch of them;
- empty table: no archive rows, an empty result;
- other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import materialize

LEAST = 1000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of a file, by the mean size of its records.
FILE_BYTES = 1 << 28
#: The empty gzip member.
SEPARATOR = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: How Spark's text files are told to use it: as raw bytes.
RAW = {"lineSep": SEPARATOR.decode("latin-1"), "encoding": "ISO-8859-1"}
PARSED = "page_id long, record_type string, record_id string, refers_to_id string, payload_digest string, declared_bytes long, payload_bytes long, payload_sha1 string, target_uri string, payload string"


def headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    body = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the rows that refer to another. Only ids and digests are shuffled; the join splits on skew."""
    known = heads.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = known.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(first, "payload_digest").where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def resolve(rows: DataFrame, again: DataFrame) -> DataFrame:
    """rows with record_type and refers_to."""
    joined = rows.join(again, ["page_id", "payload_digest"], "left")
    return joined.withColumn("record_type", F.when(F.col("refers_to").isNotNull(), "revisit").otherwise("response"))


def record_id(page_id: Column) -> Column:
    """A custom (version 8) UUID that carries the 64 bits of the id."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0).cast("long"))), 16, "0"))
    spare = F.when(page_id.isNull(), "f").otherwise("0")
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(13, 3), F.lit("-8"), cut(16, 1), F.lit("0"), spare, F.lit("-000000000000>"))


def record_text(rows: DataFrame, date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """One text value per record, with the final blank lines."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.concat(F.lit("urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    text = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
        F.lit(CRLF * 2),
    )
    return rows.select(text.alias("value"))


def member(record: bytes) -> bytes:
    """One gzip member. UTF-8 text cannot hold the separator, nor, but for a chance of 2^-160, its compressed form."""
    return next(m for m in (gzip.compress(record, level, mtime=0) for level in (6, 9, 1)) if SEPARATOR not in m)


def _info(date: str) -> bytes:
    block = f"format: WARC File Format 1.1{CRLF}software: quarry{CRLF}"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return (CRLF.join(lines) + CRLF * 2 + block + CRLF * 2).encode()


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES, date: str = "2026-01-01T00:00:00Z", **columns: str) -> None:
    """Write one record per row of pages under path."""
    rows = headers(pages, **columns)
    heads = materialize(rows.select("page_id", "payload_bytes", "payload_digest"), "heads")
    mean = heads.agg(F.avg("payload_bytes")).first()[0] or 1.0
    again = materialize(revisits(heads, least), "revisits")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                records = [x.as_py().encode("utf-8", "surrogatepass") for x in batch.column(0).slice(at, 256)]
                packed = [member(r) for r in ([_info(date), *records] if fresh else records)]
                fresh = False
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    packed = record_text(resolve(rows, again), date).mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    packed.write.options(**RAW, maxRecordsPerFile=max(1, int(file_bytes / max(mean, 1.0)))).text(path)


def publish(spark: SparkSession, path: str) -> None:
    """Give the files of a finished ``write`` names that end in .warc.gz."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt"):
            store.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc.gz"))


_FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes, with_payload: bool = False) -> Iterator[tuple]:
    """The records of one archive. Blocks are cut by Content-Length; a payload that looks like a record does no harm."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, v in _FIELD.findall(data[data.index(b"\r\n", at) + 2 : stop + 2])}
        begin, size = stop + 4, int(fields[b"content-length"])
        block = data[begin : begin + size]
        if len(block) != size:
            raise ValueError("the archive ends inside a record")
        at = begin + size + 4
        if fields[b"warc-type"] not in (b"response", b"revisit"):
            continue
        head, _, payload = block.partition(b"\r\n\r\n")
        declared = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
        text = lambda name: fields[name].decode("utf-8") if name in fields else None
        kind = text(b"warc-type")
        own = kind == "response"
        yield (
            int(fields[b"x-page-id"]) if b"x-page-id" in fields else None,
            kind,
            text(b"warc-record-id"),
            text(b"warc-refers-to"),
            (text(b"warc-payload-digest") or "").removeprefix("sha1:"),
            int(declared[1]) if declared else None,
            len(payload) if own else None,
            hashlib.sha1(payload).hexdigest() if own else None,
            text(b"warc-target-uri"),
            payload.decode("utf-8") if own and with_payload else None,
        )


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records under path, with the digest and length recomputed from each response's payload."""
    kinds = [(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (c.split() for c in PARSED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for content in batch.column(0):  # a member or an archive
                data = content.as_py()
                rows += parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data, with_payload)
                if len(rows) >= 256:
                    yield pack(rows)
                    rows = []
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds])

    members = spark.read.options(**RAW, pathGlobFilter="part-*.txt").text(path).select(F.col("value").cast("binary").alias("content"))
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return members.unionByName(archives).mapInArrow(run, PARSED)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take digest and length from their original."""
    responses = records.where("record_type = 'response'")
    originals = responses.where("page_id is not null").groupBy(F.col("record_id").alias("o_id"), F.col("payload_sha1").alias("o_sha1")).agg(F.max("page_id").alias("o_page"), F.max("payload_bytes").alias("o_bytes"))
    revisits = records.where("record_type = 'revisit'").join(originals, (F.col("payload_digest") == F.col("o_sha1")) & (F.col("refers_to_id") == F.col("o_id")), "left")
    own = responses.select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(revisits.select("page_id", F.col("o_bytes").alias("payload_bytes"), F.col("o_sha1").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to")))
