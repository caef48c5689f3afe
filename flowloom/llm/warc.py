"""WARC archives with revisit resolution.

Payload headers are shuffled by digest to choose one response of each payload;
all others become revisit records that refer to it.  Archives are written by
Spark's text writer: a row is the records of one archive, a file is one row, so
a file's size is bounded without a shuffle and a lost task leaves no half file.
Reading parses whole archives by Content-Length and joins revisits to the
responses that they refer to.

Rows: a null html is an empty payload; payloads under ``least_bytes`` are always
responses; a null url is written as ``about:blank``; a null page_id is after all
others when the response of a payload is chosen, and rows that repeat the chosen
page_id with the payload are responses too; html may be of any length and hold
any text, record separators too; an empty table writes no archive and reads no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm.common import salted_join

#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\r\n\r\n"
#: Identity of this writer's records: ids are name-based, so rewriting gives the same archives.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:flowloom:warc")
LEAST_BYTES = 100
ARCHIVE_CHARS = 4_000_000
RECORD = "page_id long, uri string, type string, payload_bytes long, payload_digest string, record_id string, refers_to_id string, payload string"


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def resolve(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """*headers* (page_id, payload_bytes, payload_digest) with ``original``: the page whose response a revisit refers to, null for responses."""
    first = (headers.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("__n")).where("__n > 1 and first is not null").drop("__n"))
    found = salted_join(headers, first, ["payload_digest"], ["page_id"], "left")
    return found.withColumn("original", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def _record(kind: str, page_id, url, digest, original, body: str, date: str) -> str:
    block_head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body.encode('utf-8'))}{SEPARATOR}"
    block = block_head + ("" if kind == "revisit" else body)
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "about:blank"
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}",
             f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(original, digest)}", f"WARC-Refers-To-Date: {date}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode('utf-8'))}"]
    return "\r\n".join(lines) + SEPARATOR + block


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z", archive_chars: int = ARCHIVE_CHARS) -> None:
    """Write a record for each row of *pages* (page_id, url, html) to archives under *path*, each payload once."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload(F.col("html").cast("string")).alias("html"))
    digest = F.sha2(F.col("html"), 256)
    rows = rows.withColumn("payload_digest", digest).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    headers = rows.select("page_id", "payload_bytes", "payload_digest")
    # only the pages that become revisits are joined back; their payloads are not needed any more
    revisits = resolve(headers, least_bytes).where("original is not null").select(
        F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), "original").distinct()
    joined = rows.join(revisits, rows["page_id"].eqNullSafe(revisits["__page"]) & (rows["payload_digest"] == revisits["__digest"]), "left")
    joined = joined.select("page_id", "url", "payload_digest", "original", "html")

    def archives(batches):
        held, size = [], 0
        for batch in batches:
            for page, url, d, original, html in zip(*[c.to_pylist() if i < 4 else c for i, c in enumerate(batch.columns)]):
                kind = "response" if original is None else "revisit"
                held.append(_record(kind, page, url, d, original, html.as_py(), date))
                size += len(held[-1])
                if size >= archive_chars:
                    yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.string())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([SEPARATOR.join(held)], pa.string())], names=["value"])

    joined.mapInArrow(archives, "value string").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path, compression="gzip")


def parse_archive(data: bytes):
    """(headers, block) of each record of an archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not re.fullmatch(r"WARC/1\.[01]", lines[0]):
            raise ValueError(f"no record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        start = end + 4
        stop = start + int(head["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield head, data[start:stop]
        at = stop + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under *path*; ``payload`` is null for revisits (and for all records without *payloads*)."""
    import gzip
    import hashlib

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[list] = [[] for _ in range(8)]
                for head, block in parse_archive(gzip.decompress(content.as_py())):
                    body = block[block.index(b"\r\n\r\n") + 4:]
                    kind, page, digest = head["warc-type"], head.get("x-page-id"), head["warc-payload-digest"].split(":", 1)[1]
                    if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"payload of {head['warc-record-id']} differs from its digest")
                    values = (int(page) if page else None, head["warc-target-uri"], kind, len(body) if kind == "response" else None, digest,
                              head["warc-record-id"], head.get("warc-refers-to"), body.decode("utf-8") if payloads and kind == "response" else None)
                    for column, v in zip(rows, values):
                        column.append(v)
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=[f.split()[0] for f in RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def resolved_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per record, revisits joined to the responses that they name."""
    originals = (records.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.min("payload_bytes").alias("original_bytes"), F.min("page_id").alias("original")))
    revisits = salted_join(records.where("type = 'revisit'").select("page_id", "payload_digest", "type", "refers_to_id"), originals, ["refers_to_id"], ["page_id"], "left")
    return (records.where("type = 'response'").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
            .unionByName(revisits.select("page_id", F.col("original_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"), F.col("original").alias("refers_to"))))
