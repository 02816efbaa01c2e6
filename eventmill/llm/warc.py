"""WARC archives whose repeated payloads are revisit records.

Only headers (digest, id, length) are grouped by payload digest. The original of a
digest is joined back to the records, which are then written afresh: a response holds
its payload, a revisit refers to the record that does. Records go through Spark's own
text writer with the WARC record end as line separator, so any store Spark reaches will
do; the reader frames them by Content-Length.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_REVISIT_BYTES = 1000
RECORDS_PER_FILE = 2000
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, payload binary"
)


def resolve_revisits(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_url.

    Of equal payloads of ``min_bytes`` or more the row with the largest id is the
    response, the others revisit it; shorter ones are all responses. NULL html is an
    empty payload. Rows that share the largest id are all responses. A NULL id is never
    the largest, its row revisits; where all ids are NULL all rows are responses.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1(F.col("html").cast("binary"))}
    )
    # payloads are equal when their SHA-1 is
    headers = rows.filter(F.col("payload_bytes") >= min_bytes).select("payload_digest", "page_id", "url")
    originals = (
        headers.groupBy("payload_digest")
        .agg(
            F.max("page_id").alias("original_id"),
            F.max_by("url", "page_id").alias("original_url"),
            F.count("*").alias("copies"),
        )
        .filter("copies > 1 and original_id is not null")
        .drop("copies")
    )
    resolved = rows.join(originals, "payload_digest", "left")
    revisit = F.col("original_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original_id"))
    return resolved.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original_id")).alias("refers_to"),
        F.when(revisit, F.col("original_url")).alias("refers_url"),
    )


def _clean(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\x00-\\x20\\x7F]+", "%20")


def _record_id(page_id: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def records(resolved: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """One string column: WARC/1.1 records without their end marks."""

    def field(name: str, value: Column) -> Column:
        # NULL values leave the whole line out
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit("\r\n\r\n"),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.when(F.col("url").isNotNull(), _clean(F.col("url")))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("refers_url")))),
        field("WARC-Refers-To-Target-URI", F.when(revisit & F.col("refers_url").isNotNull(), _clean(F.col("refers_url")))),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Refers-To-Page-ID", F.col("refers_to").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return resolved.select(F.concat(header, block).alias("value"))


def write_archives(resolved: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write gzip archives of at most ``records_per_file`` records each, without moving rows."""
    (
        records(resolved)
        .write.option("lineSep", RECORD_END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record, framed by Content-Length."""
    at, end = 0, len(content)
    while at < end:
        stop = content.index(b"\r\n\r\n", at)
        lines = content[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(re.match(r"([^:]+):\s*(.*)", x, re.S).groups() for x in lines[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        start = stop + 4
        after = start + int(fields["content-length"])
        if content[after : after + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has a wrong length")
        yield fields, content[start:after]
        at = after + 4


def _rows(content: bytes) -> Iterator[tuple]:
    for fields, block in parse_archive(gzip.decompress(content)):
        head, _, payload = block.partition(b"\r\n\r\n")
        length = int(re.search(rb"(?i)^content-length:\s*(\d+)", head, re.M)[1])
        digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
        if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its header")
        page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        yield (
            int(page) if page else None,
            fields.get("warc-target-uri"),
            length,
            digest,
            kind,
            int(other) if other else None,
            payload if kind == "response" else None,
        )


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of the records below ``path``; response payloads are checked against digest and length.

    Files are read one at a time; ``write_archives`` bounds their records. An empty
    folder gives no rows.
    """
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(fields)]
    schema = pa.schema(list(zip(fields, types, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = list(_rows(content.as_py()))
                columns = list(zip(*rows, strict=True))[: len(fields)] if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema
                )

    wanted = ", ".join(SCHEMA.split(", ")[: len(fields)])
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, wanted)
