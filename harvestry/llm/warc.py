"""WARC archives with revisit resolution.

Headers (id, digest, size) are shuffled by payload digest, not the payloads: the smallest id of a digest keeps its
payload, the others become revisit records that name it. Archives are written by Spark's text writer, one record
per row with the last line feed of a record as the row separator, so they commit like any other
output; each file is a gzip stream of whole records. They are read back record by record by their
Content-Length, and revisits are joined to the responses they refer to.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.store import small

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
#: Records of one file.
FILE_RECORDS = 20_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD_ID = re.compile(rb"<urn:page:(-?\d+)>")


def _line(name: str, value: Column | str) -> Column:
    """A header line, or nothing where the value is null; control characters would end the line and are left out."""
    value = F.lit(value) if isinstance(value, str) else F.regexp_replace(value.cast("string"), r"\p{Cntrl}", "")
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _urn(column: str) -> Column:
    return F.concat(F.lit("<urn:page:"), F.col(column).cast("string"), F.lit(">"))


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES,
) -> None:
    """Writes one record per row of ``pages`` under ``folder``.

    Null payloads are empty. Of equal payloads of at least ``least_bytes`` bytes the smallest id is the response;
    repeated rows of that id are responses, too. Rows without an id are responses without a record id. Extra
    columns play no part; an empty table writes no record.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    heads = rows.filter((F.col("bytes") >= least_bytes) & F.col("id").isNotNull()).select("id", "digest")
    firsts = heads.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    revisits = heads.join(firsts, "digest").filter("id <> first").select("id", "digest", "first").distinct()
    # joined by digest as well: an id may come twice with different payloads
    rows = rows.join(small(revisits, "revisits"), ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn("id")), _line("WARC-Date", datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _line("WARC-Refers-To", _urn("first")), _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", F.octet_length("block")), F.lit("\r\n"))
    records = rows.withColumn("block", block).select(F.concat(head, "block", F.lit("\r\n\r")).alias("value"))
    records.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields[b"content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield fields, block


def _page(value: bytes | None) -> int | None:
    found = _RECORD_ID.fullmatch(value or b"")
    return int(found[1]) if found else None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "record_type", "refers_to", "payload_digest", "bytes", "intact"]
    for batch in batches:
        for content in batch.column("content"):
            rows: list[tuple] = []
            with gzip.open(io.BytesIO(content.as_buffer())) as stream:
                for fields, block in records_of(stream):
                    kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
                    payload = block.partition(b"\r\n\r\n")[2]
                    whole = kind == "revisit" or hashlib.sha256(payload).hexdigest() == digest
                    size = None if kind == "revisit" else len(payload)
                    rows.append((_page(fields.get(b"warc-record-id")), kind, _page(fields.get(b"warc-refers-to")), digest, size, whole))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``intact`` of every record.

    The size of a revisit is that of the response it refers to. ``intact``: the payload has the digest its header
    states. A file that is cut short or damaged is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    records = files.mapInArrow(_parse, "id long, record_type string, refers_to long, payload_digest string, bytes long, intact boolean")
    asked = records.filter("refers_to is not null").select(F.col("refers_to").alias("of"), F.col("payload_digest").alias("digest")).distinct()
    sizes = records.filter("record_type = 'response'").select(F.col("id").alias("of"), F.col("payload_digest").alias("digest"), F.col("bytes").alias("of_bytes"))
    sizes = small(sizes.join(asked, ["of", "digest"], "left_semi").distinct(), "responses")
    joined = records.join(sizes, (F.col("refers_to") == sizes["of"]) & (F.col("payload_digest") == sizes["digest"]), "left")
    return joined.select("id", F.coalesce("bytes", "of_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact")
