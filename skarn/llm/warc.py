"""WARC archives: writing pages as gzip members through Spark's own committed writer, and a splittable reader.

Writing: each record is one gzip member. Of payloads that are equal and not short, the page with the largest id
is stored and the others become revisit records that name it. The members go through Spark's text writer, whose
commit protocol makes retried tasks safe on any file system: a gzip member of under 16 MB ends in a zero
byte, which serves as the line separator (a longer one is followed by an empty member).

Reading: files are listed with their lengths, cut into byte ranges, and every range is a row. A task scans its
range for the gzip magic, validates a candidate by inflating its start and decoding the record header, and owns
the records whose members start inside the range, reading past its end as far as the last one goes.

Defined results: a null payload is empty; pages with a null id or url are written without that header and read back with
null; repeated rows are records of their own; a member that is damaged or holds no WARC record is passed over;
an empty table or folder gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.runtime import cut, map_arrow

MAGIC = b"\x1f\x8b\x08"
#: Fixed values of the record format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
BROADCAST_ROWS = 100_000
READ = 1 << 18
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def member(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}",
        *([] if page_id is None else [f"WARC-Record-ID: <{RECORD_ID}{page_id}>"]),
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"]),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        *([] if refers_to is None else [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _line(m: bytes) -> bytes:
    return m[:-1] if m[-1] == 0 else m + gzip.compress(b"", 6, mtime=0)[:-1]


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes page_id, url, html of every row as WARC records under path."""
    raw = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    sized = pages.select("page_id", "url", raw.alias("payload"), F.sha1(raw).alias("sha1"))
    long = sized.where(F.octet_length("payload") >= least_bytes)
    stored = cut(long.groupBy("sha1").agg(F.max("page_id").alias("stored_id"), F.count("*").alias("n")).where("n > 1").select(F.col("sha1").alias("of"), "stored_id"))
    small = stored.count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(stored) if small else stored, sized.sha1 == F.col("of"), "left")
    other = F.when(F.col("stored_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored_id")), F.col("stored_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array([_line(member(*row, date)) for row in rows], pa.binary())], names=["line"])

    lines = map_arrow(joined.select("page_id", "url", "payload", "sha1", other.alias("refers_to")), run, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.mode("overwrite").text(path, lineSep="\x00")


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records in an inflated member."""
    at = 0
    while (m := re.compile(rb"WARC/1\.\d+\r\n").match(data, at)) and (end := data.find(b"\r\n\r\n", at)) > 0:
        lines = data[m.end() : end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"]) if headers.get("content-length", "").isdigit() else 0
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class _Tail:
    """The bytes of a file from a position on, read as needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.size, self.at, self.data = file, size, start, b""

    def want(self, n: int) -> bytes:
        """At least n bytes from the current position, or all that there are."""
        while len(self.data) < n and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            got = self.file.read(max(READ, n - len(self.data)))
            if not got:
                break
            self.data += got
        return self.data

    def skip(self, n: int) -> None:
        self.at, self.data = self.at + n, self.data[n:]


def inflate(tail: _Tail) -> tuple[bytes, int] | None:
    """The member at the tail's position and its length, or None if it is no whole WARC member."""
    d, out, used, step = zlib.decompressobj(31), [], 0, 4096
    try:
        while not d.eof:
            chunk = tail.want(used + step)[used : used + step]
            if not chunk:
                return None
            out.append(d.decompress(chunk))
            used += len(chunk) - len(d.unused_data)
            if len(out) == 1 and not out[0].startswith(b"WARC/1."):
                return None
            step = READ
    except zlib.error:
        return None
    return b"".join(out), used


def owned(file, start: int, end: int, size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the members that start in [start, end)."""
    tail = _Tail(file, start, size)
    while tail.at < end:
        k = tail.want(READ).find(MAGIC)
        if k < 0:
            if tail.at + len(tail.data) >= size:
                return
            k = len(tail.data) - len(MAGIC) + 1
            tail.skip(k)
        elif tail.at + k < end:
            tail.skip(k)
            got = inflate(tail)
            if got:
                yield from records(got[0])
            tail.skip(got[1] if got else 1)
        else:
            return


def _open(path: str):
    fs, name = pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.open_input_file(name)


def read_archives(spark: SparkSession, path: str, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """record_id, record_type, target_uri, refers_to, payload_digest (hex SHA-1), payload_bytes, payload of every record
    under path. Digest and length are of the payload read, for a revisit as its headers give them."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
    n = max(1, ranges.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.name for f in schema]
        for b in batches:
            for name, size, start in zip(*(c.to_pylist() for c in b.columns)):
                rows, held = [], 0
                with _open(name) as file:
                    for headers, block in owned(file, start, min(start + split_bytes, size), size):
                        rows.append(_row(headers, block, with_payload))
                        held += len(block)
                        if held > (8 << 20) or len(rows) >= 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema).select(fields)

    types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(f.name, types[f.dataType.simpleString()]) for f in T._parse_datatype_string(RECORD_SCHEMA).fields])
    return map_arrow(ranges.repartition(n), run, RECORD_SCHEMA)


def _row(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not headers.get("content-type", "").startswith("application/http") or not gap:
        http, payload = b"", block
    kind, given = headers.get("warc-type"), headers.get("warc-payload-digest", "")
    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    if kind == "revisit":
        stated = re.search(rb"(?im)^content-length: *(\d+)", http)
        digest, size = (base64.b32decode(given[5:]).hex() if given.startswith("sha1:") and len(given) == 37 else None), int(stated[1]) if stated else None
    bare = lambda x: x.strip("<>") if x else None
    return {"record_id": bare(headers.get("warc-record-id")), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "refers_to": bare(headers.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": size, "payload": payload if with_payload and kind != "revisit" else None}


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
s AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last_id <> page_id THEN last_id END AS refers_to
FROM s
"""
