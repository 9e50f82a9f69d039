"""WARC records: bytes to rows, rows to bytes, and files of them.

`parse` reads records from a column of bytes, `read` from files (plain, or gzip of one member for each
record), and `members` makes the bytes that such files are put together from. A record's block is an HTTP answer; its headers and body
come apart.

Defined results: bytes that hold no whole record give no row from there on; a null gives none. Records
that are neither responses nor revisits are kept with their kind, without HTTP headers. A record
without a date, target or id has null there. Ids are the numbers at their end (`<urn:record:17>`).
Header names keep their case; of names that come twice the last one counts.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The profile of a revisit that a server answered as not modified.
NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"

RECORD = "record_id long, url string, captured long, kind string, etag string, modified string, headers map<string,string>, body binary"


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Names and values; a line that begins with a space goes on with the one before."""
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name is not None:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            key, colon, value = line.partition(b":")
            if colon:
                name = key.strip().decode("utf-8", "replace")
                out.pop(name, None)
                out[name] = value.strip().decode("utf-8", "replace")
    return out


def split(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each whole record of WARC bytes."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _fields(data[at:end].split(b"\r\n")[1:])
        size = {k.lower(): v for k, v in fields.items()}.get("content-length", "")
        block = end + 4
        if not size.isdecimal() or block + int(size) > len(data):
            return
        yield fields, data[block : block + int(size)]
        at = block + int(size)
        while data.startswith(b"\r\n", at):
            at += 2


def http(block: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of an HTTP answer."""
    head, _, body = block.partition(b"\r\n\r\n")
    return _fields(head.split(b"\r\n")[1:]), body


def _time(text: str | None) -> int | None:
    try:
        return int(datetime.fromisoformat((text or "").replace("Z", "+00:00")).astimezone(timezone.utc).timestamp())
    except ValueError:
        return None


def row(fields: dict[str, str], block: bytes) -> tuple:
    """A record as a row of RECORD."""
    own = {k.lower(): v for k, v in fields.items()}
    number = own.get("warc-record-id", "").strip("<>").rpartition(":")[2]
    kind = own.get("warc-type")
    headers, body = http(block) if kind in ("response", "revisit") else ({}, block)
    low = {k.lower(): v for k, v in headers.items()}
    return int(number) if number.isdecimal() else None, own.get("warc-target-uri"), _time(own.get("warc-date")), kind, low.get("etag"), low.get("last-modified"), list(headers.items()), body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["record_id", "url", "captured", "kind", "etag", "modified", "headers", "body"])


def parse(records: DataFrame, col: str = "warc") -> DataFrame:
    """The records that a column of bytes holds, as rows of RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row(*x) for data in batch.column(0).to_pylist() if data for x in split(data)]
            if rows:
                yield _batch(rows)

    return records.select(f"`{col}`").mapInArrow(run, RECORD)


def unzipped(data: bytes) -> bytes:
    """Plain bytes of a file's: gzip members one after the other, or as they are."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out = []
    while data.startswith(b"\x1f\x8b"):
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, which Spark's reader opens; a file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for x in split(unzipped(data)):
                    rows.append(row(*x))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def members(records: DataFrame, col: str = "warc") -> DataFrame:
    """Each record's bytes as a gzip member: one after the other they are a WARC file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0) for x in batch.column(0).to_pylist() if x], pa.binary())], names=["member"])

    return records.select(f"`{col}`").mapInArrow(run, "member binary")
