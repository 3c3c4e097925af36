"""WARC records as tables of chunks.

An archive is a table of rows (archive, record, chunk, last, crc, data): a record's chunks, put together in their
order, are a WARC/1.1 record, and an archive's records one after the other are a WARC file. A payload is never
copied as a whole: it is digested and written slice by slice from the column's own memory, and read chunk by chunk.
crc is the running checksum of the record up to and including the chunk, which the reader follows, as it does the
payload's SHA-1; either differing is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.llm.shingles import byte_arrays
from fluvial.staging import bounded_batches, join_skewed, materialize

CHUNK = 1 << 20
#: Digests with more than one record that are broadcast at most (some 60 bytes each).
SHARED = 500_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive long, record long, chunk long, last boolean, crc long, data binary"


def payload_digest(data: np.ndarray) -> str:
    sha = hashlib.sha1()
    for at in range(0, len(data), CHUNK):
        sha.update(memoryview(data[at : at + CHUNK]))
    return base64.b32encode(sha.digest()).decode()


def record_name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def _line(value: str | None) -> str:
    return " ".join((value or "").split()) or "urn:none"


def head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """The record's header and the HTTP header before its payload. The HTTP header has the full payload's size for revisits, too."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        fields.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    fields.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http


def record_chunks(first: bytes, payload: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, bool, int, bytes]]:
    """(chunk, last, crc, data) of a record: its header, payload and closing lines in chunks of `size`, the last up to 4 bytes longer."""
    crc, k, at = 0, 0, 0
    begin = first
    while True:
        room = max(0, size - len(begin))
        data = begin + payload[at : at + room].tobytes()
        at, begin = at + room, b""
        last = at >= len(payload)
        if last:
            data += b"\r\n\r\n"
        crc = zlib.crc32(data, crc)
        yield k, last, crc, data
        if last:
            return
        k += 1


def last_of_equals(pages: DataFrame, least: int = 0) -> DataFrame:
    """sha, last_id: for payloads of at least `least` bytes that more than one row has, the largest page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keys = pages.filter(F.octet_length(payload) >= least).select("page_id", F.unhex(F.sha2(payload.cast("binary"), 256)).alias("sha"))
    return keys.groupBy("sha").agg(F.max("page_id").alias("last_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "last_id")


def write_archives(pages: DataFrame, path: str, least: int = 0, size: int = CHUNK) -> None:
    """Write a record for each row of pages (page_id, url, html) as a table of chunks at `path`.

    Of equal payloads of at least `least` bytes, rows with the largest page_id are responses and the others revisit
    it. A null html is an empty payload. Only a row with a null page_id, among others with one, revisits without
    being named itself; rows with null page_ids alone are all responses. Repeated rows are records of their own, of
    which none revisits itself. Payloads of any length go slice by slice. An empty table gives an archive without
    records; other columns, whatever their names, are ignored.
    """
    bounded_batches(pages.sparkSession)
    shared = materialize(last_of_equals(pages, least), "shared")
    few = shared.count() <= SHARED
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", "html", F.unhex(F.sha2(payload.cast("binary"), 256)).alias("sha"))
    rows = rows.join(F.broadcast(shared), "sha", "left") if few else join_skewed(rows, shared, ["sha"], ["page_id", "url"], "left")
    refers = F.when(~F.col("last_id").eqNullSafe(F.col("page_id")) & F.col("last_id").isNotNull() & (F.octet_length(payload) >= least), F.col("last_id"))
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", refers.cast("long").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, record, out, held = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            told = zip(batch["page_id"].to_pylist(), batch["url"].to_pylist(), batch["refers_to"].to_pylist(), byte_arrays(batch["html"]), strict=True)
            for page_id, url, refers_to, data in told:
                first = head(page_id, url, len(data), payload_digest(data), refers_to)
                for k, last, crc, part in record_chunks(first, data if refers_to is None else data[:0], size):
                    out.append((archive, record, k, last, crc, part))
                    held += len(part)
                    if held >= 4 * CHUNK:
                        yield _chunk_rows(out)
                        out, held = [], 0
                record += 1
        yield _chunk_rows(out)

    rows.mapInArrow(write, CHUNKS).write.option("compression", "zstd").parquet(path)


def _chunk_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
    columns = zip(*out, strict=True) if out else [()] * 6
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "record", "chunk", "last", "crc", "data"])


class Reader:
    """Takes a record's chunks one by one; what it holds of them is its header."""

    def __init__(self) -> None:
        self.crc, self.head, self.fields, self.http = 0, b"", None, None
        self.sha, self.size, self.left, self.tail = hashlib.sha1(), 0, 0, b""

    def feed(self, crc: int, data: bytes) -> None:
        self.crc = zlib.crc32(data, self.crc)
        if self.crc != crc:
            raise ValueError("a chunk is damaged, missing or out of order")
        view = memoryview(data)
        if self.http is None:
            self.head += data
            if self.fields is None and b"\r\n\r\n" in self.head:
                own, self.head = self.head.split(b"\r\n\r\n", 1)
                self.fields = self._read(own)
                self.left = int(self.fields["content-length"])
            if self.fields is None or b"\r\n\r\n" not in self.head:
                return
            own, rest = self.head.split(b"\r\n\r\n", 1)
            self.http = self._read(own)
            self.left -= len(own) + 4
            view, self.head = memoryview(rest), b""
        payload = view[: self.left]
        self.sha.update(payload)
        self.size += len(payload)
        self.left -= len(payload)
        self.tail += bytes(view[len(payload) :])

    @staticmethod
    def _read(lines: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode().split("\r\n")[1:])}

    def done(self) -> tuple:
        """(page_id, payload_bytes, payload_digest, record_type, refers_to)"""
        if self.http is None or self.left or self.tail != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        f = self.fields
        told, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
        if kind == "response" and told != base64.b32encode(self.sha.digest()).decode():
            raise ValueError("a payload differs from its digest")
        number = lambda name: int(f[name]) if name in f else None
        return number("x-page-id"), self.size if kind == "response" else int(self.http["content-length"]), told, kind, number("x-refers-to-page-id")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records from chunks that come in order."""
    reader, key, after = None, None, 0
    for batch in batches:
        out = []
        columns = (batch[c].to_pylist() for c in ("archive", "record", "chunk", "last", "crc"))
        for i, (archive, record, chunk, last, crc) in enumerate(zip(*columns, strict=True)):
            if chunk == 0:
                reader, key, after = Reader(), (archive, record), 0
            if reader is None or key != (archive, record) or chunk != after:
                raise ValueError("a chunk is missing")
            reader.feed(crc, batch["data"][i].as_py())
            after += 1
            if last:
                out.append(reader.done())
                reader = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if reader is not None:
        raise ValueError("a record is cut short")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives at `path`: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records of one chunk are read where they are; only the chunks of longer ones are brought together, in order, and read
    one by one. An archive without records gives an empty result.
    """
    bounded_batches(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    one = chunks.filter("chunk = 0 and last").mapInArrow(_read, RECORDS)
    more = chunks.filter("chunk > 0 or not last").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return one.unionByName(more.mapInArrow(_read, RECORDS))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last_id FROM pages
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last_id THEN last_id END AS refers_to
FROM p
"""
