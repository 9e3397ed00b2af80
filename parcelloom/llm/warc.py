"""WARC archives written from pages and read as a table of payload chunks.

Writing: payloads are compared by their SHA-256; of equal ones that of the smallest page_id is a response
record and the others are revisit records that refer to it.  A payload is hashed, compressed and written a
piece at a time from the batch that holds it.

Reading: a file is parsed as a stream, a gzip member for each record.  A payload comes as rows of
record identifier and chunk number, each with the payload's SHA-1 up to and with that chunk, so no record is
ever held whole and any prefix of a payload can be verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.llm import textkernel as tk
from parcelloom.llm.shared import filesystem, shared_dir, written

CHUNK = 1 << 20
FILE_BYTES = 256 << 20
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class CorruptArchive(ValueError):
    """An archive does not parse, or a digest does not hold."""


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _urn(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def _page(urn: str) -> int | None:
    name = urn.rpartition(":")[2].rstrip(">")
    return None if name == "null" else int(name)


def _head(page, url, refers_to, digest: str, size: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines.append(f"Content-Length: {len(_HTTP) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _write(folder: str):
    manifest = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        part, seq, out, records, size, name = TaskContext.get().partitionId(), 0, None, 0, 0, ""

        def put(deflate, piece) -> None:
            nonlocal size
            got = deflate.compress(piece)
            size += len(got)
            out.write(got)

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [name], "records": [records], "bytes": [size]}, schema=manifest)

        for batch in batches:
            pages, urls, first = (batch.column(i).to_pylist() for i in (0, 1, 3))
            revisit = batch.column(4).to_pylist()
            data, at = tk.string_buffers(batch.column(2))
            for n, page in enumerate(pages):
                if out is None:
                    name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, seq, records, size = fs.open_output_stream(f"{path}/{name}", compression=None), seq + 1, 0, 0
                payload = memoryview(data[at[n] : at[n + 1]])
                sha = hashlib.sha1(payload, usedforsecurity=False)
                deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
                put(deflate, _head(page, urls[n], first[n] if revisit[n] else None, _base32(sha.digest()), len(payload)) + _HTTP)
                if not revisit[n]:
                    for lo in range(0, len(payload), CHUNK):
                        put(deflate, payload[lo : lo + CHUNK])
                put(deflate, b"\r\n\r\n")
                tail = deflate.flush()
                size += len(tail)
                out.write(tail)
                records += 1
                if size >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for every row of ``pages``; the manifest ``file, records, bytes``.

    Rows with equal payloads of at least ``min_bytes`` bytes share one response record, that of the smallest
    page_id; rows that repeat that page_id and payload are written as responses too.  A null payload is
    empty, a null url is left out, a null page_id is last in order and is never referred to unless all ids of its
    payload are null.  Other columns are ignored; an empty table gives no file.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("_key", F.sha2("html", 256))
    # which record a page refers to is found by ids and digests alone
    narrow = rows.select("page_id", "_key").distinct()
    first = written(narrow.groupBy("_key").agg(F.min("page_id").alias("_first")), "first")
    of = narrow.join(first, "_key").select(F.col("page_id").alias("_page"), F.col("_key").alias("_digest"), "_first")
    # payloads move once, by page and digest, so copies of one payload don't meet; the narrow side is held in memory
    rows = rows.join(of.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_key") == F.col("_digest")))
    revisit = F.coalesce((F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first")) & F.col("_first").isNotNull(), F.lit(False))
    rows = rows.select("page_id", "url", "html", "_first", revisit.alias("_revisit"))
    return written(rows.mapInArrow(_write(folder), "file string, records long, bytes long"), "manifest")


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise CorruptArchive("a record does not begin with its version")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Stream:
    """Records' bytes from a file of gzip members, a piece at a time."""

    def __init__(self, f, piece: int = CHUNK) -> None:
        self.f, self.piece, self.inflate, self.raw, self.buffer = f, piece, None, b"", b""

    def _more(self) -> bytes:
        """Some more bytes of this member; none at its end."""
        while True:
            if self.inflate.eof:
                return b""
            if not self.raw:
                self.raw = self.f.read(self.piece)
                if not self.raw:
                    raise CorruptArchive("the file ends within a record")
            got = self.inflate.decompress(self.raw, self.piece)
            self.raw = self.inflate.unconsumed_tail or self.inflate.unused_data
            if got:
                return got

    def begin(self) -> bool:
        """Go to the next member, if there is one."""
        if self.inflate is not None:
            while self._more():
                pass
        if not self.raw:
            self.raw = self.f.read(self.piece)
        self.buffer = b""
        if not self.raw:
            return False
        self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes:
        while mark not in self.buffer:
            got = self._more()
            if not got:
                raise CorruptArchive("a header does not end")
            self.buffer += got
        head, _, self.buffer = self.buffer.partition(mark)
        return head

    def pieces(self, n: int) -> Iterator[bytes]:
        """``n`` bytes in pieces of a fixed size but the last."""
        while n:
            want = min(n, self.piece)
            parts, have = [self.buffer], len(self.buffer)
            while have < want:
                got = self._more()
                if not got:
                    raise CorruptArchive("a record is too short")
                parts.append(got)
                have += len(got)
            whole = b"".join(parts)
            self.buffer = whole[want:]
            n -= want
            yield whole[:want]


CHUNK_SCHEMA = "page_id long, record_type string, refers_to long, chunk long, last boolean, payload_bytes long, payload_digest string, data binary"


def _chunks(folder: str, with_data: bool, piece: int):
    fields = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("data", pa.binary())])

    def parse(stream: _Stream) -> Iterator[tuple]:
        while stream.begin():
            head = _headers(stream.until(b"\r\n\r\n"))
            size, kind, page = int(head["content-length"]), head["warc-type"], _page(head["warc-record-id"])
            said, of = head["warc-payload-digest"].removeprefix("sha1:"), int(head["payload-length"])
            http = stream.until(b"\r\n\r\n")
            if kind == "revisit":
                yield page, kind, _page(head["warc-refers-to"]), 0, True, of, said, b"" if with_data else None
                continue
            left, sha, done, chunk = size - len(http) - 4, hashlib.sha1(usedforsecurity=False), 0, 0
            if not left:
                yield page, kind, None, 0, True, 0, _base32(sha.digest()), b"" if with_data else None
            for piece_ in stream.pieces(left):
                sha.update(piece_)
                done += len(piece_)
                yield page, kind, None, chunk, done == left, done, _base32(sha.digest()), piece_ if with_data else None
                chunk += 1
            if left != of or _base32(sha.digest()) != said:
                raise CorruptArchive(f"the payload of {head['warc-record-id']} is not what its digest says")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    rows: list = []
                    held = 0
                    for row in parse(_Stream(f, piece)):
                        rows.append(row)
                        held += 200 + len(row[-1] or b"")
                        if held >= 8 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), fields)], schema=fields)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), fields)], schema=fields)

    return run


def read_chunks(manifest: DataFrame, folder: str, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each record's payload.

    ``page_id, record_type, refers_to, chunk`` (from 0), ``last``, ``payload_bytes`` and ``payload_digest`` (base32
    SHA-1) of the payload up to and with the chunk, and ``data`` (null without ``with_data``).  A revisit record and an
    empty payload have one row; a revisit's length and digest are those of the payload that it refers to.  Repeated and
    null page_ids have a record, so rows, of their own each; a payload that does not have its recorded digest is an error,
    and an empty manifest gives no rows.
    """
    return manifest.select("file").repartition(max(1, min(manifest.count(), 65536))).mapInArrow(_chunks(folder, with_data, chunk), CHUNK_SCHEMA)


def op8_chunked_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    folder = f"{shared_dir(spark)}/warc"
    manifest = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_chunks(manifest, folder, with_data=False).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
