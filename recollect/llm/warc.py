r"""WARC archives by way of a chunked record table.

Writing: each task streams its records into archives of its own (one gzip member a
record, a new file beyond ROLL_BYTES); a payload goes through the compressor in chunks.
Payloads stay where they are read: what decides between response and revisit is a table of
the digests that occur twice or more, which is broadcast up to a number of rows that is
checked; beyond it revisits, told by narrow rows, are set apart by one join on digest and
page, and carry no payload from there on.
Reading: archives are streamed back into rows (record, chunk number, data) with the
digest of all payload bytes so far, so neither side ever holds an oversized record
beside its input row. Archives live in the shared folder under names that no second
attempt of a task reuses; the manifest that names them is a table that only finished
tasks write, so lost executors leave at most files that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, new_path, qualified, stored, table

CHUNK_BYTES = 1 << 20
ROLL_BYTES = 64 << 20
LEVEL = 1
_BATCH_BYTES = 8 << 20
#: Rows of repeated digests (some 60 bytes each) that are broadcast, and archives read by a task of their own.
MOST_BROADCAST, MOST_READERS = 500_000, 20_000


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def groups(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(d, s, least), stored: digest and size of payloads of at least ``min_bytes`` that occur
    twice or more, and the smallest page_id."""
    payload = _payload()
    keys = pages.select("page_id", F.unhex(F.sha1(payload)).alias("d"), F.octet_length(payload).alias("s")).where(F.col("s") >= min_bytes)
    return stored(keys.groupBy("d", "s").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-groups")


def _payload() -> Column:
    return F.coalesce("html", F.lit("")).cast("binary")


def roles(pages: DataFrame, twice: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url, payload, digest, size, record_type, refers_to); a revisit has no payload.

    Of payloads in ``twice`` (:func:`groups`) the smallest page_id is a response and the
    others revisit it. Rows that repeat that page_id are all responses; a null page_id is a
    response only if its whole group is null.
    """
    payload = _payload()
    rows = pages.select("page_id", "url", payload.alias("payload"), F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).alias("size"))
    same = (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))
    revisit = F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    names = ["page_id", "url", "payload", "digest", "size"]
    if twice.limit(most_broadcast + 1).count() <= most_broadcast:
        joined = rows.join(F.broadcast(twice), same, "left")
        return joined.select(
            "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("least")).alias("refers_to")
        )
    again = rows.drop("payload").join(twice, same).where(revisit)
    keys = again.select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), F.col("size").alias("_s")).distinct()
    first = rows.join(keys, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left_anti")
    least = pages.schema["page_id"].dataType
    first = first.select(*names, F.lit("response").alias("record_type"), F.lit(None).cast(least).alias("refers_to"))
    return first.unionByName(again.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "size", F.lit("revisit").alias("record_type"), F.col("least").alias("refers_to")))


def _clean(value: str | None) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def _id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


class _Archive:
    """Writes records to rolling archives below ``folder``; ``done`` lists (path, records)."""

    def __init__(self, folder: str):
        self.fs, self.folder = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.out, self.done, self.n, self.size = None, [], 0, 0

    def open(self) -> None:
        self.path = f"{self.folder}/{uuid.uuid4().hex}.warc.gz"
        self.out, self.n, self.size = self.fs.open_output_stream(self.path, compression=None), 0, 0

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.path, self.n))
            self.out = None

    def record(self, page_id, url, payload, digest, size, record_type, refers_to) -> None:
        """``payload`` is a buffer, None for a revisit; ``digest`` and ``size`` are of the whole payload."""
        if self.out is None:
            self.open()
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        body = memoryview(payload or b"")
        head = [
            "WARC/1.1",
            f"WARC-Type: {record_type}",
            f"WARC-Record-ID: {_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {_clean(url)}",
            f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}",
            f"X-Payload-Length: {size}",
        ]
        if record_type == "revisit":
            head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
        head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self._put(z.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + http))
        for at in range(0, len(body), CHUNK_BYTES):
            self._put(z.compress(body[at : at + CHUNK_BYTES]))
        self._put(z.compress(b"\r\n\r\n") + z.flush())
        self.n += 1
        if self.size >= ROLL_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)


_RECORD = ["page_id", "url", "payload", "digest", "size", "record_type", "refers_to"]


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes ``roles`` rows below ``folder``; returns the stored manifest (path, records)."""

    def run(batches):
        archive = _Archive(folder)
        for b in batches:
            page_id, url, payload, *rest = (b.column(k) for k in _RECORD)
            for i in range(len(b)):
                data = payload[i].as_buffer() if payload[i].is_valid else None
                archive.record(page_id[i].as_py(), url[i].as_py(), data, *(c[i].as_py() for c in rest))
        archive.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in archive.done], pa.string()), pa.array([n for _, n in archive.done], pa.int64())], ["path", "records"])

    return stored(records.select(*_RECORD).mapInArrow(run, "path string, records long"), "warc-manifest")


class _Stream:
    """Decompressed bytes of consecutive gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.z, self.held, self.rest = source, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.rest or self.source.read(256 << 10)
            self.rest = b""
            if not data:
                return False
            got = self.z.decompress(data, CHUNK_BYTES)
            self.rest = self.z.unconsumed_tail
            if got:
                self.held += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is skipped; None at the end of the stream."""
        while (at := self.held.find(mark)) < 0:
            if not self._more():
                if self.held.strip():
                    raise ValueError("an archive ends within a record")
                return None
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        """Between one and ``most`` bytes."""
        if not self.held and not self._more():
            raise ValueError("an archive ends within a payload")
        out, self.held = self.held[:most], self.held[most:]
        return out

    def exactly(self, n: int) -> bytes:
        parts = []
        while n:
            parts.append(self.take(n))
            n -= len(parts[-1])
        return b"".join(parts)


def _records(stream: _Stream, chunk: int):
    """Yields (headers, chunk number, data, bytes so far, digest so far, last)."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogatepass").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
        h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        left, sha, so_far, number = int(h["content-length"]), hashlib.sha1(), 0, 0
        http = stream.until(b"\r\n\r\n")  # the header of the response
        left -= len(http) + 4
        while True:
            data = stream.exactly(min(chunk, left))
            left -= len(data)
            so_far += len(data)
            sha.update(data)
            yield h, number, data, so_far, base32_sha1(sha.digest()), not left
            number += 1
            if not left:
                break
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


_CHUNKS = "page_id long, url string, record_type string, refers_to long, chunk long, data binary, bytes_so_far long, digest_so_far string, last boolean, payload_bytes long, payload_digest string"


def read_chunks(manifest: DataFrame, folder: str, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives in ``manifest``.

    One row a chunk: page_id, chunk (from 0), data (null if not ``with_data``),
    bytes_so_far and digest_so_far of the payload up to it, last; a record without payload
    has one empty chunk. payload_bytes and payload_digest are the header's; a response
    whose last chunk disagrees with them is an error.
    """
    number = lambda v: int(v[len("<urn:x-page:") : -1]) if v and v != "<urn:x-page:>" else None
    names = [x.strip().split()[0] for x in _CHUNKS.split(",")]

    def run(batches):
        files, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with files.open_input_stream(path, compression=None) as source:
                    for h, k, data, so_far, digest, last in _records(_Stream(source), chunk_bytes):
                        kind, said, length = h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        if last and kind == "response" and (digest, so_far) != (said, length):
                            raise ValueError(f"digest of {h['warc-record-id']} differs: {digest} {said}")
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], kind, number(h.get("warc-refers-to")), k, data if with_data else None, so_far, digest, last, length, said))
                        size += len(data) if with_data else 200
                        if size >= _BATCH_BYTES or len(rows) >= 10_000:
                            yield _batch(rows, names)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    files = manifest.select("path")
    # a task for each archive: a number of partitions that is given is not merged again
    return files.repartitionByRange(max(1, min(files.count(), MOST_READERS)), "path").mapInArrow(run, _CHUNKS)


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list, names: list) -> pa.RecordBatch:
    kinds = [_TYPES[x.strip().split()[1]] for x in _CHUNKS.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def archive(pages: DataFrame, min_bytes: int = 0, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, str]:
    """Writes ``pages`` as WARC records; returns the manifest and the archives' folder.

    Null html is an empty payload, a null url an empty target; repeated rows make a record
    each; other columns are ignored; an empty table makes an empty manifest. Archives and
    manifest are the caller's to delete.
    """
    folder = qualified(pages.sparkSession, new_path(pages.sparkSession, "warc"))
    twice = groups(pages, min_bytes)
    manifest = write_archives(roles(pages, twice, most_broadcast), folder)
    drop_stored(twice)
    return manifest, folder


def query(spark, sf_dir):
    manifest, folder = archive(table(spark, sf_dir, "pages"))
    return read_chunks(manifest, folder).where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> {}) & 31 AS INT) + 1, 1)"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS hex, unnest(range(8)) AS g FROM p),
v AS (SELECT page_id, t, g, CAST(('0x' || substr(hex, CAST(5 * g + 1 AS INT), 5)) AS BIGINT) AS v FROM h),
b AS (SELECT page_id, t, string_agg({" || ".join(_DIGIT.format(s) for s in (15, 10, 5, 0))}, '' ORDER BY g) AS digest FROM v GROUP BY page_id, t),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS least FROM b)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM f
"""
