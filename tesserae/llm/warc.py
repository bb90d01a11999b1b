"""WARC archives as a chunked record table: written in streams, read back as record-identifier and chunk-number rows.

Records come to the writers as rows of record identifier and chunk number, a payload of any size in chunks of ``CHUNK``
bytes. A writer streams them into a gzip member for each record, takes the SHA-1 as it goes and checks it against the
declared one at the last chunk; its files are of bounded size and lie in the shared folder. What a task wrote counts only
through the manifest row it returns, so a repeated task does no harm. Readers stream a file and emit chunk rows that carry
the SHA-1 of the record so far. No Python process ever holds a whole record.

A payload of at least ``MIN_REVISIT`` bytes that several records share is stored once, with the largest identifier; the
others are revisit records, whose block is the HTTP header alone.

Defined results. Null html: an empty payload. Null or repeated identifiers: each row is a record; where equal payloads
also share the largest identifier, each row with it is a response. Identifiers of any characters: percent-encoded in the
archive. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, shared_dir, table

MIN_REVISIT = 1000
#: Bytes of payload in a chunk.
CHUNK = 1 << 20
#: A file is closed once it has so many bytes.
FILE = 64 << 20
CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UTC = timezone.utc


# ---------------------------------------------------------------- writing


def _header(kind: str, key: str, uri: str, digest: str, size: int, length: int, refers_to: str | None) -> tuple[bytes, bytes]:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:tesserae:{quote(key, safe='')}>",
        f"WARC-Date: {datetime.fromtimestamp(0, _UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {''.join(uri.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + length}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:tesserae:{quote(refers_to, safe='')}>"]
    return "\r\n".join(lines).encode("utf-8", "replace") + CRLF + CRLF, http


class Writer:
    """Files of gzip members in ``folder``, through whatever file system its URI names."""

    def __init__(self, folder: str, limit: int = FILE):
        self.store, self.path = fs.FileSystem.from_uri(folder)
        self.folder, self.limit, self.out, self.files = folder.rstrip("/"), limit, None, []

    def begin(self, key: str, uri: str, digest: str, size: int, refers_to: str | None) -> None:
        """``size``: of the whole payload; of a record that refers to another nothing is appended."""
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.n, self.size = self.store.open_output_stream(f"{self.path}/{self.name}", compression=None), 0, 0
        self.declared, self.left, self.sha = digest, 0 if refers_to is not None else size, hashlib.sha1()
        self.checked = refers_to is None
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        for piece in _header("response" if refers_to is None else "revisit", key, uri, digest, size, self.left, refers_to):
            self._put(self.member.compress(piece))

    def append(self, data: memoryview) -> None:
        self.sha.update(data)
        self.left -= len(data)
        self._put(self.member.compress(data))

    def end(self) -> None:
        if self.left or (self.checked and self.sha.hexdigest() != self.declared):
            raise ValueError("the chunks of a record are not the payload that was declared")
        self._put(self.member.compress(CRLF + CRLF))
        self._put(self.member.flush())
        self.n += 1
        if self.size >= self.limit:
            self.close()

    def write(self, key: str, uri: str, digest: str, payload: memoryview, refers_to: str | None) -> None:
        """A record whose payload is at hand."""
        self.begin(key, uri, digest, len(payload), refers_to)
        if refers_to is None:
            for i in range(0, len(payload), CHUNK):
                self.append(payload[i : i + CHUNK])
        self.end()

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.files.append((f"{self.folder}/{self.name}", self.n, self.size))
            self.out = None


def write_archives(chunks: DataFrame, folder: str, limit: int = FILE) -> DataFrame:
    """Writes ``record_id`` (string), ``uri``, ``digest``, ``bytes`` (of the payload), ``refers_to``, ``chunk`` (from 0),
    ``last`` and ``data`` (binary), whose rows stand in order; returns the manifest: ``path``, ``n_records``, ``bytes``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(folder, limit)
        for b in batches:
            data = b.column("data")
            for i, (key, uri, digest, size, refers, number, last) in enumerate(zip(*(b.column(c).to_pylist() for c in names[:-1]), strict=True)):
                if number == 0:
                    writer.begin(key or "", uri or "", digest or "", size, refers)
                if buffer := data[i].as_buffer():
                    writer.append(memoryview(buffer))
                if last:
                    writer.end()
        writer.close()
        cols = list(zip(*writer.files, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "n_records", "bytes"])

    names = ["record_id", "uri", "digest", "bytes", "refers_to", "chunk", "last", "data"]
    return chunks.select(*names).mapInArrow(run, "path string, n_records bigint, bytes bigint")


# ---------------------------------------------------------------- reading


class _Stream:
    """Plain bytes of concatenated gzip members, a bounded piece at a time."""

    def __init__(self, source, piece: int = CHUNK):
        self.source, self.piece, self.raw, self.buffer = source, piece, b"", bytearray()
        self.member = zlib.decompressobj(31)

    def _more(self) -> bool:
        while True:
            if self.member.eof:
                self.raw, self.member = self.member.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.source.read(self.piece)
                if not self.raw:
                    return False
            made = self.member.decompress(self.raw, self.piece)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if made:
                self.buffer += made
                return True

    def line(self) -> bytes | None:
        """Up to and without the next line end; None at the end of the file."""
        while (at := self.buffer.find(CRLF)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[:at])
        del self.buffer[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        """The next bytes: between one and ``n`` of them; none at the end of the file."""
        if not self.buffer and not self._more():
            return b""
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        return out


def _fields(stream: _Stream) -> dict[str, str]:
    found = {}
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def read_chunks(source, chunk: int = CHUNK) -> Iterator[tuple]:
    """``record_id, record_type, refers_to, declared digest, declared bytes, chunk number, offset, data, SHA-1 so far,
    last`` for each chunk of each record; a record without payload has one empty chunk."""
    stream = _Stream(source)
    while (first := stream.line()) is not None:
        if not first.startswith(b"WARC/"):
            if first:
                raise ValueError(f"no WARC record here: {first[:40]!r}")
            continue  # the empty lines that end a record
        head = _fields(stream)
        size = int(head["content-length"])
        status = stream.line() or b""
        http, used = {}, len(status) + 2
        while line := stream.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            http[name.strip().lower()] = value.strip()
            used += len(line) + 2
        rest, sha, number, offset = size - used - 2, hashlib.sha1(), 0, 0
        clean = lambda x: unquote(x.removeprefix("<urn:tesserae:").removesuffix(">")) if x is not None else None
        told = (clean(head["warc-record-id"]), head["warc-type"], clean(head.get("warc-refers-to")), head["warc-payload-digest"].partition(":")[2], int(http["content-length"]))
        while True:
            data = b""
            while rest and len(data) < chunk:  # chunks of even size, whatever the pieces read
                part = stream.take(min(rest, chunk - len(data)))
                if not part:
                    raise EOFError("the archive ends inside a record")
                data += part
                rest -= len(part)
            sha.update(data)
            yield (*told, number, offset, data, sha.hexdigest(), not rest)
            number, offset = number + 1, offset + len(data)
            if not rest:
                break


CHUNKS = pa.schema(
    [("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("sha1", pa.string()), ("last", pa.bool_())]
)


def read_archives(manifest: DataFrame) -> DataFrame:
    """The chunk table of the files in ``manifest``, read by as many tasks as there are files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, inside = fs.FileSystem.from_uri(path)
                with store.open_input_stream(inside, compression=None) as source:
                    rows, held = [], 0
                    for row in read_chunks(source):
                        held += len(row[7])
                        rows.append(row)
                        if held >= 4 * CHUNK or len(rows) >= 1024:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), CHUNKS, strict=True)], CHUNKS.names)

    schema = "record_id string, record_type string, refers_to string, declared_digest string, declared_bytes bigint, chunk int, `offset` bigint, data binary, sha1 string, last boolean"
    # by ranges of names with a stated number of them: hashes would put several files into one task, and adaptive execution
    # would put all these tiny rows together
    return manifest.select("path").repartitionByRange(max(1, manifest.count()), "path").mapInArrow(run, schema)


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of ``record_id``, ``uri``, ``digest``, ``payload`` (binary) and ``refers_to`` as chunk rows, in order."""
    stored = F.when(F.col("refers_to").isNull(), F.length("payload")).otherwise(0)
    n = F.greatest(F.ceil(stored / chunk).cast("int"), F.lit(1))
    rows = records.withColumns({"bytes": F.length("payload").cast("long"), "_stored": stored, "_n": n}).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    data = F.when(F.col("_stored") > 0, F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    return rows.select("record_id", "uri", "digest", "bytes", "refers_to", "chunk", (F.col("chunk") == F.col("_n") - 1).alias("last"), data.alias("data"))


def archive(pages: DataFrame, key: str = "page_id", min_revisit: int = MIN_REVISIT, limit: int = FILE) -> DataFrame:
    """Writes a record per row of ``key``, ``url``, ``html`` and returns the written manifest."""
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("_key"), F.col("url").alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("_same", F.when(F.length("payload") >= min_revisit, F.sha2("payload", 256)))
    # only payloads that several rows share need the lookup; a hot one is one row of this table
    shared = rows.where("_same is not null").groupBy("_same").agg(F.max("_key").alias("_response"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    rows = rows.join(shared, "_same", "left")
    records = rows.select(F.col("_key").cast("string").alias("record_id"), "uri", "digest", "payload", F.when(F.col("_response") != F.col("_key"), F.col("_response").cast("string")).alias("refers_to"))
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return materialise(write_archives(chunked(records), folder, limit))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    last = read_archives(archive(pages)).where("last")
    stored = F.col("record_type") == "response"
    return last.select(
        F.col("record_id").try_cast(kind).alias("page_id"),
        F.when(stored, F.col("offset") + F.length("data")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.when(stored, F.col("sha1")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").try_cast(kind).alias("refers_to"),
    )


QUERIES = {"op9_warc": op9_warc}
ORACLES: dict[str, str] = {
    "op9_warc": """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), s AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS top FROM p
)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM s
"""
}
