"""WARC archives: write, normalise monolithic gzip, read back by a sidecar index.

``write_archives`` writes one whole-file gzip stream per slice of a partition.  ``normalise`` inflates each such stream
once, rewrites every record as a gzip member of its own, and writes a sidecar index of member offsets beside it.
``read_index`` reads the sidecars and ``read_members`` opens members by them.  Files are written under a temporary name and moved, so a task that is run
again or twice leaves the same file.

Scale: an archive holds about ``ARCHIVE_BYTES`` of payload and is streamed, so memory does not grow with it; reading splits
an archive at every ``READ_BYTES``.
Duplicate payloads are found on digests; only digests seen more than once are joined back (Spark broadcasts them only if
their size is known to be small, and splits a hot digest otherwise).

Defined results: a null payload is empty; a null URL gives a record without target; of rows with equal payloads those
with the largest id are responses, rows with a null id never are unless all ids are null; repeated rows that are responses
are all written in full, under one record id; empty tables write nothing; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import as_bytes, scratch_path, stored

#: Payload bytes of an archive before the next one is begun.
ARCHIVE_BYTES = 512 << 20
#: Bytes of an archive that one task reads.
READ_BYTES = 64 << 20
LEVEL = 3
INFLATE_STEP = 1 << 20
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = b"2024-01-01T00:00:00Z"

FILES = "archive string, records long"
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("file://" + uri.removeprefix("file:").removeprefix("//") if uri.startswith("file:") else uri)


def sha1_base32(payload: bytes) -> bytes:
    return base64.b32encode(hashlib.sha1(payload).digest())


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``refers_to``: the largest id with an equal payload, for rows that are not it; null for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    again = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(stored(again.select("digest", "top"), "payloads"), "digest", "left")
    other = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(other, F.col("top")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record that names the record it repeats."""
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(), b"WARC-Date: " + DATE]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]").encode())
    head.append(b"WARC-Payload-Digest: sha1:" + digest)
    if refers_to is not None:
        head += [b"WARC-Profile: " + PROFILE, b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers_of(head: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(headers, whole record) of each record in a stream of inflated bytes; holds one record and one chunk at most."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while (end := held.find(b"\r\n\r\n")) >= 0:
            head = headers_of(bytes(held[:end]))
            size = end + 4 + int(head[b"content-length"]) + 4
            if len(held) < size:
                break
            yield head, bytes(held[:size])
            del held[:size]
    if held.strip():
        raise ValueError("an archive ends within a record")


def inflated(stream) -> Iterator[bytes]:
    """Inflate a gzip file of one or many members, a step at a time."""
    z, held = zlib.decompressobj(31), b""
    while held or (held := stream.read(INFLATE_STEP)):
        yield z.decompress(held, INFLATE_STEP)
        held = z.unconsumed_tail
        if z.eof:
            held, z = z.unused_data, zlib.decompressobj(31)
    yield z.flush()


class _Archive:
    """A file under a temporary name that ``close`` moves to its place."""

    def __init__(self, uri: str):
        self.uri = uri
        self.fs, self.path = file_system(uri)
        self.tmp = f"{self.path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)


def _writer(folder: str, archive_bytes: int):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64())])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, file, z, size, n = TaskContext.get().partitionId(), [], None, None, 0, 0

        def close() -> None:
            file.write(z.flush())
            file.close()
            made.append((file.uri, n))

        for b in it:
            for page_id, url, payload, refers_to in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
                if file is None:
                    file, z, size, n = _Archive(f"{folder}/part-{part:06d}-{len(made):06d}.warc.gz"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0
                file.write(z.compress(record(page_id, url, payload, refers_to)))
                size, n = size + len(payload), n + 1
                if size >= archive_bytes:
                    close()
                    file = None
        if file is not None:
            close()
        yield pa.RecordBatch.from_pylist([{"archive": a, "records": k} for a, k in made], schema=schema)

    return write


def _mkdir(folder: str) -> None:
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic gzip archives of ``with_roles`` rows; one row per file written."""
    _mkdir(folder)
    return stored(pages.mapInArrow(_writer(folder, archive_bytes), FILES), "archives")


def _normaliser(folder: str):
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for uri in b.column(0).to_pylist():
                out = _Archive(f"{folder}/{uri.rsplit('/', 1)[-1]}")
                index = []
                fs, path = file_system(uri)
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, whole in records_of(inflated(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        index.append((out.uri, out.at, len(member), head[b"warc-record-id"].decode(), head[b"warc-type"].decode()))
                        out.write(member)
                out.close()
                side = _Archive(out.uri + ".idx")
                side.write("".join(f"{o}\t{n}\t{i}\t{t}\n" for _, o, n, i, t in index).encode())
                side.close()
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), schema.types)], schema=schema)

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite each monolithic archive with one gzip member per record; returns the rows of the sidecar indexes."""
    _mkdir(folder)
    return stored(archives.select("archive").distinct().mapInArrow(_normaliser(folder), INDEX), "warc-index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The sidecar indexes of a folder of normalised archives, as ``normalise`` returned them."""
    lines = spark.read.schema("offset long, length long, record_id string, record_type string").csv(f"{folder}/*.idx", sep="\t", quote="")
    return lines.select(F.regexp_replace(F.col("_metadata.file_path"), r"\.idx$", "").alias("archive"), *lines.columns)


def parsed(whole: bytes) -> tuple[int | None, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; a response's digest is checked."""
    end = whole.index(b"\r\n\r\n")
    head = headers_of(whole[:end])
    block = whole[end + 4 : end + 4 + int(head[b"content-length"])]
    http_end = block.index(b"\r\n\r\n")
    size = int(headers_of(block[:http_end])[b"content-length"])
    kind, digest = head[b"warc-type"].decode(), head[b"warc-payload-digest"].removeprefix(b"sha1:")
    payload = block[http_end + 4 :] if kind == "response" else None
    if payload is not None and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {head[b'warc-record-id']!r} does not match its digest")
    page = head[b"warc-record-id"].removeprefix(b"<urn:page:").removesuffix(b">")
    refers = head.get(b"warc-refers-to", b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return (None if page == b"None" else int(page), size, digest.decode(), kind, int(refers) if refers else None, payload)


def _reader(with_payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        try:
            for b in it:
                rows = []
                for uri, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if uri != opened:
                        if stream is not None:
                            stream.close()
                        fs, path = file_system(uri)
                        opened, stream = uri, fs.open_input_file(path)
                    row = parsed(zlib.decompress(stream.read_at(length, offset), 31))
                    rows.append(row if with_payload else (*row[:5], None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        finally:
            if stream is not None:
                stream.close()

    return run


def read_members(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records opened one by one at the offsets of the index."""
    return index.select("archive", "offset", "length").mapInArrow(_reader(with_payload), RECORDS)


def warc_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write pages to monolithic archives, normalise them, and read every record back by the index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    archives = write_archives(with_roles(pages, min_bytes), f"{folder}/monolithic")
    n = archives.count()
    if not n:
        return pages.sparkSession.createDataFrame([], RECORDS)
    members = normalise(archives.repartition(n, "archive"), f"{folder}/members")
    parts = members.agg(F.sum("length")).first()[0] // READ_BYTES + n
    index = read_index(pages.sparkSession, f"{folder}/members")
    dealt = index.repartition(int(parts), "archive", F.floor(F.col("offset") / READ_BYTES)).sortWithinPartitions("archive", "offset")
    return read_members(dealt, with_payload)
