"""Operator 10: WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of some whole WARC records; a skippable frame that maps record
identifiers to (frame, offset in it, length); and the seek table of the Zstandard seekable format. One record is read by
its frame alone, and any Zstandard decoder reads the whole bundle.

Bundles are written under temporary names and renamed. Each attempt of a task names its bundles apart and returns the
names of all it wrote, and the attempt whose names are kept is whole by itself: bundles of another one are never listed.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.common import prepare
from sylva.session import cut, fresh_folder, remove

#: A frame closes at so many bytes of records, a bundle at so many bytes of frames.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 26
#: Payloads below so many bytes are always written in full.
LEAST_REVISIT = 100
SEEK_FRAME, SEEK_MAGIC, INDEX_FRAME = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


# ---- records


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with its HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    block = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k: v for k, _, v in (line.partition(": ") for line in raw.decode().split("\r\n")[1:])}


def decode_record(raw: bytes) -> dict:
    """The fields of one record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    of = _headers(head)
    block = rest[: int(of["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_headers(http)["Content-Length"]), of["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda s: None if s is None or s == "<urn:page:null>" else int(s[len("<urn:page:") : -1])
    if of["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload of {of['WARC-Record-ID']}")
    return {"page_id": page(of["WARC-Record-ID"]), "url": of.get("WARC-Target-URI"), "payload": payload if of["WARC-Type"] == "response" else None, "payload_bytes": size, "payload_digest": digest, "record_type": of["WARC-Type"], "refers_to": page(of.get("WARC-Refers-To"))}


# ---- bundles


class BundleWriter:
    """Appends records to one bundle file."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES):
        self.fs, self.path = _filesystem(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.frame_bytes, self.written, self.records = frame_bytes, 0, 0
        self.held: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        self.index.append((name, len(self.table), self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        self.records += 1
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            made = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(b"".join(self.held))
            self.out.write(made)
            self.table.append((len(made), self.size))
            self.written += len(made)
            self.held, self.size = [], 0

    def close(self) -> None:
        """Write the index and the seek table, and give the bundle its name."""
        self._frame()
        index = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index).encode())
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        frames = [*self.table, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *x) for x in frames)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + 9) + table + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)


class BundleReader:
    """Reads a bundle by its footer: all records in order, or one by its identifier."""

    def __init__(self, path: str):
        self.fs, self.path = _filesystem(path)
        self.file = self.fs.open_input_file(self.path)
        end = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"no seek table in {path}")
        table = self.file.read_at(8 * n, end - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, size))
            at += packed
        start, packed, _ = self.frames.pop()
        self.index = [tuple(x) for x in json.loads(zstandard.ZstdDecompressor().decompress(self.file.read_at(packed - 8, start + 8)))]

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=size)

    def record(self, name: str) -> bytes:
        """The first record of that identifier."""
        k, offset, length = next(x[1:] for x in self.index if x[0] == name)
        return self.frame(k)[offset : offset + length]

    def __iter__(self) -> Iterator[bytes]:
        held, raw = -1, b""
        for _, k, offset, length in self.index:
            if k != held:
                held, raw = k, self.frame(k)
            yield raw[offset : offset + length]

    def close(self) -> None:
        self.file.close()


# ---- the operator


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: the smallest page_id among equal payloads of at least LEAST_REVISIT bytes.

    Only digests meet by payload; the payloads themselves are shuffled once, by page, so no group of copies gathers.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    slim = known.where((F.octet_length("payload") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    copies = slim.join(first, "digest").where("page_id <> refers_to").distinct()
    return known.join(copies, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_bundles(pages: DataFrame, folder: str, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the pages (page_id, url, html, ...) and return the bundles: path, records, frames, bytes.

    Null html is an empty payload, a null url leaves out the target; a null page_id is always a response; rows that
    repeat the smallest page_id of their payload are responses too, and others that share an id are records of one
    identifier, of which a bundle's index gives the first. A payload longer than a frame is a frame of its own. An empty
    table writes nothing; other columns are not read.
    """
    spark = pages.sparkSession
    prepare(spark)
    files, local = _filesystem(folder)
    files.create_dir(local, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, attempt = TaskContext.get().partitionId(), 0, None, uuid.uuid4().hex[:12]
        made: list[tuple[str, int, int, int]] = []

        def close():
            nonlocal out, number
            if out is not None:
                out.close()
                made.append((path, out.records, len(out.table), out.written))
                out, number = None, number + 1

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    path = f"{folder}/bundle-{part:06d}-{attempt}-{number:04d}.warc.zst"
                    out = BundleWriter(path, frame_bytes)
                out.add(record_id(r["page_id"]), encode_record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                if out.written >= bundle_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["path", "records", "frames", "bytes"])

    return cut(with_revisits(pages).mapInArrow(run, "path string, records long, frames long, bytes long"))


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the bundles (path, ...), each read by its seek table and held against its digest."""
    spark = bundles.sparkSession
    prepare(spark)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    if not payloads:
        del kinds["payload"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                bundle, rows, held = BundleReader(path), [], 0
                pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))  # noqa: B023, E731
                for raw in bundle:
                    rows.append(decode_record(raw))
                    held += len(raw)
                    if held > 1 << 24:
                        yield pack()
                        rows, held = [], 0
                yield pack()
                bundle.close()

    schema = ", ".join(f"{k} {'long' if t == pa.int64() else 'binary' if t == pa.binary() else 'string'}" for k, t in kinds.items())
    return bundles.select("path").mapInArrow(run, schema)


def find_record(bundles: DataFrame, page_id: int) -> bytes | None:
    """The record of one page: the bundles' indexes are searched in parallel, and one frame is read."""
    prepare(bundles.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                bundle = BundleReader(path)
                if any(x[0] == record_id(page_id) for x in bundle.index):
                    found.append(bundle.record(record_id(page_id)))
                bundle.close()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["record"])

    row = bundles.select("path").mapInArrow(run, "record binary").first()
    return bytes(row.record) if row else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "warc")
    bundles = write_bundles(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    got = cut(read_bundles(bundles, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    remove(spark, folder)
    return got


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM f
"""
