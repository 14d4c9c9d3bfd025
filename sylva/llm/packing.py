"""Operator 3: packing along a space-filling curve.

Each document becomes a vector of hashed byte trigrams, projected to four dimensions; its place on the Hilbert curve of
that cube is its key. Range partitions in key order hold neighbouring documents, and each partition cuts its stream of
tokens into sequences, so a sequence mixes like with like. Nothing but a partition's last, short sequence needs padding,
and that one is cut at powers of two instead.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import ngrams as ng
from sylva.llm.bpe import codec
from sylva.llm.common import map_batches, partitions_for, prepare, texts_of

LENGTH = 1024
DIMENSIONS, SIDE_BITS, SALT_BITS = 4, 12, 15
VECTOR_BITS = 9
#: Keys sampled for the range bounds: about so many, and so many for each partition.
SAMPLED, SAMPLED_EACH = 20_000, 40
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def project(text: str) -> np.ndarray:
    """The hashed trigram shares of a text, projected to few dimensions inside (0, 1)."""
    raw = ng.as_bytes(text)
    counts = np.bincount(ng.ngrams(raw, 3, VECTOR_BITS), minlength=1 << VECTOR_BITS)
    x = counts @ _axes() / max(1, counts.sum())
    return 0.5 + 0.5 * x / (1 + np.abs(x))


_held: list[np.ndarray] = []


def _axes() -> np.ndarray:
    if not _held:
        axes = np.random.default_rng(17).normal(size=(1 << VECTOR_BITS, DIMENSIONS))
        _held.append(8 * (axes - axes.mean(0)))
    return _held[0]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The distance along the Hilbert curve of integer points (n, d) with `bits` bits a side: transpose form, then interleaved."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's turns from the largest cube to the smallest
        low = q - 1
        for i in range(d):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(set_, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[d - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def keys(texts: list[str], salts: np.ndarray) -> np.ndarray:
    """Curve keys; the salt below splits documents of one key, of which there may be very many."""
    if not texts:
        return np.zeros(0, np.int64)
    cells = np.clip(np.stack([project(t) for t in texts]) * (1 << SIDE_BITS), 0, (1 << SIDE_BITS) - 1)
    return (hilbert(cells.astype(np.int64), SIDE_BITS) << SALT_BITS) | (salts & ((1 << SALT_BITS) - 1))


def _keyed(docs: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys(texts_of(batch), batch.column("salt").to_numpy()), pa.int64())], ["key"])

    return map_batches(docs, run, "key long")


def by_curve(docs: DataFrame, partitions: int, n: int) -> DataFrame:
    """Columns key, part and those of the n docs (with `salt`); part counts the range of the key, with bounds from a sample of all rows."""
    size = max(SAMPLED, SAMPLED_EACH * partitions)
    sample = docs.sample(False, size / n, 23) if n > size else docs
    wanted = [k / partitions for k in range(1, partitions)]
    bounds = np.unique(np.array(_keyed(sample).approxQuantile("key", wanted, min(0.0005, 0.1 / partitions)) if n and wanted else [], np.int64))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = keys(texts_of(batch), batch.column("salt").to_numpy())
        part = np.searchsorted(bounds, key, side="right").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(part), *batch.columns], ["key", "part", *names])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return map_batches(docs, run, f"key long, part int, {fields}")


def cut_tail(pieces: list[tuple[int, int, bytes, int]], first: int) -> Iterator[tuple[int, int, bytes, int, int, int]]:
    """Deal the pieces (doc, start, ids, doc_tokens) of a short last sequence into sequences of powers of two, longest first."""
    left = sum(len(p[2]) // 4 for p in pieces)
    room, offset, seq = (1 << left.bit_length() >> 1), 0, first
    for doc, start, ids, total in pieces:
        while ids:
            take = min(len(ids) // 4, room - offset)
            yield doc, start, ids[: 4 * take], total, seq, offset
            ids, start, offset = ids[4 * take :], start + take, offset + take
            if offset == room:
                left -= room
                room, offset, seq = (1 << left.bit_length() >> 1), 0, seq + 1


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str = "byte_bpe_50k.json", partitions: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 0. Null text counts as empty (one id); repeated rows are documents of their own;
    null ids stay null; an empty table gives no rows; other columns are not read. A document longer than a sequence is
    cut over as many as it needs, and documents of one key stand by id, length and hash of the text. `length` is a power
    of two. Sequence ids are unique, with gaps between partitions. There are as many partitions as the texts' bytes ask
    for; documents of one place on the curve are dealt by the hash of id and text, so neither copies nor null or repeated
    ids gather in one.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << SALT_BITS)).alias("salt"))
    n, size = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = partitions or partitions_for(spark, size)
    dealt = by_curve(slim, parts, n).repartitionById(parts, F.col("part")).sortWithinPartitions("key", "doc_id", F.length("text"), F.xxhash64("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seq, held = codec(vocabulary), TaskContext.get().partitionId() << 40, 0
        tail: list[tuple[int, int, bytes, int]] = []
        columns: list[list] = [[] for _ in range(7)]

        def put(doc, start, ids, total, sequence, offset):
            for c, v in zip(columns, (doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset), strict=True):
                c.append(v)

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in SCHEMA.split(", ")])
            for c in columns:
                c.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                ids = of.ids(text) + b"\0\0\0\0"
                total, start = len(ids) // 4, 0
                while start < total:
                    take = min(total - start, length - held)
                    piece = (doc, start, ids[4 * start : 4 * (start + take)], total)
                    start, held = start + take, held + take
                    tail.append(piece)
                    if held == length:
                        offset = 0
                        for p in tail:
                            put(*p, seq, offset)
                            offset += len(p[2]) // 4
                        tail.clear()
                        seq, held = seq + 1, 0
            yield full()
        for p in cut_tail(tail, seq):
            put(*p)
        yield full()

    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
