"""Binary formats of vector tables, cluster layers and tokenizers: pure encoders, and Spark data sources over them.

Canonical storage is Parquet; these serve exchange. All numbers are little-endian.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sylva.operators.bpe import Tokenizer
from sylva.session import ship

# Magic strings and type bytes of the formats.
VECTOR_MAGIC, LAYER_MAGIC, TOKENIZER_MAGIC = b"VEC\0", b"SPLIT_SET", b"BPE"
BINARY, DOUBLE = 0, 1


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def files(uri: str, suffix: str) -> list[str]:
    """The files of a folder with a suffix, in order of name, or the file itself."""
    where, path = filesystem(uri)
    info = where.get_file_info(path)
    if info.type == fs.FileType.File:
        return [path]
    found = where.get_file_info(fs.FileSelector(path, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(suffix))


# ---- vector tables


def pack_bits(positions: list[int], n: int) -> bytes:
    """Set positions as n // 8 + 1 bytes, lowest bit first."""
    out = np.zeros(8 * (n // 8 + 1), np.uint8)
    out[positions] = 1
    return np.packbits(out, bitorder="little").tobytes()


def unpack_bits(raw: bytes, n: int) -> list[int]:
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[:n]).tolist()


def encode_vectors(rows: list[tuple[str, list]], binary: bool = False, length: int | None = None) -> bytes:
    """A vector table of (text, vector); a binary vector is its set positions, of the stated length."""
    n = length if length is not None else max((len(v) for _, v in rows), default=0)
    out = io.BytesIO()
    out.write(VECTOR_MAGIC + struct.pack("<BQQ", BINARY if binary else DOUBLE, len(rows), n))
    for _, v in rows:
        out.write(pack_bits(v, n) if binary else np.asarray(v, "<f8").tobytes())
    for text, _ in rows:
        raw = (text or "").encode("utf-8", "replace")
        out.write(struct.pack("<Q", len(raw)) + raw)
    return out.getvalue()


def vector_header(f) -> tuple[bool, int, int]:
    """Whether it is binary, the number of rows, the vector length. Another magic is read all the same."""
    kind, n, length = struct.unpack("<4xBQQ", f.read_at(21, 0))
    return kind == BINARY, n, length


def read_vectors(f, first: int, last: int, text_at: int) -> Iterator[tuple[int, str, list]]:
    """(row_id, text, vector) of some rows, whose texts begin at text_at."""
    binary, n, length = vector_header(f)
    width = length // 8 + 1 if binary else 8 * length
    raw = f.read_at(width * (last - first), 21 + width * first)
    at = text_at
    for k in range(first, last):
        (size,) = struct.unpack("<Q", f.read_at(8, at))
        text = f.read_at(size, at + 8).decode("utf-8", "replace")
        at += 8 + size
        own = raw[width * (k - first) : width * (k - first + 1)]
        yield k, text, unpack_bits(own, length) if binary else np.frombuffer(own, "<f8").tolist()


def text_offsets(f, every: int, block: int = 1 << 20) -> list[tuple[int, int]]:
    """(row, offset of its text) for every so many rows, by the lengths alone, read in blocks."""
    binary, n, length = vector_header(f)
    at, out, held, start = 21 + (length // 8 + 1 if binary else 8 * length) * n, [], b"", 0
    for k in range(n):
        if k % every == 0:
            out.append((k, at))
        if not start <= at <= start + len(held) - 8:
            held, start = f.read_at(block, at), at
        at += 8 + struct.unpack_from("<Q", held, at - start)[0]
    return out


def vector_bytes(vectors: pa.Array, binary: bool, length: int) -> bytes:
    """A column of vectors, or of set positions, as the format holds it."""
    if binary:
        return b"".join(pack_bits(v, length) for v in vectors.to_pylist())
    flat = np.asarray(vectors.flatten(), "<f8")
    if len(flat) != length * len(vectors):
        raise ValueError("vectors of different lengths")
    return flat.tobytes()


def text_bytes(texts: pa.Array) -> bytes:
    raw = [(t or "").encode("utf-8", "replace") for t in texts.to_pylist()]
    return b"".join(struct.pack("<Q", len(r)) + r for r in raw)


# ---- cluster layers


def encode_layer(clusters: list[list[int]]) -> bytes:
    """Clusters as lists of row ids; the id of each is its position."""
    out = [LAYER_MAGIC, struct.pack("<i", len(clusters))]
    for k, members in enumerate(clusters):
        out.append(struct.pack("<ii", len(members), k) + np.asarray(members, "<i4").tobytes())
    return b"".join(out)


def decode_layer(raw: bytes) -> list[tuple[int, list[int]]]:
    """(id, members) of each cluster; another magic, or bytes left over or missing, is an error."""
    if not raw.startswith(LAYER_MAGIC):
        raise ValueError("not a cluster layer")
    at, out = len(LAYER_MAGIC) + 4, []
    (n,) = struct.unpack_from("<i", raw, len(LAYER_MAGIC))
    for _ in range(n):
        size, name = struct.unpack_from("<ii", raw, at)
        out.append((name, np.frombuffer(raw, "<i4", size, at + 8).tolist()))
        at += 8 + 4 * size
    if at != len(raw):
        raise ValueError("a cluster layer of another length than it states")
    return out


# ---- tokenizers


def encode_tokenizer(t: Tokenizer) -> bytes:
    out = [TOKENIZER_MAGIC, struct.pack("<Q", len(t.alphabet)), t.alphabet, struct.pack("<Q", len(t.tokens))]
    out += [struct.pack("<Q", len(x)) + x for x in t.tokens]
    out += [struct.pack("<Q", len(t.rules)), *[struct.pack("<QQQ", *r) for r in t.rules]]
    return b"".join(out)


def decode_tokenizer(raw: bytes) -> Tokenizer:
    if not raw.startswith(TOKENIZER_MAGIC):
        raise ValueError("not a tokenizer")
    at = len(TOKENIZER_MAGIC)

    def number() -> int:
        nonlocal at
        at += 8
        return struct.unpack_from("<Q", raw, at - 8)[0]

    def some(n: int) -> bytes:
        nonlocal at
        at += n
        return raw[at - n : at]

    alphabet = some(number())
    tokens = [some(number()) for _ in range(number())]
    return Tokenizer(alphabet, tokens, [(number(), number(), number()) for _ in range(number())])


def write_bytes(uri: str, raw: bytes) -> None:
    where, path = filesystem(uri)
    with where.open_output_stream(path) as f:
        f.write(raw)


def read_bytes(uri: str) -> bytes:
    where, path = filesystem(uri)
    with where.open_input_stream(path) as f:
        return f.read()


def save_tokenizer(t: Tokenizer, uri: str) -> None:
    write_bytes(uri, encode_tokenizer(t))


def load_tokenizer(uri: str) -> Tokenizer:
    return decode_tokenizer(read_bytes(uri))


def tokenizer_tables(spark: SparkSession, t: Tokenizer) -> tuple[DataFrame, DataFrame]:
    """tokens(id, token) and rules(rule_no, left, right, merged)."""
    tokens = spark.createDataFrame(list(enumerate(map(bytearray, t.tokens))), "id int, token binary")
    return tokens, spark.createDataFrame([(k, *r) for k, r in enumerate(t.rules)], "rule_no int, left int, right int, merged int")


# ---- data sources


class _Part(InputPartition):
    def __init__(self, uri: str, path: str, first: int = 0, last: int = 0, at: int = 0):
        self.uri, self.path, self.first, self.last, self.at = uri, path, first, last, at


class VectorReader(DataSourceReader):
    """Row ranges of each file in parallel; row_id counts from 0 within a file."""

    def __init__(self, options):
        self.uri, self.rows = options["path"], int(options.get("rowsPerPartition", 100_000))
        self.binary = options.get("type", "double") == "binary"

    def partitions(self):
        where, _ = filesystem(self.uri)
        out = []
        for path in files(self.uri, ".vdb"):
            with where.open_input_file(path) as f:
                n, marks = vector_header(f)[1], text_offsets(f, self.rows)
            out += [_Part(self.uri, path, k, min(n, k + self.rows), at) for k, at in marks]
        return out

    def read(self, partition):
        where, _ = filesystem(partition.uri)
        kind = pa.list_(pa.int32()) if self.binary else pa.list_(pa.float64())
        with where.open_input_file(partition.path) as f:
            held: list[tuple] = []
            for row in read_vectors(f, partition.first, partition.last, partition.at):
                held.append(row)
                if len(held) == 1024:
                    yield self._batch(held, kind)
                    held = []
            if held:
                yield self._batch(held, kind)

    def _batch(self, rows, kind):
        a, b, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, kind)], ["row_id", "text", "bits" if self.binary else "vector"])


class _Done(WriterCommitMessage):
    pass


class VectorWriter(DataSourceArrowWriter):
    """One file for each task, part-<task>.vdb; repartition to one for a single file. Rows go by row_id.

    The format puts all vectors before all texts, so a task holds its rows, as Arrow data.
    """

    def __init__(self, options):
        self.uri, self.binary = options["path"], options.get("type", "double") == "binary"
        self.length = int(options["length"]) if "length" in options else None

    def write(self, iterator):
        from pyspark import TaskContext

        batches = list(iterator)
        rows = pa.Table.from_batches(batches).sort_by("row_id") if batches else pa.table({"row_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "bits" if self.binary else "vector": pa.array([], pa.list_(pa.float64()))})
        vectors = rows.column("bits" if self.binary else "vector")
        length = self.length
        if length is None and self.binary:
            length = 1 + max((int(np.max(np.asarray(c.flatten()), initial=-1)) for c in vectors.chunks), default=-1)
        elif length is None:
            length = len(vectors[0]) if len(rows) else 0
        where, path = filesystem(self.uri)
        where.create_dir(path, recursive=True)
        with where.open_output_stream(f"{path}/part-{TaskContext.get().partitionId():05d}.vdb") as f:
            f.write(VECTOR_MAGIC + struct.pack("<BQQ", BINARY if self.binary else DOUBLE, len(rows), length))
            for chunk in vectors.chunks:
                f.write(vector_bytes(chunk, self.binary, length))
            for chunk in rows.column("text").chunks:
                f.write(text_bytes(chunk))
        return _Done()


class VectorSource(DataSource):
    """format("vdb"): row_id, text, and vector (type double) or bits (type binary, with the option length to write)."""

    @classmethod
    def name(cls):
        return "vdb"

    def schema(self):
        return "row_id long, text string, bits array<int>" if self.options.get("type") == "binary" else "row_id long, text string, vector array<double>"

    def reader(self, schema):
        return VectorReader(self.options)

    def writer(self, schema, overwrite):
        return VectorWriter(self.options)


class LayerReader(DataSourceReader):
    def __init__(self, options):
        self.uri = options["path"]

    def partitions(self):
        return [_Part(self.uri, p, k) for k, p in enumerate(files(self.uri, ""))]

    def read(self, partition):
        where, _ = filesystem(partition.uri)
        with where.open_input_stream(partition.path) as f:
            clusters = decode_layer(f.read())
        number = re.search(r"(\d+)$", partition.path)
        layer = int(number[1]) if number else partition.first
        for k, (_, members) in enumerate(clusters):
            for pos, row in enumerate(members):
                yield layer, k, row, pos


class LayerSource(DataSource):
    """format("splitset"): layer (the number at the end of a file's name), cluster, row_id, pos."""

    @classmethod
    def name(cls):
        return "splitset"

    def schema(self):
        return "layer int, cluster int, row_id long, pos int"

    def reader(self, schema):
        return LayerReader(self.options)


class TokenizerReader(LayerReader):
    def read(self, partition):
        where, _ = filesystem(partition.uri)
        with where.open_input_stream(partition.path) as f:
            t = decode_tokenizer(f.read())
        made = {c: (a, b) for a, b, c in t.rules}
        for k, token in enumerate(t.tokens):
            yield k, token, *(made.get(k) or (None, None))


class TokenizerSource(DataSource):
    """format("bpe"): id, token, and the ids it was merged from."""

    @classmethod
    def name(cls):
        return "bpe"

    def schema(self):
        return "id int, token binary, left int, right int"

    def reader(self, schema):
        return TokenizerReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    ship(spark)
    for source in (VectorSource, LayerSource, TokenizerSource):
        spark.dataSource.register(source)


# ---- one file for each layer or cluster


def _write_files(rows: DataFrame, by: list[str], order: list[str], name, emit) -> None:
    """One file for each key, in which the key's rows stand in order; they stream through a task and are never held whole.

    `name` makes a path of the key's values; `emit(state, batch)` gives the bytes of some rows, with a dict to keep from
    one call to the next, empty at a file's beginning. A file gets its name once it is whole, so a task may run again.
    """

    def run(batches):
        made, now, out, state = [], None, None, {}

        def close():
            if out is not None:
                out.close()
                where.move(part, path)
                made.append(name(*now))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]] + [len(keys)]
            for at, end in zip([0, *ends], ends, strict=False):
                if keys and keys[at] != now:
                    close()
                    now, state = keys[at], {}
                    where, path = filesystem(name(*now))
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    out = where.open_output_stream(part)
                if keys:
                    out.write(emit(state, batch.slice(at, end - at)))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["path"])

    ship(rows.sparkSession)
    # a repartition by the columns of a join before it would be dropped, and a large key of that join be split
    rows.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order).mapInArrow(run, "path string").collect()


def write_layers(members: DataFrame, prefix: str) -> None:
    """One binary file for each layer, <prefix>0000 and so on, clusters by number and members by row_id.

    A number without members is an empty cluster.
    """
    sizes = members.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("size"))
    most = members.groupBy("layer").agg((F.max("cluster") + 1).alias("clusters"))

    def emit(state: dict, batch: pa.RecordBatch) -> bytes:
        cluster, size, row = (np.array(batch.column(c)) for c in ("cluster", "size", "row_id"))
        out = [] if state else [LAYER_MAGIC, struct.pack("<i", batch.column("clusters")[0].as_py())]
        starts = np.flatnonzero(np.append(True, cluster[1:] != cluster[:-1]))
        for at, end in zip(starts, [*starts[1:], len(cluster)], strict=True):
            before = state.get("cluster", -1)
            if cluster[at] != before:
                out += [struct.pack("<ii", 0, k) for k in range(before + 1, cluster[at])] + [struct.pack("<ii", size[at], cluster[at])]
                state["cluster"] = int(cluster[at])
            out.append(row[at:end].astype("<i4").tobytes())
        return b"".join(out)

    rows = members.select("layer", "cluster", "row_id").join(sizes, ["layer", "cluster"]).join(most, "layer")
    _write_files(rows, ["layer"], ["cluster", "row_id"], lambda layer: f"{prefix}{layer:04d}", emit)


def write_cluster_files(members: DataFrame, prefix: str) -> None:
    """The row ids of each cluster, one a line, in a file <prefix>L0000-C-000000 by layer and cluster."""
    emit = lambda state, batch: "".join(f"{r}\n" for r in batch.column("row_id").to_pylist()).encode()
    _write_files(members.select("layer", "cluster", "row_id"), ["layer", "cluster"], ["row_id"], lambda layer, cluster: f"{prefix}L{layer:04d}-C-{cluster:06d}", emit)


def write_cluster_vectors(members: DataFrame, rows: DataFrame, prefix: str) -> None:
    """The rows (row_id, text, vector) of each cluster as a vector table of its own, named as the row ids' files are, with .vdb.

    Each row comes twice, first for its vector and then for its text, as the format wants them, so that no cluster is held.
    """
    own = members.select("layer", "cluster", "row_id").join(rows.select("row_id", "text", "vector"), "row_id")
    facts = own.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("length"))
    both = own.join(facts, ["layer", "cluster"]).withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    slim = both.select("layer", "cluster", "row_id", "n", "length", "part", F.when(F.col("part") == 1, F.col("text")).alias("text"), F.when(F.col("part") == 0, F.col("vector")).alias("vector"))

    def emit(state: dict, batch: pa.RecordBatch) -> bytes:
        n, length = batch.column("n")[0].as_py(), batch.column("length")[0].as_py()
        out = b"" if state else VECTOR_MAGIC + struct.pack("<BQQ", DOUBLE, n, length)
        state["open"] = True
        texts = int(np.searchsorted(np.array(batch.column("part")), 1))
        return out + vector_bytes(batch.column("vector").slice(0, texts), False, length) + text_bytes(batch.column("text").slice(texts))

    _write_files(slim, ["layer", "cluster"], ["part", "row_id"], lambda layer, cluster: f"{prefix}L{layer:04d}-C-{cluster:06d}.vdb", emit)
