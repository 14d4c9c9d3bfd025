"""Operator 6: token counts by prefix dynamic programming.

The programme finds the exact token count of every prefix of a text in one pass (bpe.Codec.prefix_piece) and keeps them, as
the step from each prefix to the next. Questions of truncation and budget are answered from the kept steps alone: whether a
text is over a limit, the longest prefix within a budget, the count of any prefix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm.bpe import codec
from sylva.llm.common import map_batches, prepare, texts_of

LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long, steps binary"


def counts_of(steps: bytes) -> np.ndarray:
    """The token counts of the prefixes of 1, 2, ... code points."""
    return np.frombuffer(steps, np.int8).cumsum(dtype=np.int64)


def longest_prefix(steps: bytes, budget: int) -> int:
    """The most code points whose prefix, encoded alone, needs at most `budget` tokens (counts may fall back)."""
    fits = np.flatnonzero(counts_of(steps) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits, steps for each row of docs (doc_id, text, ...).

    steps holds a signed byte for each code point, whose running sum is the exact token count of the prefix that ends
    there; the other token columns are read off it. fits counts the code points of the longest prefix of at most `limit`
    tokens. Null text counts as empty: 0 bytes, 0 tokens, no steps. Repeated rows and null ids each give their own row; an
    empty table gives no rows; other columns are not read. Texts of any length are read whole, in time that grows with
    their length however they are made up.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, texts = codec(vocabulary), texts_of(batch)
        steps = [of.prefix_steps(t) for t in texts]
        n = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
        fits = [len(s) if x <= limit else longest_prefix(s, limit) for s, x in zip(steps, n, strict=True)]
        arrays = [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fits, pa.int64()), pa.array(steps, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in SCHEMA.split(", ")])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCHEMA)


def within(counted: DataFrame, budget: int) -> DataFrame:
    """doc_id, fits for another budget, from the kept steps of count_tokens()."""
    prepare(counted.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([longest_prefix(s or b"", budget) for s in batch.column("steps").to_pylist()], pa.int64())], ["doc_id", "fits"])

    return map_batches(counted.select("doc_id", "steps"), run, "doc_id long, fits long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
