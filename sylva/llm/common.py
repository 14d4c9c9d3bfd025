"""What the operators share: memoised per-word work, Arrow batch bounds, row normalisation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sylva.session import give_back, ship

#: Rows and bytes of an Arrow batch: some texts are very long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 256, 32 << 20
#: Bytes of text that one task of a shuffle takes.
PARTITION_BYTES = 128 << 20


class Memo(dict):
    """A dict that computes what it lacks, in two generations of half the cap: what is used again outlives a full one."""

    def __init__(self, fn: Callable[[Any], Any], cap: int):
        super().__init__()
        self.fn, self.half, self.old = fn, cap // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, bound Arrow batches for long texts, and give back what steps before have freed."""
    ship(spark)
    give_back(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions_for(spark: SparkSession, size: int, each: int = PARTITION_BYTES) -> int:
    """So many partitions that each holds about `each` bytes, and no fewer than the session shuffles to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: "str | StructType") -> DataFrame:
    """Apply fn to each Arrow batch of df."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)
