"""Row blocks: a table of vectors as numpy matrices, whether dense or bit sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import ship

#: Rows of a block; a task holds two blocks and their distances.
ROWS = 1024


def matrix(column: pa.Array | pa.ChunkedArray, bits: int | None = None) -> np.ndarray:
    """A column of vectors of one length, or of set positions below `bits`, as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.asarray(flat.flatten().fill_null(np.nan) if bits is None else flat.flatten())
    if bits is None:
        return values.astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    out = np.zeros((len(flat), bits))
    lengths = np.diff(flat.offsets.to_numpy())
    out[np.repeat(np.arange(len(flat)), lengths), values] = 1
    return out


def pairs_of_blocks(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Each row once for each pair of blocks (lo, hi) that holds its block, so that every two rows meet in one group.

    The blocks are even whatever the ids are; with n rows a row is sent n / ROWS times.
    """
    ship(rows.sparkSession)
    blocks = max(1, -(-rows.count() // ROWS))
    own = rows.select(*keep).withColumn("block", F.pmod(F.xxhash64(keep[0]), F.lit(blocks)).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return other.select(*keep, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
