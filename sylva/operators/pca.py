"""Principal components: means, population covariance, spectrum, and projections of the uncentred rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.blocks import matrix
from sylva.session import ship

#: Rows whose mean is taken off all rows before their products are added up.
SHIFT_ROWS = 256


def means(rows: DataFrame) -> DataFrame:
    """feature, mean."""
    return rows.select(F.posexplode("vector").alias("feature", "x")).groupBy("feature").agg(F.avg("x").alias("mean"))


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def gram(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, their mean, and the sum of the outer products of what is left of them without it.

    Some rows' mean is taken off beforehand, so that little cancels where the mean is far from zero. A task adds up one
    matrix; there are a few tasks a core, however many files there are, and the matrices' rows are added apart.
    """
    spark = rows.sparkSession
    ship(spark)
    some = matrix(rows.limit(SHIFT_ROWS).select("vector").toArrow().column("vector"))
    if not len(some):
        return 0, np.zeros(0), np.zeros((0, 0))
    shift, d = some.mean(0), some.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, np.zeros(d), np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vector")) - shift
                n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), _lists(np.append(total, n)[None, :])], ["i", "v"])
            for at in range(0, d, 64):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, min(d, at + 64), dtype=np.int32)), _lists(outer[at : at + 64])], ["i", "v"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                sums[i] = sums.get(i, 0) + np.asarray(v.values)
        for i, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), _lists(v[None, :])], ["i", "v"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    part = rows.select("vector").coalesce(tasks).mapInArrow(run, "i int, v array<double>")
    summed = part.repartition(min(tasks, 1 + d // 64), "i").mapInArrow(add, "i int, v array<double>").toArrow()
    outer = np.zeros((d, d))
    for i, v in zip(summed.column("i").to_pylist(), summed.column("v"), strict=True):
        if i < 0:
            total, n = np.asarray(v.values)[:d], int(v.values[d].as_py())
        else:
            outer[i] = np.asarray(v.values)
    off = total / n
    return n, shift + off, outer - n * np.outer(off, off)


@dataclass
class Model:
    mean: np.ndarray
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray


def fit(rows: DataFrame, tail_compat: bool = False) -> Model:
    """Eigenvalues ascending; each eigenvector's largest component is positive.

    tail_compat leaves the last n % 4 rows by row_id out of the sums of products, while n still counts them.
    """
    n, mean, outer = gram(rows)
    if tail_compat and n % 4:
        last = rows.orderBy(F.desc("row_id")).limit(n % 4).select("vector").toArrow()
        x = matrix(last.column("vector")) - mean
        outer = outer - x.T @ x
    cov = outer / max(1, n)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2) if len(cov) else (np.zeros(0), np.zeros((0, 0)))
    if len(values):
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(values))] < 0, -1, 1)
    return Model(mean, cov, values, vectors)


def covariance(rows: DataFrame) -> DataFrame:
    """i, j, cov for j <= i, by sums alone."""
    of = fit(rows).covariance
    i, j = np.tril_indices(len(of))
    return rows.sparkSession.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "cov": of[i, j]}))


def eigenvalues(model: Model, spark) -> DataFrame:
    """k, eigenvalue, ascending."""
    return spark.createDataFrame(pa.table({"k": np.arange(len(model.values), dtype=np.int32), "eigenvalue": model.values}))


def project(rows: DataFrame, model: Model, dims: int) -> DataFrame:
    """row_id, pc: the uncentred rows on the dims leading eigenvectors, largest first."""
    spark = rows.sparkSession
    ship(spark)
    axes = spark.sparkContext.broadcast(model.vectors[:, ::-1][:, :dims].copy())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row_id"), _lists(matrix(batch.column("vector")) @ axes.value)], ["row_id", "pc"])

    return rows.select(F.col("row_id").cast("long"), "vector").mapInArrow(run, "row_id long, pc array<double>")


def subset(projected: DataFrame, dims: int) -> DataFrame:
    """The first components, as vectors for the next operator."""
    return projected.select("row_id", F.slice("pc", 1, dims).alias("vector"))
