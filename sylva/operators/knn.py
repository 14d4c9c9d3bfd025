"""Exact nearest neighbours and pairwise distance listings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions import distances
from sylva.operators.blocks import matrix, pairs_of_blocks
from sylva.session import ship

#: Bytes of query vectors that are sent to every executor at once; more queries go in several rounds.
QUERY_BYTES = 64 << 20
#: Rows of the corpus, and distances, that a task looks at in one go.
ROWS, CELLS = 1024, 1 << 22


def _best(query: np.ndarray, dist: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order: by distance, NaN last, then by row."""
    order = np.lexsort((row, np.where(np.isnan(dist), np.inf, dist), np.isnan(dist), query))
    query, dist, row = query[order], dist[order], row[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))[: len(query)]
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], dist[rank < k], row[rank < k]


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", bits: int | None = None) -> DataFrame:
    """query_id, row_id, distance, rank (1 to k) for queries and corpus of (row_id, vector).

    Ties go to the smaller row_id and NaN comes last. Each task keeps its own k best per query, so what is shuffled is
    bounded by tasks x queries x k; the queries are stated rows, sent in rounds of bounded size. A task holds at most CELLS
    distances, and of these only those no farther than the k-th found so far go on.
    """
    spark = corpus.sparkSession
    ship(spark)
    first = queries.select(F.size("vector").alias("n"), "vector").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, row_id long, distance double, rank int")
    width = bits or first.n
    rounds = max(1, -(-queries.count() * 8 * width // QUERY_BYTES))
    best = None
    for r in range(rounds):
        rows = queries.where(F.pmod(F.xxhash64("row_id"), F.lit(rounds)) == r).select("row_id", "vector").toArrow()
        shared = spark.sparkContext.broadcast((np.array(rows.column("row_id")), matrix(rows.column("vector"), bits)))

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            found = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
            limit = np.full(len(ids), np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    own = batch.slice(at, ROWS)
                    names, x = np.array(own.column("row_id")), matrix(own.column("vector"), bits)
                    wide, parts = max(1, CELLS // len(names)), [found]
                    for low in range(0, len(ids), wide):
                        d = distances.block(metric, q[low : low + wide], x, bits)
                        rated = np.where(np.isnan(d), np.inf, d)
                        bound = limit[low : low + wide]
                        if len(names) > k:
                            bound = np.minimum(bound, np.partition(rated, k - 1, 1)[:, k - 1])
                        i, j = np.nonzero(rated <= bound[:, None])
                        parts.append((i + low, d[i, j], names[j]))
                    found = _best(*(np.concatenate(c) for c in zip(*parts, strict=True)), k)
                    last = np.flatnonzero(np.append(found[0][1:] != found[0][:-1], True)[: len(found[0])])
                    full = last[np.diff(np.append(-1, last)) == k]
                    limit[found[0][full]] = np.where(np.isnan(found[1][full]), np.inf, found[1][full])
            yield pa.RecordBatch.from_arrays([pa.array(ids[found[0]]), pa.array(found[2]), pa.array(found[1])], ["query_id", "row_id", "distance"])

        part = corpus.select("row_id", "vector").mapInArrow(run, "query_id long, row_id long, distance double")
        best = part if best is None else best.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", "row_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pairwise(rows: DataFrame, metric: str = "cosine", bits: int | None = None, radius: float | None = None, diagonal: bool = True) -> DataFrame:
    """i, j, distance for j <= i (or j < i): all pairs, or those within the radius.

    Pairs of blocks meet in groups of bounded size; nothing but the listed pairs leaves a task.
    """

    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        ids, block = np.array(table.column("row_id")), np.array(table.column("block"))
        x = matrix(table.column("vector"), bits)
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        d = distances.block(metric, x[left], x[right], bits)
        a, b = np.broadcast_to(ids[left][:, None], d.shape), np.broadcast_to(ids[right][None, :], d.shape)
        keep = np.ones(d.shape, bool) if radius is None else d <= radius
        if lo == hi:
            keep &= a >= b if diagonal else a > b
        a, b = a[keep], b[keep]
        return pa.table({"i": np.maximum(a, b), "j": np.minimum(a, b), "distance": d[keep]})

    dealt = pairs_of_blocks(rows, ["row_id", "vector"])
    return dealt.groupBy("lo", "hi").applyInArrow(run, "i long, j long, distance double")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Lines `i j d.dddddE+xx` in row-major order."""
    return pairs.orderBy("i", "j").select(F.format_string("%d %d %.5E", "i", "j", "distance").alias("value"))
