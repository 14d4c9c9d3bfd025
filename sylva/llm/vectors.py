"""Operator 8: near-duplicate vectors by sorted projection passes.

Each pass orders the vectors of a label by a key of concatenated random hyperplane bits and compares neighbours in that
order; links are verified in double precision, and the links of all passes are united. The order is cut into blocks of
about BLOCK positions; a block is compared with itself and the next. Where more vectors share one whole key than a block
holds, all blocks of that run are compared with one another, so a dense group loses nothing at a window's edge. The key
has enough bits that only dense groups form such runs, and there are enough passes that a pair at the threshold shares a
whole key in some pass with probability 1 - MISS, whatever the size of the table.

Equal vectors of a label are one class with a count. A pair is reported in the first pass that compares it; each group
of blocks returns, per vector, a number of links and a link of a spanning forest, never all pairs.

In a pass a vector is sent once with the SPAN blocks around it, and once more if it stands at their end, where the next
ones begin; a long run is dealt again in parts of RUN vectors, each part to all of the run. Vectors travel as they are
stored, with a block number and a run for each pass.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import map_batches, prepare
from sylva.operators.graph import components
from sylva.session import cut

COSINE = 0.98
BLOCK = 256
#: Blocks that meet in one group, and vectors of a long run that meet as many others in one.
SPAN, RUN = 8, 4096
#: Rows compared with a whole side at once.
SLICE = 256
#: Bits beyond those that make keys as many as blocks.
SPARE_BITS, LEAST_BITS, MOST_BITS = 6, 8, 30
MISS = 1e-4


def plan(largest: int, cosine: float = COSINE, block: int = BLOCK) -> tuple[int, int]:
    """Bits of a key and number of passes for labels of at most `largest` distinct vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, largest / block))) + SPARE_BITS))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


def project(x: np.ndarray, bits: int, passes: int) -> np.ndarray:
    """Keys of the rows of x, one column for each pass."""
    planes = np.random.default_rng([29, x.shape[1]]).normal(size=(x.shape[1], bits * passes))
    signs = (x @ planes > 0).reshape(len(x), passes, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a column of vectors of one length, in double precision."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(flat.flatten(), np.float64).reshape(len(flat), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(classes: DataFrame, bits: int, passes: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = np.array(batch.column("size"))
        keys = np.zeros((batch.num_rows, passes), np.int64)
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            keys[own] = project(_matrix(batch.column("embedding").take(pa.array(own))), bits, passes)
        return pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("label"), batch.column("size"), pa.array(list(keys), pa.list_(pa.int64()))], ["rep", "label", "size", "keys"])

    return map_batches(classes, run, "rep long, label string, size int, keys array<long>")


def _blocks(keyed: DataFrame, bits: int, block: int) -> DataFrame:
    """rep, at: for each pass, the block of a vector, and if its run is long, the run's first block (else -1), the number of its
    parts and the vector's own part."""
    each = keyed.select("rep", "label", "size", F.posexplode("keys").alias("pass", "key"))
    runs = each.groupBy("pass", "label", "size", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.shiftright("key", bits // 2))
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = runs.groupBy("pass", "label", "size", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("pass", "label", "size", "coarse", F.coalesce(F.sum("n").over(upto("pass", "label", "size", "coarse")), F.lit(0)).alias("before"))
    fine = runs.withColumn("within", F.coalesce(F.sum("n").over(upto("pass", "label", "size", "coarse", "key")), F.lit(0)))
    placed = fine.join(coarse, ["pass", "label", "size", "coarse"]).select("pass", "label", "size", "key", F.expr(f"(before + within) div {block}").alias("first"), F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("n") / RUN).alias("parts"))
    own = each.join(placed, ["pass", "label", "size", "key"])
    at = F.col("first") + F.pmod(F.xxhash64("rep", "pass"), F.col("blocks"))
    long_ = F.col("blocks") > 1
    part = F.pmod(F.xxhash64("rep", "pass", F.lit(1)), F.col("parts"))
    spot = F.struct("pass", at.cast("int").alias("block"), F.when(long_, F.col("first")).otherwise(-1).cast("int").alias("run"), F.when(long_, F.col("parts")).otherwise(0).cast("int").alias("parts"), part.cast("int").alias("part"))
    return own.select("rep", spot.alias("spot")).groupBy("rep").agg(F.array_sort(F.collect_list("spot")).alias("at"))


def _met(block: np.ndarray, run: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pass compares rows i and j."""
    return (np.abs(block[i] - block[j]) <= 1) | ((run[i] >= 0) & (run[i] == run[j]))


def _links(cosine: float):
    def run(table: pa.Table) -> pa.Table:
        p, kind, lo, hi = (table.column(c)[0].as_py() for c in ("pass", "kind", "lo", "hi"))
        x, mult, rep, part = _matrix(table.column("embedding")), *(np.array(table.column(c)) for c in ("mult", "rep", "part"))
        block, runs = (np.stack(table.column(c).to_pandas()) for c in ("block", "run"))
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))

        def compare(left: np.ndarray, right: np.ndarray | None) -> None:
            """Count the links of some rows with others, or among themselves, and join what they link."""
            nonlocal root
            own = left if right is None else right
            for at in range(0, len(left), SLICE):
                some = left[at : at + SLICE]
                near = x[some] @ x[own].T >= cosine
                if right is None:
                    near &= np.arange(len(own))[None, :] > np.arange(at, at + len(some))[:, None]
                i, j = np.nonzero(near)
                i, j = some[i], own[j]
                new = np.ones(len(i), bool)
                if kind == "span":
                    new &= (runs[i, p] < 0) | (runs[i, p] != runs[j, p])
                for q in range(p):
                    new &= ~_met(block[:, q], runs[:, q], i, j)
                i, j = i[new], j[new]
                np.add.at(links, i, mult[j])
                np.add.at(links, j, mult[i])
                while len(i):  # smallest reachable row, by rounds
                    least = root.copy()
                    np.minimum.at(least, root[i], root[j])
                    np.minimum.at(least, root[j], root[i])
                    np.minimum.at(least, i, root[j])
                    np.minimum.at(least, j, root[i])
                    least = least[least]
                    if (least == root).all():
                        break
                    root = least

        if kind == "span":
            rows = {b: np.flatnonzero(block[:, p] == b) for b in range(SPAN * lo, SPAN * lo + SPAN + 1)}
            for b in range(SPAN * lo, SPAN * lo + SPAN):
                if len(rows[b]):
                    compare(rows[b], None)
                    compare(rows[b], rows[b + 1])
        elif lo == hi:
            compare(np.arange(len(rep)), None)
        else:
            compare(np.flatnonzero(part == lo), np.flatnonzero(part == hi))
        while (root[root] != root).any():
            root = root[root]
        own = np.flatnonzero(links)
        return pa.table({"a": pa.array(rep[own]), "b": pa.array(rep[root[own]]), "links": pa.array(links[own])})

    return run


def near_vectors(table: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of table (vec_id, embedding, label, ...).

    Vectors that are null, zero, or hold null or non-finite components, and those with a null label or id, link with
    nothing: 0 links, themselves as component. Vectors of different lengths do not link. Repeated rows are vectors that
    link with each other. A cosine equal to the threshold is a link. An empty table gives no rows; other columns are not
    read. Cosines are those of the stored components in double precision.
    """
    spark = table.sparkSession
    prepare(spark)
    stored = table.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if stored == "float" else "double"
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{kind}>"), F.col("label").cast("string"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    marked = valid.withColumn("size", F.size("embedding")).withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    same = ["label", "size", "h1", "h2"]
    classes = cut(marked.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("embedding").alias("embedding")))
    largest = classes.groupBy("label", "size").count().agg(F.max("count")).first()[0] or 1
    bits, passes = plan(largest, cosine, block)
    keyed = _keyed(classes.select("rep", "label", "size", "embedding"), bits, passes)
    placed = classes.select("rep", "label", "size", "mult", "embedding").join(_blocks(keyed, bits, block), "rep")
    spot = F.col("spot")
    cell = lambda kind, lo, hi: F.struct(F.lit(kind).alias("kind"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    span = F.floor(spot["block"] / SPAN)
    edge = F.when((spot["block"] > 0) & (spot["block"] % SPAN == 0), F.array(cell("span", span - 1, span - 1))).otherwise(F.array().cast("array<struct<kind:string,lo:int,hi:int>>"))
    parts = F.sequence(F.lit(0), spot["parts"] - 1)
    runs = F.when(spot["parts"] > 0, F.transform(parts, lambda k: cell("run", F.least(k, spot["part"]), F.greatest(k, spot["part"])))).otherwise(F.array().cast("array<struct<kind:string,lo:int,hi:int>>"))
    dealt = placed.withColumn("spot", F.explode("at")).withColumn("cell", F.explode(F.concat(F.array(cell("span", span, span)), edge, runs)))
    dealt = dealt.select(
        "label", "size", spot["pass"].alias("pass"), "cell.kind", F.when(F.col("cell.kind") == "run", spot["run"]).otherwise(-1).alias("of"), "cell.lo", "cell.hi", spot["part"].alias("part"),
        "rep", "mult", "embedding", F.transform("at", lambda s: s["block"]).alias("block"), F.transform("at", lambda s: s["run"]).alias("run"),
    )
    linked = cut(dealt.groupBy("label", "size", "pass", "kind", "of", "lo", "hi").applyInArrow(_links(cosine), "a long, b long, links long"))
    groups = components(linked.select("a", "b"))
    counted = linked.groupBy("a").agg(F.sum("links").alias("links"))
    known = classes.join(counted, F.col("rep") == F.col("a"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = known.select(*same, (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    found = marked.select("vec_id", *same).join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda v: v != 0), F.lit(False)))
    out = found.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM (SELECT node AS vec_id, min(other) AS c FROM reach GROUP BY node)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""
