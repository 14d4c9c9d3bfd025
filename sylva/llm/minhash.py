"""Operator 1: near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: occurrences times an inverse document frequency. Consistent
weighted samples of that set agree between two documents with the probability of their weighted Jaccard similarity; bands
of samples name candidates, and every candidate pair is verified by the exact weighted Jaccard similarity of its whole
texts.

The frequency behind a shingle's weight is the mean over its words of 1 + ln((N+1)/(df+1)) / ln(N+1), between 1 and 2. So
an edit weighs about as much as the text around it even inside a group of copies that holds much of the corpus, where the
shingles' own frequencies would leave only the edits to compare. Word frequencies are counted over all documents in a
table of fixed size, so what each executor holds does not grow with the data.

Texts of equal words are one class from the start, known by a number of its own and not by a document's id, so rows
that share an id are compared each by its text; copies take no part in what follows. Within a bucket every member is first compared with the smallest one, where
their samples make a link likely. What remains apart after that is compared across the remaining components, likely or
not, in blocks of bounded size whose tasks return the links they verify and no pairs; so no candidate pair is lost, and
what is sent grows with a bucket's size, not with its square, but for a factor of its stragglers over BLOCK. Only exact
upper bounds of the similarity spare a comparison: the ratio of the weights, and the overlap of the sets folded into
FOLDS cells.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm import ngrams as ng
from sylva.llm.common import map_batches, prepare, texts_of
from sylva.operators.graph import components
from sylva.session import cut, give_back

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** 4) ** 14 = 0.0006; of 0.85, with 0.00003.
BANDS, ROWS = 14, 4
#: Pairs whose samples agree less often wait for the stragglers; none is dropped for it.
LIKELY = 0.6
#: Cells of a folded set.
FOLDS = 256
FREQUENCY_BITS, CHUNK = 20, 1024
#: Up to so many ids (8 MB) the ids of candidate texts are broadcast; beyond, joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket that are compared with as many others in one task.
BLOCK = 256

_mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-cased words."""
    return ng.words(ng.as_bytes(text.lower()))


def shingles(words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles and their weights; a text of fewer than five words is one shingle."""
    n = min(WORDS, len(words))
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    m = len(words) - n + 1
    weight = idf[(words >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)]
    with np.errstate(over="ignore"):
        h, w = words[:m] * _mult[0], weight[:m].copy()
        for k in range(1, n):
            h = (h ^ (h >> np.uint64(29))) + words[k : m + k] * _mult[k]
            w += weight[k : m + k]
    h, first, count = np.unique(ng.mix(h), return_index=True, return_counts=True)
    return h, (w[first] / n * count).astype(np.float32)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: sum of minima over sum of maxima; 0 with an empty set."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    return both / (float(a[1].sum(dtype=float)) + float(b[1].sum(dtype=float)) - both)


def folded(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The weights of a set added up in FOLDS cells by the shingles' hashes."""
    return np.bincount((h % np.uint64(FOLDS)).astype(np.int64), w, FOLDS).astype(np.float32)


def may_reach(folds: np.ndarray, weight: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    """Whether sets may be similar enough to set x: no two sets share more than the minima of their cells add up to."""
    both = np.minimum(folds[others], folds[x]).sum(1) * (1 + 1e-4)  # single precision
    return both >= SIMILARITY * (weight[others] + weight[x] - both)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), their logarithms, and multipliers, one for each sample."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros(1 << 16), np.full(1 << 16, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    gamma = ((lo + hi) / 2).astype(np.float32)
    rng = np.random.default_rng(101)
    return gamma, np.log(gamma), rng.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def samples(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The consistent weighted samples (shingle, level) of a weighted set, as 32-bit hashes."""
    gamma, log_gamma, mult = _tables()
    k = len(mult)
    best = np.full(k, np.inf, np.float32)
    out = np.zeros(k, np.uint64)
    log_w = np.log(w)
    low, unit = np.uint64(0xFFFF), np.float32(1 / 65536)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1024):
            part, lw = h[at : at + 1024], log_w[at : at + 1024]
            z = part[None, :] * mult[:, None]
            z ^= z >> np.uint64(32)
            z *= _mult[1]
            r = gamma[(z >> np.uint64(48)).astype(np.int32)]
            log_c = log_gamma[((z >> np.uint64(32)) & low).astype(np.int32)]
            beta = ((z >> np.uint64(16)) & low).astype(np.float32) * unit
            t = np.floor(lw / r + beta)
            a = log_c - r * (t - beta + 1)
            i = a.argmin(1)
            rows = np.arange(k)
            low_a = a[rows, i]
            better = low_a < best
            best = np.where(better, low_a, best)
            found = ng.mix(part[i] + t[rows, i].astype(np.int64).astype(np.uint64) * _mult[2])
            out = np.where(better, found, out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of samples."""
    rows = sig.astype(np.uint64).reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64) * _mult[3]
        for k in range(ROWS):
            h = ng.mix(h ^ (rows[:, k] + np.uint64(k)))
    return h.view(np.int64)


# ---- corpus statistics


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each word bucket occurs, and the number of documents with any word.

    Each task adds up a table of fixed size and deals it out in chunks; the sum of each chunk is again of fixed size.
    """
    size, chunks = 1 << FREQUENCY_BITS, (1 << FREQUENCY_BITS) // CHUNK

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(size, np.int32), 0
        for batch in batches:
            for text in texts_of(batch):
                words = word_hashes(text)
                if len(words):
                    table[np.unique((words >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int32))] += 1
                    n += 1
        if n:
            parts = table.reshape(chunks, CHUNK)
            used = np.flatnonzero(parts.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["chunk", "counts"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.full(1, n, np.int32).tobytes()], pa.binary())], ["chunk", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["chunk", "counts"])

    parts = max(1, min(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select("text").mapInArrow(count, "chunk int, counts binary").repartition(parts, "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    table, n = np.zeros((chunks, CHUNK), np.int64), 0
    for r in rows:  # at most 1025 rows of 8 KB
        counts = np.frombuffer(r.counts, np.int64)
        if r.chunk < 0:
            n = int(counts[0])
        else:
            table[r.chunk] = counts
    return table.ravel(), n


def inverse_frequencies(table: np.ndarray, n: int) -> np.ndarray:
    return (1 + np.log((n + 1) / (np.minimum(table, n) + 1)) / np.log(max(2, n + 1))).astype(np.float32)


# ---- the operator


def _signatures(docs: DataFrame, idf) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        same, weight, sigs, bands = [], [], [], []
        for text in texts_of(batch):
            words = word_hashes(text)
            h, w = shingles(words, idf.value)
            if not len(h):
                same.append(None), weight.append(0.0), sigs.append([]), bands.append([])
                continue
            order = ng.span_hashes(words.view(np.uint8), np.zeros(1, np.int64), np.full(1, 8 * len(words), np.int64))
            sig = samples(h, w)
            same.append(order.tobytes() + np.bitwise_xor.reduce(h).tobytes())
            weight.append(float(w.sum(dtype=float)))
            sigs.append(sig.view(np.int32))
            bands.append(band_keys(sig))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("h"), pa.array(same, pa.binary()), pa.array(weight, pa.float64()), pa.array(sigs, pa.list_(pa.int32())), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "h", "same", "weight", "sig", "bands"],
        )

    return map_batches(docs, run, "doc_id long, h long, same binary, weight double, sig array<int>, bands array<long>")


def _likely(a: str, b: str):
    """The samples of two rows agree often enough, and their weights differ little enough, for a similarity of 0.8."""
    agree = F.size(F.filter(F.zip_with(f"{a}.sig", f"{b}.sig", lambda x, y: x == y), lambda x: x))
    return (F.least(f"{a}.weight", f"{b}.weight") >= (SIMILARITY - 1e-6) * F.greatest(f"{a}.weight", f"{b}.weight")) & (agree >= LIKELY * BANDS * ROWS)


def _texts(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text for some classes: the text of one row of each."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "h")
    few = wanted.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if few else wanted, ["doc_id", "h"]).groupBy("node").agg(F.min("text").alias("text"))


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) of classes whose texts have a weighted Jaccard similarity of at least 0.8."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), classes, docs)
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            keep = []
            for text_a, b, text_b in zip(texts_of(batch, "text_a"), batch.column("b").to_pylist(), texts_of(batch, "text_b"), strict=True):
                if held[0] != b:
                    held = (b, shingles(word_hashes(text_b), idf.value))
                keep.append(similarity(shingles(word_hashes(text_a), idf.value), held[1]) >= SIMILARITY)
            kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield kept

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _stragglers(banded: DataFrame, near: DataFrame, classes: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """Links (a, b) between members of one bucket whose components are not one yet.

    The members of a bucket's largest component meet the others, and the others one another; a pair that shares several
    buckets is compared in the first. Within a task likelier pairs come first, and components that a link joins are one
    from then on. Every other pair is verified unless an exact bound rules it out.
    """
    placed = banded.join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    counted = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counted.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("m"), F.sum("n").alias("all")).where("m < all")
    mixed = mixed.select("key", "main", F.ceil(F.col("m") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("m")) / BLOCK).alias("others"))
    own = placed.join(mixed, "key").withColumn("is_main", F.col("component") == F.col("main"))
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))))
    span = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    block = F.col("block")
    cells = F.when(F.col("is_main"), F.transform(span(F.col("others")), lambda j: cell("main", block, j))).otherwise(
        F.concat(F.transform(span(F.col("mains")), lambda i: cell("main", i, block)), F.transform(span(F.col("others")), lambda j: cell("other", F.least(block, j), F.greatest(block, j))))
    )
    own = cut(own.select("key", "node", "component", "is_main", "block", cells.alias("cells")))
    facts = classes.select("node", "weight", "sig", "bands").join(_texts(own.select("node").distinct(), classes, docs), "node")
    dealt = own.withColumn("cell", F.explode("cells")).select("key", "cell.kind", "cell.i", "cell.j", "node", "component", "is_main", "block").join(facts, "node")

    def run(table: pa.Table) -> pa.Table:
        kind, i, j, key = (table.column(c)[0].as_py() for c in ("kind", "i", "j", "key"))
        node, main, at, group, weight = (np.array(table.column(c)) for c in ("node", "is_main", "block", "component", "weight"))
        sig, bands = (np.stack(table.column(c).to_pandas()) for c in ("sig", "bands"))
        if kind == "main":
            left, right = np.flatnonzero(main), np.flatnonzero(~main)
        else:
            left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        found_a, found_b, sets = [], [], {}
        pairs = []
        for x in left:
            own = right if kind == "main" or i != j else right[right > x]
            agree = (sig[own] == sig[x]).mean(1)
            close = np.minimum(weight[own], weight[x]) >= (SIMILARITY - 1e-6) * np.maximum(weight[own], weight[x])
            same = bands[own] == bands[x]
            first = bands[x][same.argmax(1)] == key
            keep = np.flatnonzero(close & first & (group[own] != group[x]))
            pairs.append((np.full(len(keep), x), own[keep], agree[keep]))
        xs, ys, agrees = (np.concatenate(c) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        folds = np.zeros((len(node), FOLDS), np.float32)
        text = table.column("text")

        def shingled(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in sets:
                sets[k] = shingles(word_hashes(text[k].as_py() or ""), idf.value)
            return sets[k]

        for k in np.unique(np.concatenate([xs, ys])).tolist():
            folds[k] = folded(*shingled(k))
        may = np.zeros(len(xs), bool)
        for x in np.unique(xs).tolist():
            at_x = np.flatnonzero(xs == x)
            may[at_x] = may_reach(folds, weight, x, ys[at_x])
        order = np.flatnonzero(may)
        order = order[np.lexsort((ys[order], xs[order], -agrees[order]))]
        root = {g: g for g in group.tolist()}

        def top(g: int) -> int:
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        for x, y in zip(xs[order].tolist(), ys[order].tolist(), strict=True):
            gx, gy = top(int(group[x])), top(int(group[y]))
            if gx == gy:
                continue
            if similarity(shingled(x), shingled(y)) >= SIMILARITY:
                found_a.append(int(node[x])), found_b.append(int(node[y]))
                root[max(gx, gy)] = min(gx, gy)
        return pa.table({"a": pa.array(found_a, pa.int64()), "b": pa.array(found_b, pa.int64())})

    return dealt.groupBy("key", "kind", "i", "j").applyInArrow(run, "a long, b long")


def _groups(docs: DataFrame) -> DataFrame:
    """doc_id, h (the hash of the text), cluster_id, kept for each row of docs (doc_id long, text, h) with an id."""
    spark = docs.sparkSession
    table, n = word_frequencies(docs)
    idf = spark.sparkContext.broadcast(inverse_frequencies(table, n))
    docs = docs.where("doc_id is not null")
    signed = cut(_signatures(docs, idf))
    known = signed.where("same is not null")
    classes = known.groupBy("same").agg(F.min(F.struct("doc_id", "h")).alias("first"), *[F.first(c).alias(c) for c in ("weight", "sig", "bands")])
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "same", F.col("first.doc_id").alias("rep"), "first.h", "weight", "sig", "bands"))
    facts = classes.select("node", "weight", "sig")
    banded = classes.select("node", F.explode("bands").alias("key"))

    # against the first member of each bucket
    leaders = banded.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    star = banded.join(leaders, "key").where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    named = star.join(facts.alias("x"), F.col("a") == F.col("x.node")).join(facts.alias("y"), F.col("b") == F.col("y.node"))
    first = cut(_verified(cut(named.where(_likely("x", "y")).select("a", "b")), classes, docs, idf))
    near = cut(components(first))
    give_back(spark)
    second = cut(_stragglers(banded, near, classes, docs, idf))

    joined = components(first.union(second)).join(classes.select("node", "rep", "h"), "node")
    leads = joined.groupBy("component").agg(F.min(F.struct("rep", "h", "node")).alias("lead"))
    led = joined.select("node", "component").join(leads, "component").select("node", "lead")
    alone = F.struct("rep", "h", "node")
    lead = classes.join(led, "node", "left").select("same", F.coalesce("lead", alone).alias("lead"))
    rows = known.select("doc_id", "h", "same").join(lead, "same").select("doc_id", "h", F.col("lead.rep").alias("cluster_id"), ((F.col("doc_id") == F.col("lead.rep")) & (F.col("h") == F.col("lead.h"))).alias("kept"))
    return rows.unionByName(signed.where("same is null").select("doc_id", "h", F.col("doc_id").alias("cluster_id"), F.lit(True).alias("kept")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, cluster_id, kept for each row of docs (doc_id, text, ...).

    cluster_id is the smallest doc_id that links of similarity 0.8 or more reach; kept marks the row that stays for its
    group. Null, empty and white texts are like nothing, equal ones included: each is a group of its own. A null doc_id
    gives cluster_id null and kept true. Rows are compared by their texts, also where they share an id; rows equal in id
    and text share their group and their kept. Of a group's rows with the smallest id, that of the smallest text hash is
    kept. An empty table gives no rows; other columns are not read; texts of any length are read whole.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    found = _groups(slim).select("doc_id", "cluster_id", "kept")
    return found.unionByName(slim.where("doc_id is null").select("doc_id", F.col("doc_id").alias("cluster_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest id, with all columns of docs.

    Rows without an id stay, as do null, empty and white texts; of rows that are equal in id and text one stays, whose
    other columns come first as JSON. Rows that share an id but not their text go by their texts. Columns of any name come
    through; an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    gone = cut(_groups(row.select(F.col("id").alias("doc_id"), "row.text", "h")).where("not kept").select(F.col("doc_id").alias("id"), "h").distinct())
    left = row.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, ["id", "h"], "left_anti")
    again = cut(row.where("id is not null").groupBy("id", "h").count().where("count > 1").select("id", "h"))
    if again.isEmpty():
        return left.select("row.*")
    few = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    one = left.join(few, ["id", "h"], "left_semi").groupBy("id", "h").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.join(few, ["id", "h"], "left_anti").select("row").unionByName(one.select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
