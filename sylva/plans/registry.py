"""Registered queries over the driver tables, each with its SQL oracle where SQL can state it.

`embeddings` is the vector table (its sign bits the binary one, its rows on the two leading principal components the plane
that is clustered), `documents` the corpus, `benchmark` and `conversations` the questions, `events.props` the JSON lines.
Queries of formats write their files into a folder of their own, read them back, keep what they read and delete the folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.functions import distances, text
from sylva.operators import bpe, clients, density, evaluate, knn, pca, rag, tree
from sylva.session import cut, fresh_folder, numbered, remove
from sylva.sources import formats
from sylva.sources import text as files
from sylva.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]

BITS = 64
K = 5
MINPTS = 5
COSINE_RADIUS, YULE_RADIUS, PLANE_RADIUS = 0.68, 0.40, 0.02
START, STEP, STEPS = 0.02, 0.005, 16
END_HEX, UNKNOWN_HEX = bpe.END.encode().hex(), bpe.UNKNOWN.encode().hex()
MERGES = 64
LONG_BITS = 300
DIMENSIONS = 10
PASSAGES = 3
SLICE = 200
CHUNK = 40


# ---- tables


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"))


def plane(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d)
    return pca.subset(pca.project(rows, pca.fit(rows), 2), 2)


def bits(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("row_id", distances.sign_bits(F.col("vector")).alias("vector"))


def long_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits that tell which of two components is the larger: as many as make the historical kernel leave some out."""
    at = lambda k: F.element_at("vector", k.cast("int") + 1)
    set_ = lambda k: F.when(at(k % 64) > at((k + 1 + 5 * F.floor(k / 64)) % 64), k)
    return vectors(spark, d).select("row_id", F.filter(F.transform(F.sequence(F.lit(0), F.lit(LONG_BITS - 1)), set_), lambda k: k.isNotNull()).alias("vector"))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("long").alias("label"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")


def asked(rows: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return rows.where("row_id % 20 = 0")


def layers(spark: SparkSession, d: str, task_pairs: int = density.TASK_PAIRS) -> density.Layers:
    return density.adaptive_on_grid(plane(spark, d), START, STEP, MINPTS, task_pairs=task_pairs)


def through_files(spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` finds in a new folder after `write`; the folder is gone afterwards."""
    folder = fresh_folder(spark, "files")
    where, path = formats.filesystem(folder)
    where.create_dir(path, recursive=True)
    write(folder)
    got = cut(read(folder))
    remove(spark, folder)
    return got


# ---- oracle fragments


_V = "v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS b FROM embeddings)"
_COS = "(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))))"
_L2 = "list_distance(a.e, b.e)"
_PLANE_L2 = "sqrt((a.e[1] - b.e[1]) * (a.e[1] - b.e[1]) + (a.e[2] - b.e[2]) * (a.e[2] - b.e[2]))"
_BOTH, _AB = "list_dot_product(a.b, b.b)", "(list_sum(a.b) - list_dot_product(a.b, b.b)) * (list_sum(b.b) - list_dot_product(a.b, b.b))"


def _yule(n: int) -> str:
    return f"(2 * {_AB} / nullif({_BOTH} * ({n} - list_sum(a.b) - list_sum(b.b) + {_BOTH}) + {_AB}, 0))"


_YULE = _yule(64)
#: How often a covariance matrix is squared: what is left beside its leading axis is far below rounding.
_SQUARES = 14


def _axes(most: int) -> str:
    """axes(k, lam, v): the leading eigenpairs by repeated squaring of the covariance matrix, each taken off it in turn."""
    less = "list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: c[i][j] - l * w[i] * w[j]))"
    diagonal = "list_transform(range(1, 65), lambda i: p[i][i])"
    return f"""covariances AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(x ORDER BY j) AS r FROM
  (SELECT a.k AS i, b.k AS j, covar_pop(embedding[a.k]::DOUBLE, embedding[b.k]::DOUBLE) AS x FROM embeddings, range(1, 65) a(k), range(1, 65) b(k) GROUP BY a.k, b.k) GROUP BY i)),
squared(k, n, lam, v, c, p) AS (
  SELECT 0, 0, NULL::DOUBLE, NULL::DOUBLE[], c, c FROM covariances
  UNION ALL
  SELECT CASE WHEN n < {_SQUARES} THEN k ELSE k + 1 END, CASE WHEN n < {_SQUARES} THEN n + 1 ELSE 0 END, l, w, CASE WHEN n < {_SQUARES} THEN c ELSE {less} END,
    CASE WHEN n < {_SQUARES} THEN list_transform(p, lambda r: list_transform(p, lambda s: list_dot_product(r, s) / t)) ELSE {less} END
  FROM (SELECT *, list_dot_product(list_transform(c, lambda r: list_dot_product(r, w)), w) AS l FROM (
    SELECT k, n, c, p, list_sum(list_transform(p, lambda r: list_dot_product(r, r))) AS t, list_transform(p[m], lambda x: x / sqrt(list_dot_product(p[m], p[m]))) AS w
    FROM (SELECT *, list_position({diagonal}, list_max({diagonal})) AS m FROM squared WHERE k < {most})))),
axes AS MATERIALIZED (SELECT k, lam, v FROM squared WHERE n = 0 AND k > 0)"""


_PLANE = f"{_axes(2)}, v AS MATERIALIZED (SELECT vec_id AS i, (SELECT list(list_dot_product(embedding::DOUBLE[], axes.v) ORDER BY k) FROM axes) AS e FROM embeddings)"


def _grid(values: list[float]) -> str:
    return ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(values))


def _labels_sql(distance: str, values: list[float], rows: str = _V) -> str:
    """lab(step, row_id, label, cluster) at each radius, by recursion over sets of labels."""
    return f"""
WITH RECURSIVE {rows}, eps(step, r) AS (VALUES {_grid(values)}),
pairs AS MATERIALIZED (SELECT a.i, b.i AS j, {distance} AS d FROM v a JOIN v b ON {distance} <= {max(values)!r}),
nb AS MATERIALIZED (SELECT step, i, j FROM pairs JOIN eps ON d <= r),
core AS MATERIALIZED (SELECT step, i, count(*) > {MINPTS} AS seed FROM nb GROUP BY step, i HAVING count(*) >= {MINPTS}),
reach(step, v, l) AS (
  SELECT step, i, i FROM core WHERE seed
  UNION
  SELECT n.step, n.j, r.l FROM reach r JOIN nb n ON n.step = r.step AND n.i = r.v JOIN core c ON c.step = n.step AND c.i = n.j
  WHERE c.seed OR r.l < n.j),
inner_ AS MATERIALIZED (SELECT step, v, min(l) AS l FROM reach GROUP BY step, v),
border AS (SELECT n.step, n.j AS v, min(c.l) AS l FROM nb n JOIN inner_ c ON c.step = n.step AND c.v = n.i
  WHERE NOT EXISTS (SELECT 1 FROM inner_ k WHERE k.step = n.step AND k.v = n.j) GROUP BY n.step, n.j),
lab AS MATERIALIZED (SELECT step, v AS row_id, l AS label, (dense_rank() OVER (PARTITION BY step ORDER BY l) - 1)::BIGINT AS cluster
  FROM (SELECT * FROM inner_ UNION ALL SELECT * FROM border))"""


_LAYERS = _labels_sql(_PLANE_L2, density.radii(START, STEP, STEPS), _PLANE) + """,
cnt AS (SELECT eps.step, count(DISTINCT cluster) AS n FROM eps LEFT JOIN lab USING (step) GROUP BY eps.step),
stop AS (SELECT coalesce(min(step), 1000) AS s FROM cnt WHERE n = 1),
acc AS (SELECT step, n, row_number() OVER (ORDER BY step) - 1 AS layer FROM
  (SELECT step, n, min(n) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cnt)
  WHERE (m IS NULL OR n < m) AND step <= (SELECT s FROM stop)),
mem AS MATERIALIZED (SELECT layer::BIGINT AS layer, row_id, label, cluster FROM lab JOIN acc USING (step)),
size AS (SELECT layer, cluster, count(*) AS n FROM mem GROUP BY layer, cluster),
edge AS MATERIALIZED (SELECT p.layer, p.cluster, c.layer AS child_layer, c.cluster AS child, count(*) AS common
  FROM mem p JOIN mem c ON p.row_id = c.row_id AND p.layer = c.layer + 1 JOIN size s ON s.layer = c.layer AND s.cluster = c.cluster
  GROUP BY p.layer, p.cluster, c.layer, c.cluster, s.n HAVING count(*) > 0.8 * s.n),
node AS MATERIALIZED (SELECT s.layer, s.cluster, s.n, e.layer AS up_layer, e.cluster AS up FROM size s LEFT JOIN edge e ON e.child_layer = s.layer AND e.child = s.cluster),
lbl AS (SELECT vec_id AS row_id, label::BIGINT AS truth FROM embeddings)
"""


# ---- queries


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + 0 for n in names})


def vdb_details(spark, d):
    return _long(vectors(spark, d).agg(F.lit("double").alias("type"), F.max(F.size("vector")).alias("vector_length"), F.count(F.lit(1)).alias("entries")), "vector_length")


def vdb_entry_lookup(spark, d):
    return asked(vectors(spark, d)).select("row_id", F.posexplode("vector").alias("pos", "x")).select("row_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


def vdb_texts_by_index(spark, d):
    asked_, docs = _read(spark, d, "benchmark"), corpus(spark, d)
    apart = docs.count() // asked_.count()
    return tree.rows_by_index(docs, asked_.select(F.col("item_id").alias("pos"), (F.col("item_id") * apart + 1).alias("row_id"))).select("pos", "row_id", "text")


def cosine_pairwise(spark, d):
    return _round(knn.pairwise(vectors(spark, d)), "distance")


def l2_pairwise(spark, d):
    return _round(knn.pairwise(vectors(spark, d), "l2"), "distance")


def _yule_pairs(rows: DataFrame, metric: str, n: int) -> DataFrame:
    df = _round(knn.pairwise(rows, metric, n), "distance")
    return df.withColumn("distance", F.when(~F.isnan("distance"), F.col("distance")))


def yule_pairwise(spark, d):
    return _yule_pairs(bits(spark, d), "yule", BITS)


def yule_simd_compat(spark, d):
    return _yule_pairs(long_bits(spark, d), "yule_simd", LONG_BITS)


def knn_cosine(spark, d):
    rows = vectors(spark, d)
    return _round(_long(knn.knn(asked(rows), rows, K), "rank"), "distance")


def knn_l2(spark, d):
    rows = vectors(spark, d)
    return _round(_long(knn.knn(asked(rows), rows, K, "l2"), "rank"), "distance")


def knn_yule(spark, d):
    rows = bits(spark, d)
    return _round(_long(knn.knn(asked(rows), rows, K, "yule", BITS), "rank"), "distance")


def eps_neighbors(spark, d):
    return _round(density.neighbours(vectors(spark, d), COSINE_RADIUS), "distance")


def eps_degree(spark, d):
    return density.degrees(density.neighbours(vectors(spark, d), COSINE_RADIUS))


def _dbscan(nb: DataFrame, radius: float, task_pairs: int = density.TASK_PAIRS) -> DataFrame:
    return _long(density.dbscan(nb, radius, MINPTS, task_pairs), "cluster")


def dbscan_cosine(spark, d):
    return _dbscan(density.neighbours(vectors(spark, d), COSINE_RADIUS), COSINE_RADIUS)


def dbscan_yule(spark, d):
    return _dbscan(density.neighbours(bits(spark, d), YULE_RADIUS, "yule", BITS), YULE_RADIUS)


def dbscan_l2(spark, d):
    return _dbscan(density.neighbours_on_grid(plane(spark, d), PLANE_RADIUS), PLANE_RADIUS)


def _far(rows: DataFrame) -> DataFrame:
    """Row ids that use all bits, from which _near leads back; their order is that of the plain ones."""
    return rows.withColumn("row_id", F.col("row_id") * (1 << 40) - (1 << 62))


def _near(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.expr(f"({c} + {1 << 62}) div {1 << 40}") for c in ("row_id", "label")})


def dbscan_cosine_joins(spark, d):
    return _near(_dbscan(density.neighbours(_far(vectors(spark, d)), COSINE_RADIUS), COSINE_RADIUS, 0))


def dbscan_l2_joins(spark, d):
    return _near(_dbscan(density.neighbours_on_grid(_far(plane(spark, d)), PLANE_RADIUS), PLANE_RADIUS, 0))


def adaptive_layers(spark, d):
    return _long(layers(spark, d).members, "layer", "cluster")


def adaptive_layers_joins(spark, d):
    return _long(layers(spark, d, 0).members, "layer", "cluster")


def layer_stats(spark, d):
    found = layers(spark, d)
    stats = spark.createDataFrame([(a, b, n) for a, b, _, n in found.stats], "layer long, step long, clusters long")
    return stats


def layer_coverage(spark, d):
    return _round(_long(tree.coverage(layers(spark, d).members, vectors(spark, d)), "layer"), "coverage")


def layer_edges(spark, d):
    return _long(tree.edges(layers(spark, d).members), "layer", "cluster", "child_layer", "child")


def cluster_intersections(spark, d):
    return _long(tree.layer_intersections(layers(spark, d).members), "layer", "cluster_a", "cluster_b")


def noise_rows(spark, d):
    found = layers(spark, d)
    each = plane(spark, d).select("row_id", F.explode(F.array(*[F.lit(k).cast("long") for k, *_ in found.stats])).alias("layer"))
    return each.join(_long(found.members, "layer"), ["layer", "row_id"], "left_anti").select("layer", "row_id")


def cluster_counts(spark, d):
    return _long(tree.cluster_counts(layers(spark, d).members), "layer")


def cluster_members(spark, d):
    found = layers(spark, d)
    return _long(tree.gather(found.members, found.rows).select("layer", "cluster", "pos", "row_id"), "layer", "cluster", "pos")


def cluster_sub_vdb(spark, d):
    found = layers(spark, d)
    got = tree.gather(found.members, found.rows)
    return _long(got.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("vector", 1)), 5).alias("sum_x"), F.round(F.sum(F.element_at("vector", 2)), 5).alias("sum_y")), "layer", "cluster")


def pca_means(spark, d):
    return _round(_long(pca.means(vectors(spark, d)), "feature"), "mean")


def pca_covariance(spark, d):
    return _long(pca.covariance(vectors(spark, d)).withColumn("cov", F.round("cov", 8)), "i", "j")


def pca_eigenvalues(spark, d):
    return _long(pca.eigenvalues(pca.fit(vectors(spark, d)), spark).withColumn("eigenvalue", F.round("eigenvalue", 8)), "k")


def _projected(spark, d) -> DataFrame:
    rows = vectors(spark, d)
    return pca.project(rows, pca.fit(rows), DIMENSIONS)


def _each(df: DataFrame, column: str) -> DataFrame:
    return _round(_long(df.select("row_id", F.posexplode(column).alias("pos", "x")), "pos"), "x")


def pca_projection(spark, d):
    return _each(_projected(spark, d), "pc")


def pca_subset(spark, d):
    return _each(pca.subset(_projected(spark, d), 2), "vector")


def projection_lines(spark, d):
    rows = vectors(spark, d)
    model = pca.fit(rows)

    def write(folder: str) -> None:
        files.projection_lines(pca.project(rows, model, 2)).coalesce(1).write.text(f"{folder}/lines")

    return through_files(spark, write, lambda folder: files.lines(spark, f"{folder}/lines"))


def eigenvalue_lines(spark, d):
    def write(folder: str) -> None:
        files.eigenvalue_lines(pca.eigenvalues(pca.fit(vectors(spark, d)), spark)).coalesce(1).write.text(f"{folder}/lines")

    return through_files(spark, write, lambda folder: files.lines(spark, f"{folder}/lines"))


def word_counts(spark, d):
    return text.word_counts(corpus(spark, d))


def first_occurrence_words(spark, d):
    return text.word_list(corpus(spark, d)).select("row_id", "word", F.col("first").cast("long").alias("first"), "n")


def longest_word(spark, d):
    return _long(text.longest_word(corpus(spark, d)), "bytes")


def byte_alphabet(spark, d):
    return _long(bpe.byte_alphabet(corpus(spark, d)), "id", "byte")


def bpe_best_pair(spark, d):
    docs = corpus(spark, d)
    ids = {r.byte: r.id for r in bpe.byte_alphabet(docs).collect()}
    start = bpe.first_tokens(bpe.distinct_words(docs), ids)
    return bpe.pair_counts(start).orderBy(F.desc("n"), "b", "a").limit(1).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


def _trained(spark, d) -> bpe.Tokenizer:
    return bpe.train(corpus(spark, d), merges=MERGES)


def _rules(spark, t: bpe.Tokenizer) -> DataFrame:
    return spark.createDataFrame([(k, t.tokens[c].hex(), a, b) for k, (a, b, c) in enumerate(t.rules)], "rule_no long, token string, left long, right long")


def bpe_train(spark, d):
    return _rules(spark, _trained(spark, d))


def bpe_train_in_rounds(spark, d):
    return _rules(spark, bpe.train(corpus(spark, d), merges=MERGES, task_tokens=-1))


def bpe_encode(spark, d):
    return _long(bpe.encode(corpus(spark, d), _trained(spark, d)).select("row_id", F.size("tokens").alias("n"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5")), "n")


def bpe_binary_embedding(spark, d):
    return bpe.binary_embedding(corpus(spark, d), _trained(spark, d)).select("row_id", F.array_join("bits", " ").alias("bits"))


def bpe_real_embedding(spark, d):
    return _long(bpe.real_embedding(corpus(spark, d), _trained(spark, d)), "token")


def text_slices(spark, d):
    return text.slices(corpus(spark, d), SLICE).select("row_id", F.col("pos").cast("long").alias("pos"), "start", "bytes")


def text_slices_overlap(spark, d):
    return text.slices(corpus(spark, d), SLICE, overlap=True).select("row_id", F.col("pos").cast("long").alias("pos"), "start", "bytes")


def jsonl_extract(spark, d):
    return _read(spark, d, "events").select(F.col("event_id").alias("row_id"), F.get_json_object("props", "$['k']").alias("text"))


def _qrels(spark, d) -> DataFrame:
    l = labels(spark, d)
    q = asked(l).select(F.col("row_id").alias("q"), "label")
    return l.join(q, "label").where("q <> row_id").select(F.col("q").cast("string").alias("query_id"), F.col("row_id").cast("string").alias("corpus_id"), (1 + F.col("row_id") % 3).cast("int").alias("score"))


def qrels_max_score(spark, d):
    return _long(evaluate.qrels_max(_qrels(spark, d)), "best")


def beir_accuracy(spark, d):
    rows = vectors(spark, d).withColumn("name", F.col("row_id").cast("string"))
    return _round(evaluate.retrieval_accuracy(asked(rows), rows, _qrels(spark, d), "cosine"), "accuracy")


def label_ids(spark, d):
    return _long(text.dense_ids(labels(spark, d), "label"), "id", "first")


def contingency(spark, d):
    return _long(evaluate.contingency(layers(spark, d).members.drop("label"), labels(spark, d)), "layer", "cluster")


def _scores(spark, d, name: str) -> DataFrame:
    table = evaluate.contingency(layers(spark, d).members.drop("label"), labels(spark, d))
    df = _long(evaluate.cluster_scores(table), "layer").select("layer", "docs", F.round(name, 6).alias(name))
    return df.withColumn(name, F.when(~F.isnan(name), F.col(name)))


def ari_score(spark, d):
    return _scores(spark, d, "ari")


def nmi_score(spark, d):
    return _scores(spark, d, "nmi")


def corpus_stats(spark, d):
    return _round(text.corpus_stats(corpus(spark, d)), "mean_words", "sd_words")


def node_label_mix(spark, d):
    return _round(_long(tree.label_mix(layers(spark, d).members.drop("label"), labels(spark, d)), "layer", "cluster"), "intensity")


def rag_prompt(spark, d):
    rows = vectors(spark, d).join(corpus(spark, d), "row_id", "left")
    said = _read(spark, d, "benchmark").select((F.col("item_id") * 20).alias("query_id"), F.concat(F.lit(rag.USER), "text", F.lit(rag.ASSISTANT)).alias("history"))
    return rag.rag_prompts(rag.retrieve(asked(rows), rows, 3), said)


def chat_prompt(spark, d):
    return rag.chat_prompts(_read(spark, d, "conversations"))


def conversation_history(spark, d):
    return rag.conversation(_read(spark, d, "conversations"))


def annotation_chunks(spark, d):
    return _long(tree.annotation_chunks(layers(spark, d).members, CHUNK).groupBy("layer", "cluster", "chunk").agg(F.count(F.lit(1)).alias("n")), "layer", "cluster")


def annotation_qc(spark, d):
    checked = rag.annotation_check(_read(spark, d, "conversations"))
    return checked.select("conv_id", "turn", "bad", F.length("correction_input").cast("long").alias("n_correction"))


def _mapping(df: DataFrame) -> DataFrame:
    return df.select("key", "doc_count", F.array_join("article_ids", ",").alias("article_ids"), "label")


def mapping_rows(spark, d):
    return _mapping(tree.mapping(layers(spark, d).members))


def _names(members: DataFrame) -> DataFrame:
    """Names as annotators may give them: of some clusters none, of some a blank one."""
    name = F.when(F.col("cluster") % 3 == 0, F.concat(F.lit(" field "), F.col("cluster").cast("string"), F.lit("_ "))).when(F.col("cluster") % 3 == 1, F.lit("  "))
    return members.select("layer", "cluster").distinct().withColumn("label", name).where("label is not null")


def mapping_with_labels(spark, d):
    members = layers(spark, d).members
    return _mapping(tree.mapping(members, _names(members)))


def node_labels(spark, d):
    """The nodes of the tree and one that is not mapped, as the viewer names and counts them."""
    members = layers(spark, d).members
    mapped = tree.mapping(members, _names(members))
    keys = mapped.select("key").unionByName(spark.createDataFrame([("L99C0N1",)], "key string"))
    known = tree.doc_counts(keys, mapped).withColumn("name", F.coalesce("label", "key"))
    return known.select("key", "doc_count", tree.node_label(F.col("name")).alias("label"), tree.shortened(F.col("name"), 5).alias("short"))


def significant_nodes(spark, d):
    members = layers(spark, d).members
    nodes = tree.nodes(members)
    inner = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("inner", F.lit(True))
    named = nodes.join(inner, "node", "left").join(_names(members), ["layer", "cluster"], "left")
    named = named.select("layer", "cluster", F.col("size").alias("doc_count"), F.nullif(F.trim("label"), F.lit("")).alias("label"), F.coalesce("inner", F.lit(False)).alias("inner"))
    return _long(tree.significant(named, 50).select("layer", "cluster", "doc_count", "label"), "layer", "cluster")


def every_nth_leaf(spark, d):
    nodes = tree.nodes(layers(spark, d).members)
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    return _named(tree.every_nth(leaves, "node", 3).select("node"), "node")


def label_unification(spark, d):
    """The prompts that bring the names of a cluster's chunks to one."""
    chunks = tree.annotation_chunks(layers(spark, d).members, CHUNK).select("layer", "cluster", "chunk").distinct()
    name = F.when(F.col("chunk") % 4 == 3, F.lit(" ")).otherwise(F.concat(F.lit("field "), (F.col("chunk") % 5).cast("string")))
    return _long(rag.unification_prompts(chunks.withColumn("label", name)), "layer", "cluster")


def annotation_prompts(spark, d):
    return _read(spark, d, "benchmark").select("item_id", *[rag.annotation_prompt(r, F.col("text")).alias(r) for r in ("annotate", "correct", "unify")])


def article_rows(spark, d):
    return tree.articles(_read(spark, d, "events").select(F.col("event_id").alias("row_id"), F.col("props").alias("value")), "k", "v")


def newick_edges(spark, d):
    """The tree in Newick form read back: each node's name, and that of the node above it."""
    def walk(n: dict, up: str | None):
        yield (n["name"], up)
        for c in n["children"] or []:
            yield from walk(c, n["name"])

    roots = tree.nested(tree.nodes(layers(spark, d).members))
    read = json.loads(tree.tree_json([tree.parse_newick(tree.newick(roots))]))
    return spark.createDataFrame(list(walk(read, None)), "name string, above string")


def newick(spark, d):
    return spark.createDataFrame([(tree.newick(tree.nested(tree.nodes(layers(spark, d).members))),)], "newick string")


def _named(df: DataFrame, *names: str) -> DataFrame:
    """Node numbers as layer * 1000000 + cluster, which SQL states as well."""
    return df.withColumns({n: F.shiftright(n, 32) * 1_000_000 + F.col(n).bitwiseAND(F.lit((1 << 32) - 1)) for n in names})


def tree_ancestry(spark, d):
    return _named(tree.ancestry(tree.nodes(layers(spark, d).members)), "node", "ancestor")


def top_branch(spark, d):
    return _named(tree.top_branch(tree.nodes(layers(spark, d).members)), "node", "branch")


def tree_stats(spark, d):
    return tree.tree_stats(tree.nodes(layers(spark, d).members))


# ---- binary vectors of texts: retrieval and conversations


def _bits_of(docs: DataFrame, t: bpe.Tokenizer) -> DataFrame:
    return bpe.binary_embedding(docs, t).select("row_id", F.col("bits").alias("vector"))


def _beir_tables(spark, d, judgements: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, bpe.Tokenizer]:
    """Queries, corpus and, where asked for, judgements of a retrieval set: written as its files are, and read back."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("text"), "source")
    same = docs.select(F.col("_id").alias("corpus"), "source").join(docs.where("_id % 20 = 0").select(F.col("_id").alias("query"), "source"), "source").where("query <> corpus")
    judged = same.select("query", "corpus", (1 + F.col("corpus").cast("long") % 3).alias("score"))

    def write(folder: str) -> None:
        docs.select("_id", "text").write.json(f"{folder}/corpus")
        docs.where("_id % 20 = 0").select("_id", "text").write.json(f"{folder}/queries")
        if judgements:
            judged.write.csv(f"{folder}/qrels", sep="\t", header=True)

    t = _trained(spark, d)
    kept: dict[str, DataFrame] = {}

    def read(folder: str) -> DataFrame:
        for name in ("corpus", "queries"):
            kept[name] = cut(files.beir_vectors(files.beir(spark, f"{folder}/{name}"), t))
        return files.qrels(spark, f"{folder}/qrels") if judgements else judged.limit(0)

    qrels = through_files(spark, write, read)
    return kept["queries"], kept["corpus"], qrels, t


def beir_bpe_top(spark, d):
    queries, rows, _, t = _beir_tables(spark, d, judgements=False)
    near = knn.knn(queries, rows, 2, "yule_simd", len(t.tokens))
    named = near.join(rows.select("row_id", F.col("name").alias("found")), "row_id").join(queries.select(F.col("row_id").alias("query_id"), "name"), "query_id")
    return _round(_long(named.select("name", "rank", "found", F.when(~F.isnan("distance"), F.col("distance")).alias("distance")), "rank"), "distance")


def beir_bpe_accuracy(spark, d):
    queries, rows, qrels, t = _beir_tables(spark, d)
    found = evaluate.retrieval_accuracy(queries, rows, qrels, "yule_simd", len(t.tokens))
    return _round(found.withColumn("accuracy", F.when(~F.isnan("accuracy"), F.col("accuracy"))), "accuracy")


def rag_text_prompt(spark, d):
    t, docs = _trained(spark, d), corpus(spark, d)
    rows = _bits_of(docs, t).join(docs, "row_id")
    turns = _read(spark, d, "conversations").where("conv_id % 20 = 0")
    return rag.conversation_prompts(turns, rows, lambda asked_: _bits_of(asked_, t), PASSAGES, "yule_simd", len(t.tokens))


# ---- formats


def _listed(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


def vdb_file(spark, d):
    formats.register(spark)
    rows = vectors(spark, d).join(corpus(spark, d), "row_id", "left").select("row_id", "text", "vector")

    def write(folder: str) -> None:
        rows.repartition(1).write.format("vdb").mode("append").save(folder)

    got = through_files(spark, write, lambda folder: spark.read.format("vdb").option("rowsPerPartition", 100).load(folder))
    return got.select("row_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), *[F.element_at("vector", k).alias(f"x{k}") for k in (1, 2, 64)], F.size("vector").cast("long").alias("length"))


def vdb_binary_file(spark, d):
    formats.register(spark)
    rows = bits(spark, d).select("row_id", F.lit("").alias("text"), F.col("vector").alias("bits"))

    def write(folder: str) -> None:
        rows.repartition(1).write.format("vdb").mode("append").option("type", "binary").option("length", BITS).save(folder)

    got = through_files(spark, write, lambda folder: spark.read.format("vdb").option("type", "binary").load(folder))
    return got.select("row_id", distances.bit_string(F.col("bits"), BITS).alias("bits"))


def splitset_file(spark, d):
    formats.register(spark)
    members = layers(spark, d).members
    return _long(through_files(spark, lambda folder: formats.write_layers(members, f"{folder}/tree"), lambda folder: spark.read.format("splitset").load(folder)), "layer", "cluster", "pos")


def bpe_file(spark, d):
    formats.register(spark)
    t = _trained(spark, d)
    got = through_files(spark, lambda folder: formats.save_tokenizer(t, f"{folder}/tokenizer"), lambda folder: spark.read.format("bpe").load(f"{folder}/tokenizer"))
    return _long(got.select("id", F.lower(F.hex("token")).alias("token"), "left", "right"), "id", "left", "right")


def cluster_files(spark, d):
    members = layers(spark, d).members
    return _long(through_files(spark, lambda folder: formats.write_cluster_files(members, f"{folder}/"), lambda folder: files.cluster_folder(spark, folder)), "layer", "cluster")


def cluster_vdb_files(spark, d):
    formats.register(spark)
    members = layers(spark, d).members
    rows = vectors(spark, d).join(corpus(spark, d), "row_id", "left").select("row_id", "text", "vector")
    got = through_files(spark, lambda folder: formats.write_cluster_vectors(members, rows, f"{folder}/"), lambda folder: spark.read.format("vdb").load(folder))
    return got.groupBy(F.col("row_id").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("vector", 1)), 6).alias("sum_x"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))


def jsonl_file(spark, d):
    events = _read(spark, d, "events").orderBy("event_id").coalesce(1)
    return through_files(spark, lambda folder: events.select(F.col("props").alias("value")).write.text(f"{folder}/lines"), lambda folder: files.jsonl(spark, f"{folder}/lines", "k"))


def label_file(spark, d):
    rows = _read(spark, d, "embeddings").orderBy("vec_id").select(F.to_json(F.struct("label")).alias("value")).coalesce(1)
    return through_files(spark, lambda folder: rows.write.text(f"{folder}/lines"), lambda folder: files.labels(spark, f"{folder}/lines", "label"))


def tsv_file(spark, d):
    rows = vectors(spark, d).select(F.concat_ws("\t", F.col("row_id").cast("string"), F.transform("vector", lambda x: x.cast("string"))).alias("value"))
    got = through_files(spark, lambda folder: rows.write.text(f"{folder}/lines"), lambda folder: files.tsv_vectors(spark, f"{folder}/lines"))
    return got.select("name", F.size("vector").cast("long").alias("length"), F.element_at("vector", 1).alias("first"), F.element_at("vector", -1).alias("last"))


def whole_file_texts(spark, d):
    """Each benchmark text as a file of its own, read whole."""
    rows = _read(spark, d, "benchmark").select("item_id", F.col("text").alias("value"))

    def write(folder: str) -> None:
        rows.repartition(1).write.partitionBy("item_id").text(f"{folder}/texts")

    got = through_files(spark, write, lambda folder: files.whole_files(spark, f"{folder}/texts/*"))
    return got.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", r"\n\z", "").alias("text"))


# ---- lines, bits, requests


def distance_lines(spark, d):
    near = knn.pairwise(asked(vectors(spark, d)), "cosine", diagonal=False)
    return knn.format_pairs(near)


def embedding_lines(spark, d):
    return _long(files.vector_lines(asked(vectors(spark, d))), "pos")


def entry_lines(spark, d):
    rows = asked(vectors(spark, d)).join(corpus(spark, d), "row_id", "left").select("row_id", "vector", "text")
    return files.entry_lines(rows).select("row_id", F.md5(F.col("value").cast("binary")).alias("value_md5"))


def bit_operations(spark, d):
    rows = bits(spark, d)
    pair = rows.alias("a").join(rows.alias("b"), F.col("b.row_id") == F.col("a.row_id") + 1).select("a.row_id", F.col("a.vector").alias("a"), F.col("b.vector").alias("b"))
    a, b = F.col("a"), F.col("b")
    return pair.select("row_id", *[distances.bit_string(f(a, b), BITS).alias(n) for n, f in (("either", distances.bit_or), ("both", distances.bit_and))], distances.bit_string(distances.bit_set(a, 7), BITS).alias("with_7"), distances.bit_get(a, 7).alias("has_7"))


def sane_vectors(spark, d):
    rows = vectors(spark, d).withColumn("vector", F.when(F.col("row_id") % 3 == 0, F.transform("vector", lambda x: x * 0)).when(F.col("row_id") % 3 == 1, F.array().cast("array<double>")).otherwise(F.col("vector")))
    return rows.select("row_id", distances.is_sane(F.col("vector")).alias("sane"))


def server_messages(spark, d):
    """Requests, and answers of either kind decoded."""
    rows = _read(spark, d, "benchmark").select("item_id", "text")
    streamed = F.array(F.concat(F.lit("data:"), F.to_json(F.struct(F.left("text", F.lit(9)).alias("content")))), F.lit(""), F.concat(F.lit("data: "), F.to_json(F.struct(F.substr("text", F.lit(10)).alias("content")))))
    vector = F.concat(F.lit('[{"index":0,"embedding":[['), F.col("item_id").cast("string"), F.lit(".5,2]]}]"))
    answer = F.when(F.col("item_id") % 2 == 0, vector).otherwise(F.lit('{"error":{"message":"the input is too large to process"}}'))
    return rows.select(
        "item_id", F.get_json_object(rag.completion_request(F.col("text"), 7), "$.prompt").alias("prompt"), F.get_json_object(rag.embedding_request(F.col("text")), "$.content").alias("content"),
        rag.stream_content(streamed).alias("streamed"), rag.whole_content(F.to_json(F.struct(F.col("text").alias("content")))).alias("whole"),
        F.element_at(rag.decode_embedding(answer), 1).alias("x"), rag.too_large(answer).alias("too_large"),
    )


def embedding_retries(spark, d):
    """How much of each text the stand-in embedder accepts, by sevenths of its bytes left out."""
    got = clients.embed(corpus(spark, d), clients.hash_embedder(8, longest=2000))
    return _long(got.select("row_id", "retries", F.col("vector").isNotNull().alias("embedded")), "retries")


def stream_counts(spark, d):
    """Events as a stream, counted by window and kind."""
    events = _read(spark, d, "events")
    name = f"counts_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    counted = ingest.windowed_counts(stream, "ts", "event_type", "1 hour")
    counted.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", fresh_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("events"), F.max("n").alias("most"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_layers(spark, sf_dir)


_QUERIES: list[Query] = [
    vdb_details, vdb_entry_lookup, vdb_texts_by_index, cosine_pairwise, l2_pairwise, yule_pairwise, yule_simd_compat, knn_cosine, knn_l2, knn_yule, eps_neighbors, eps_degree,
    dbscan_cosine, dbscan_yule, dbscan_l2, dbscan_cosine_joins, dbscan_l2_joins, adaptive_layers, adaptive_layers_joins, layer_stats, layer_coverage, layer_edges, cluster_intersections, noise_rows,
    cluster_counts, cluster_members, cluster_sub_vdb, pca_means, pca_covariance, pca_eigenvalues, pca_projection, pca_subset, projection_lines, eigenvalue_lines, word_counts,
    first_occurrence_words, longest_word, byte_alphabet, bpe_best_pair, bpe_train, bpe_train_in_rounds, bpe_encode, bpe_binary_embedding, bpe_real_embedding, text_slices, text_slices_overlap,
    jsonl_extract, qrels_max_score, beir_accuracy, beir_bpe_top, beir_bpe_accuracy, label_ids, contingency, ari_score, nmi_score, corpus_stats, node_label_mix, rag_prompt, rag_text_prompt,
    chat_prompt, conversation_history, annotation_chunks, annotation_qc, annotation_prompts, label_unification, mapping_rows, mapping_with_labels, node_labels, significant_nodes, every_nth_leaf,
    article_rows, newick, newick_edges, tree_ancestry, top_branch, tree_stats, vdb_file, vdb_binary_file, splitset_file, bpe_file, cluster_files, cluster_vdb_files, jsonl_file, label_file,
    tsv_file, whole_file_texts, distance_lines, embedding_lines, entry_lines, bit_operations, sane_vectors, server_messages, embedding_retries, stream_counts,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in _QUERIES}


# ---- oracles


def _knn_sql(distance: str) -> str:
    return f"""WITH {_V} SELECT query_id, row_id, round(d, 6) + 0 AS distance, rank FROM (
SELECT a.i AS query_id, b.i AS row_id, {distance} AS d, row_number() OVER (PARTITION BY a.i ORDER BY {distance} NULLS LAST, b.i) AS rank
FROM v a JOIN v b ON a.i % 20 = 0) WHERE rank <= {K}"""


def _pairs_sql(distance: str) -> str:
    return f"WITH {_V} SELECT a.i, b.i AS j, round({distance}, 6) + 0 AS distance FROM v a JOIN v b ON a.i >= b.i"


def _dbscan_sql(distance: str, radius: float, rows: str = _V) -> str:
    return _labels_sql(distance, density.radii(radius, 0, 1), rows) + " SELECT row_id, label, cluster FROM lab"


_WORDS = "w AS (SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word FROM documents)"
_HEX = "regexp_extract_all(hex(encode(word)), '..')"
_SLICED = f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT doc_id, b, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents, ({{begins}}) t(b) WHERE b <= strlen(coalesce(text, ''))),
d AS MATERIALIZED (SELECT doc_id, b, n - b AS n, list_filter(range(n - b), lambda i: h[i + b + 1] = '20') AS spaces FROM h),
c(doc_id, b, k, start, done) AS (
  SELECT doc_id, b, 0, 0::BIGINT, NULL::BIGINT FROM d
  UNION ALL
  SELECT c.doc_id, c.b, k + 1, coalesce(list_max(list_filter(spaces, lambda x: x > start AND x <= start + {SLICE})), start + {SLICE}), start
  FROM c JOIN d USING (doc_id, b) WHERE start + {SLICE} < n - 1 AND n >= {SLICE}),
s AS (SELECT doc_id, b, k, start, lead(start) OVER (PARTITION BY doc_id, b ORDER BY k) AS nxt, n FROM c JOIN d USING (doc_id, b))
SELECT doc_id AS row_id, row_number() OVER (PARTITION BY doc_id ORDER BY b, k) - 1 AS pos, b + start AS start, coalesce(nxt, CASE WHEN n < {SLICE} THEN n ELSE n - 1 END) - start AS bytes FROM s
"""
#: The text, then its first slice at 7/8, 6/8, ... of its bytes, until one has at most 2000 bytes: at a space, or hard.
_RETRIES = """WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
r AS (SELECT doc_id, n, k, CASE WHEN k = 0 THEN n ELSE coalesce(list_max(list_filter(range(1, n - k * n // 8 + 1), lambda i: h[i + 1] = '20')), n - k * n // 8) END AS size FROM d, range(8) t(k) WHERE k = 0 OR n >= 8),
ok AS (SELECT doc_id, min(k) FILTER (size <= 2000) AS k, max(k) AS most FROM r GROUP BY doc_id)
SELECT doc_id AS row_id, coalesce(k, most) AS retries, k IS NOT NULL AS embedded FROM ok"""
_QRELS = "q AS (SELECT a.vec_id AS q, b.vec_id AS c, 1 + b.vec_id % 3 AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"
_CELLS = ", t AS (SELECT layer, cluster, truth, count(*) AS n FROM mem JOIN lbl USING (row_id) WHERE truth IS NOT NULL GROUP BY layer, cluster, truth)"
_MARGINS = _CELLS + """,
r AS (SELECT layer, cluster, sum(n) AS a FROM t GROUP BY layer, cluster), c AS (SELECT layer, truth, sum(n) AS b FROM t GROUP BY layer, truth),
s AS (SELECT layer, sum(n)::BIGINT AS docs FROM t GROUP BY layer),
rr AS (SELECT layer, sum(a * (a - 1) / 2) AS pa, -sum(a / docs * ln(a / docs)) AS ha, count(*) AS k FROM r JOIN s USING (layer) GROUP BY layer),
cc AS (SELECT layer, sum(b * (b - 1) / 2) AS pb, -sum(b / docs * ln(b / docs)) AS hb FROM c JOIN s USING (layer) GROUP BY layer),
tt AS (SELECT layer, sum(n * (n - 1) / 2) AS p, sum(n / docs * ln(n * docs / (a * b))) AS mi
  FROM t JOIN r USING (layer, cluster) JOIN c USING (layer, truth) JOIN s USING (layer) GROUP BY layer)"""
_UP = """,
up AS (
  SELECT layer * 1000000 + cluster AS node, layer * 1000000 + cluster AS ancestor, up_layer, up, 0 AS distance FROM node
  UNION ALL
  SELECT u.node, n.layer * 1000000 + n.cluster, n.up_layer, n.up, u.distance + 1 FROM up u JOIN node n ON n.layer = u.up_layer AND n.cluster = u.up)"""
_CHAT = """
WITH said AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {user} || coalesce(text, '') || {end} ELSE coalesce(text, '') END AS part
  FROM conversations WHERE role IN ('user', 'assistant'))
SELECT a.conv_id, a.turn, {start} || string_agg(b.part, '' ORDER BY b.turn, b.role, b.part) AS {name}
FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'user' GROUP BY a.conv_id, a.turn
"""


_LATEST = """last AS MATERIALIZED (SELECT conv_id, turn, coalesce(text, '') AS text FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, coalesce(text, '') DESC) AS r FROM conversations WHERE role = 'user' AND conv_id % 20 = 0) WHERE r = 1)"""


def _bpe(others: str = "SELECT NULL::VARCHAR WHERE false") -> str:
    """Merges learned one at a time, and the words of the documents and of other texts as their tokens.

    bw(doc_id, pos, word); al(hs, n): the alphabet; rule(k, a, b); enc(word, toks). A word is a string of a space and three
    digits for each token, so that a merge is a replacement from the left.
    """
    width = "lpad({}::VARCHAR, 3, '0')".format
    return f"""
bw AS MATERIALIZED (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '') AS ws FROM documents)),
al AS MATERIALIZED (SELECT list(h ORDER BY h) AS hs, count(*) AS n FROM (SELECT DISTINCT unnest({_HEX}) AS h FROM bw)),
ids AS MATERIALIZED (SELECT list_transform(range(256), lambda b: {width("coalesce(list_position(hs, printf('%02X', b)) - 1, n + 1)")}) AS x, {width("n")} AS fin FROM al),
ow AS (SELECT unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word FROM ({others}) o(text)),
uw AS (SELECT word, sum(n) AS n FROM (SELECT word, 1 AS n FROM bw UNION ALL SELECT word, 0 FROM ow) GROUP BY word),
train(k, word, n, t, a, b) AS (
  SELECT 0, word, n, ' ' || array_to_string(list_transform({_HEX}, lambda h: x[('0x' || h)::INT + 1]), ' ') || ' ' || fin, NULL::VARCHAR, NULL::VARCHAR FROM uw, ids
  UNION ALL
  SELECT k + 1, word, n, replace(t, ' ' || best.a || ' ' || best.b, ' ' || {width("((SELECT n FROM al) + 2 + k)")}), best.a, best.b
  FROM train, (SELECT a, b FROM (SELECT l[i] AS a, l[i + 1] AS b, n FROM (SELECT string_split(t[2:], ' ') AS l, n, unnest(range(1, len(t) // 4)) AS i FROM train))
    GROUP BY a, b HAVING sum(n) > 0 ORDER BY sum(n) DESC, b, a LIMIT 1) best
  WHERE k < {MERGES}),
rule AS MATERIALIZED (SELECT k - 1 AS k, any_value(a)::INT AS a, any_value(b)::INT AS b FROM train WHERE k > 0 GROUP BY k),
enc AS MATERIALIZED (SELECT word, list_transform(string_split(t[2:], ' '), lambda x: x::INT) AS toks FROM train WHERE k = (SELECT max(k) FROM train)),
total AS (SELECT (SELECT n FROM al) + 2 + (SELECT count(*) FROM rule) AS n),
spelled(k, l) AS (
  SELECT 0, list_concat(list_transform(hs, lambda h: lower(h)), ['{END_HEX}', '{UNKNOWN_HEX}']) FROM al
  UNION ALL SELECT s.k + 1, list_append(l, l[a + 1] || l[b + 1]) FROM spelled s JOIN rule r ON r.k = s.k),
spelling AS MATERIALIZED (SELECT l FROM spelled ORDER BY k DESC LIMIT 1),
bits AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(toks) AS tok FROM (SELECT DISTINCT doc_id, word FROM bw) JOIN enc USING (word))"""


def _nearest(asked_bits: str) -> str:
    """near(q, doc_id, d): the distance of each asked bit set (q, tok) to that of each document."""
    return f"""
qb AS MATERIALIZED ({asked_bits}),
sizes AS (SELECT documents.doc_id, count(tok) AS m FROM documents LEFT JOIN bits USING (doc_id) GROUP BY documents.doc_id),
qs AS (SELECT q, count(tok) AS m FROM qb GROUP BY q),
common AS (SELECT q, doc_id, count(*) AS c FROM qb JOIN bits USING (tok) GROUP BY q, doc_id),
cells AS (SELECT qs.q, s.doc_id, coalesce(c, 0) AS a, qs.m - coalesce(c, 0) AS b, s.m - coalesce(c, 0) AS e FROM qs, sizes s LEFT JOIN common ON common.q = qs.q AND common.doc_id = s.doc_id),
near AS (SELECT q, doc_id, (2 * b * e)::DOUBLE / nullif(a * ((SELECT n FROM total) - a - b - e) + b * e, 0) AS d FROM cells)"""


_BEIR = "WITH RECURSIVE " + _bpe() + "," + _nearest("SELECT doc_id AS q, tok FROM documents LEFT JOIN bits USING (doc_id) WHERE doc_id % 20 = 0") + """,
top AS (SELECT q, doc_id, d, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d NULLS LAST, doc_id::VARCHAR) AS rank FROM near) WHERE rank <= 2)"""
_RAG = "WITH RECURSIVE " + _LATEST + "," + _bpe("SELECT text FROM last") + "," + _nearest("""SELECT DISTINCT conv_id AS q, unnest(toks) AS tok FROM
  (SELECT conv_id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS word FROM last) JOIN enc USING (word) UNION ALL SELECT conv_id, NULL FROM last WHERE trim(text, ' ') = ''""")
_NAME = "CASE cluster % 3 WHEN 0 THEN 'field ' || cluster || '_' END"
_MAPPED = "'L' || layer || 'C' || cluster || 'N' || count(*) AS key, count(*) AS doc_count"
_NEWICK = _LAYERS + """,
nw(layer, cluster, s) AS (
  SELECT layer, cluster, 'L' || layer || 'C' || cluster || 'N' || n FROM node WHERE layer = 0
  UNION ALL
  SELECT p.layer, p.cluster, coalesce('(' || string_agg(k.s, ',' ORDER BY k.cluster) || ')', '') || any_value('L' || p.layer || 'C' || p.cluster || 'N' || p.n)
  FROM node p LEFT JOIN (SELECT c.up_layer, c.up, nw.cluster, nw.s FROM nw JOIN node c ON c.layer = nw.layer AND c.cluster = nw.cluster) k ON k.up_layer = p.layer AND k.up = p.cluster
  WHERE p.layer = (SELECT max(layer) + 1 FROM nw) GROUP BY p.layer, p.cluster)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def oracle_sql() -> dict[str, str]:
    return {
        "vdb_details": "SELECT 'double' AS type, max(len(embedding))::BIGINT AS vector_length, count(*) AS entries FROM embeddings",
        "vdb_entry_lookup": "SELECT vec_id AS row_id, k - 1 AS pos, round(embedding[k]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) r(k) WHERE vec_id % 20 = 0",
        "vdb_texts_by_index": "SELECT item_id AS pos, doc_id AS row_id, d.text FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * ((SELECT count(*) FROM documents) // (SELECT count(*) FROM benchmark)) + 1",
        "cosine_pairwise": _pairs_sql(_COS),
        "l2_pairwise": _pairs_sql(_L2),
        "yule_pairwise": _pairs_sql(_YULE),
        "yule_simd_compat": f"""WITH v AS (SELECT vec_id AS i, list_transform(range({distances.simd_bits(LONG_BITS)}), lambda k: CASE WHEN embedding[k % 64 + 1] > embedding[(k + 1 + 5 * (k // 64)) % 64 + 1] THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS b FROM embeddings)
SELECT a.i, b.i AS j, round({_yule(LONG_BITS)}, 6) + 0 AS distance FROM v a JOIN v b ON a.i >= b.i""",
        "knn_cosine": _knn_sql(_COS),
        "knn_l2": _knn_sql(_L2),
        "knn_yule": _knn_sql(_YULE),
        "eps_neighbors": f"WITH {_V} SELECT a.i, b.i AS j, round({_COS}, 6) + 0 AS distance FROM v a JOIN v b ON {_COS} <= {density.radii(COSINE_RADIUS, 0, 1)[0]!r}",
        "eps_degree": f"WITH {_V} SELECT a.i AS row_id, count(*) AS degree FROM v a JOIN v b ON {_COS} <= {density.radii(COSINE_RADIUS, 0, 1)[0]!r} GROUP BY a.i",
        "dbscan_cosine": _dbscan_sql(_COS, COSINE_RADIUS),
        "dbscan_yule": _dbscan_sql(_YULE, YULE_RADIUS),
        "dbscan_l2": _dbscan_sql(_PLANE_L2, PLANE_RADIUS, _PLANE),
        "dbscan_cosine_joins": _dbscan_sql(_COS, COSINE_RADIUS),
        "dbscan_l2_joins": _dbscan_sql(_PLANE_L2, PLANE_RADIUS, _PLANE),
        "adaptive_layers_joins": _LAYERS + "SELECT layer, row_id, label, cluster FROM mem",
        "adaptive_layers": _LAYERS + "SELECT layer, row_id, label, cluster FROM mem",
        "layer_stats": _LAYERS + "SELECT layer::BIGINT AS layer, step::BIGINT AS step, n AS clusters FROM acc",
        "layer_coverage": _LAYERS + "SELECT layer, count(*) AS covered, (SELECT count(*) FROM v) - count(*) AS noise, round(count(*) / (SELECT count(*) FROM v), 6) AS coverage FROM mem GROUP BY layer",
        "layer_edges": _LAYERS + "SELECT layer, cluster, child_layer, child, common FROM edge",
        "cluster_intersections": _LAYERS + "SELECT a.layer, a.cluster AS cluster_a, b.cluster AS cluster_b, count(*) AS common FROM mem a JOIN mem b ON a.row_id = b.row_id AND b.layer = a.layer + 1 GROUP BY ALL",
        "noise_rows": _LAYERS + "SELECT acc.layer::BIGINT AS layer, i AS row_id FROM acc, v WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.layer = acc.layer AND mem.row_id = v.i)",
        "cluster_counts": _LAYERS + "SELECT layer, count(DISTINCT cluster) AS clusters FROM mem GROUP BY layer",
        "cluster_members": _LAYERS + "SELECT layer, cluster, row_number() OVER (PARTITION BY layer, cluster ORDER BY row_id) - 1 AS pos, row_id FROM mem",
        "cluster_sub_vdb": _LAYERS + "SELECT layer, cluster, count(*) AS n, round(sum(e[1]), 5) AS sum_x, round(sum(e[2]), 5) AS sum_y FROM mem JOIN v ON v.i = mem.row_id GROUP BY layer, cluster",
        "pca_means": "SELECT k - 1 AS feature, round(avg(embedding[k]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) r(k) GROUP BY k",
        "pca_covariance": "SELECT a.k - 1 AS i, b.k - 1 AS j, round(covar_pop(embedding[a.k]::DOUBLE, embedding[b.k]::DOUBLE), 8) AS cov FROM embeddings, range(1, 65) a(k), range(1, 65) b(k) WHERE b.k <= a.k GROUP BY a.k, b.k",
        "pca_eigenvalues": f"WITH RECURSIVE {_axes(64)} SELECT (64 - k)::BIGINT AS k, round(lam, 8) AS eigenvalue FROM axes",
        "pca_projection": f"WITH RECURSIVE {_axes(DIMENSIONS)} SELECT vec_id AS row_id, (k - 1)::BIGINT AS pos, round(list_dot_product(embedding::DOUBLE[], v), 6) + 0 AS x FROM embeddings, axes",
        "pca_subset": f"WITH RECURSIVE {_axes(2)} SELECT vec_id AS row_id, (k - 1)::BIGINT AS pos, round(list_dot_product(embedding::DOUBLE[], v), 6) + 0 AS x FROM embeddings, axes",
        "projection_lines": f"WITH RECURSIVE {_PLANE} SELECT row_number() OVER (ORDER BY i) - 1 AS row_id, printf('%.6f', e[1]) || chr(9) || printf('%.6f', e[2]) AS value FROM v",
        "eigenvalue_lines": f"WITH RECURSIVE {_axes(64)} SELECT (64 - k)::BIGINT AS row_id, printf('%.6f', lam) AS value FROM axes",
        "bpe_train": f"WITH RECURSIVE {_bpe()} SELECT k::BIGINT AS rule_no, l[(SELECT n FROM al) + 2 + k + 1] AS token, a::BIGINT AS \"left\", b::BIGINT AS \"right\" FROM rule, spelling",
        "bpe_train_in_rounds": f"WITH RECURSIVE {_bpe()} SELECT k::BIGINT AS rule_no, l[(SELECT n FROM al) + 2 + k + 1] AS token, a::BIGINT AS \"left\", b::BIGINT AS \"right\" FROM rule, spelling",
        "bpe_encode": f"WITH RECURSIVE {_bpe()} SELECT d.doc_id AS row_id, coalesce(sum(len(toks)), 0)::BIGINT AS n, md5(coalesce(string_agg(array_to_string(toks, ' '), ' ' ORDER BY pos), '')) AS tokens_md5 FROM documents d LEFT JOIN bw ON bw.doc_id = d.doc_id LEFT JOIN enc USING (word) GROUP BY d.doc_id",
        "bpe_binary_embedding": f"WITH RECURSIVE {_bpe()} SELECT d.doc_id AS row_id, coalesce(string_agg(tok::VARCHAR, ' ' ORDER BY tok), '') AS bits FROM documents d LEFT JOIN bits USING (doc_id) GROUP BY d.doc_id",
        "bpe_real_embedding": f"WITH RECURSIVE {_bpe()} SELECT doc_id AS row_id, tok::BIGINT AS token, count(*) AS n FROM (SELECT doc_id, unnest(toks) AS tok FROM bw JOIN enc USING (word)) GROUP BY doc_id, tok",
        "bpe_file": f"WITH RECURSIVE {_bpe()} SELECT i::BIGINT AS id, l[i + 1] AS token, a::BIGINT AS \"left\", b::BIGINT AS \"right\" FROM (SELECT l, unnest(range(len(l))) AS i FROM spelling) LEFT JOIN rule ON rule.k = i - (SELECT n FROM al) - 2",
        "beir_bpe_top": _BEIR + " SELECT q::VARCHAR AS name, rank, doc_id::VARCHAR AS found, round(d, 6) + 0 AS distance FROM top",
        "beir_bpe_accuracy": _BEIR + """,
rel AS (SELECT a.doc_id AS q, b.doc_id AS c, 1 + b.doc_id % 3 AS score FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0),
best AS (SELECT coalesce(sum(m), 0)::BIGINT AS possible FROM (SELECT max(score) AS m FROM rel GROUP BY q)),
got AS (SELECT coalesce(sum(score), 0)::BIGINT AS reached FROM top x JOIN top y ON x.q = y.q AND x.rank = 1 AND y.rank = 2 JOIN rel ON rel.q = x.q AND rel.c = y.doc_id WHERE x.doc_id = x.q)
SELECT reached, possible, round(reached / nullif(possible, 0), 6) + 0 AS accuracy FROM got, best""",
        "rag_text_prompt": _RAG + f""",
body AS (SELECT q, string_agg({_quoted(rag.CONTEXT)} || rank || ':' || chr(10) || coalesce(text, '') || {_quoted(rag.CONTEXT_END)}, '' ORDER BY rank) AS body FROM
  (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d NULLS LAST, doc_id) AS rank FROM near) JOIN documents USING (doc_id) WHERE rank <= {PASSAGES} GROUP BY q),
said AS (SELECT c.conv_id, c.turn, c.role, CASE WHEN role = 'user' THEN {_quoted(rag.USER)} || coalesce(c.text, '') || {_quoted(rag.ASSISTANT)} ELSE coalesce(c.text, '') END AS part
  FROM conversations c JOIN last ON last.conv_id = c.conv_id AND c.turn <= last.turn WHERE c.role IN ('user', 'assistant'))
SELECT conv_id AS query_id, {_quoted(rag.SYSTEM + rag.WITH_CONTEXT)} || any_value(body) || string_agg(part, '' ORDER BY turn, role, part) AS prompt FROM said JOIN body ON q = conv_id GROUP BY conv_id""",
        "annotation_prompts": "SELECT item_id, " + ", ".join(f"{_quoted(a + b + c)} || text AS {n}" for n, a, b, c in (
            ("annotate", rag.NAMING_SYSTEM, rag.ANNOTATE, rag.NAMING_USER), ("correct", rag.MENDING_SYSTEM, rag.CORRECT, rag.MENDING_USER), ("unify", rag.MENDING_SYSTEM, rag.UNIFY, rag.MENDING_USER))) + " FROM benchmark",
        "label_unification": _LAYERS + f""",
chunk AS (SELECT layer, cluster, unnest(range(CASE WHEN n > {CHUNK} THEN ceil(3 * n / {CHUNK})::BIGINT ELSE 1 END)) AS c FROM size),
named AS (SELECT layer, cluster, count(*) AS chunks, min('field ' || c % 5) AS label, count(DISTINCT c % 5) AS names, string_agg(DISTINCT 'field ' || c % 5, chr(10) ORDER BY 'field ' || c % 5) AS all_ FROM chunk WHERE c % 4 <> 3 GROUP BY layer, cluster)
SELECT layer, cluster, chunks, CASE WHEN names = 1 THEN label END AS label, CASE WHEN names > 1 THEN {_quoted(rag.MENDING_SYSTEM + rag.UNIFY + rag.MENDING_USER)} || all_ END AS prompt FROM named""",
        "mapping_with_labels": _LAYERS + f" SELECT {_MAPPED}, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS article_ids, {_NAME} AS label FROM mem GROUP BY layer, cluster",
        "node_labels": _LAYERS + f""", known AS (SELECT {_MAPPED}, {_NAME} AS label FROM mem GROUP BY layer, cluster UNION ALL SELECT 'L99C0N1', 0, NULL),
named AS (SELECT *, coalesce(label, key) AS name FROM known)
SELECT key, doc_count, CASE WHEN label IS NOT NULL THEN rtrim(label, '_ ') END AS label, CASE WHEN length(name) > 5 THEN name[:5] || '...' ELSE name END AS short FROM named""",
        "significant_nodes": _LAYERS + f" SELECT layer, cluster, n AS doc_count, {_NAME} AS label FROM node WHERE cluster % 3 = 0 AND n >= 50 AND EXISTS (SELECT 1 FROM edge WHERE edge.layer = node.layer AND edge.cluster = node.cluster)",
        "every_nth_leaf": _LAYERS + " SELECT node FROM (SELECT layer * 1000000 + cluster AS node, row_number() OVER (ORDER BY layer, cluster) - 1 AS r FROM node WHERE NOT EXISTS (SELECT 1 FROM edge WHERE edge.layer = node.layer AND edge.cluster = node.cluster)) WHERE r % 3 = 0",
        "newick": _NEWICK + " SELECT CASE WHEN count(*) = 1 THEN any_value(s) ELSE '(' || string_agg(s, ',' ORDER BY layer, cluster) || ')' END || ';' AS newick FROM nw JOIN node USING (layer, cluster) WHERE up IS NULL",
        "newick_edges": _LAYERS + """, named AS (SELECT layer, cluster, up_layer, up, 'L' || layer || 'C' || cluster || 'N' || n AS name FROM node), roots AS (SELECT count(*) AS n FROM node WHERE up IS NULL)
SELECT c.name, coalesce(p.name, CASE WHEN (SELECT n FROM roots) > 1 THEN '' END) AS above FROM named c LEFT JOIN named p ON p.layer = c.up_layer AND p.cluster = c.up
UNION ALL SELECT '', NULL FROM roots WHERE n > 1""",
        "vdb_file": "SELECT vec_id AS row_id, md5(coalesce(text, '')) AS text_md5, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[64]::DOUBLE AS x64, len(embedding) AS length FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
        "vdb_binary_file": "SELECT vec_id AS row_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings",
        "splitset_file": _LAYERS + "SELECT layer, cluster, row_id, row_number() OVER (PARTITION BY layer, cluster ORDER BY row_id) - 1 AS pos FROM mem",
        "cluster_files": _LAYERS + "SELECT layer, cluster, row_id FROM mem",
        "cluster_vdb_files": _LAYERS + """, p AS (SELECT row_id, row_number() OVER (PARTITION BY layer, cluster ORDER BY row_id) - 1 AS pos FROM mem)
SELECT pos, count(*) AS n, round(sum(embedding[1]::DOUBLE), 6) AS sum_x, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM p JOIN embeddings ON vec_id = row_id LEFT JOIN documents ON doc_id = row_id GROUP BY pos""",
        "jsonl_file": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS row_id, json_extract_string(props, '$.k') AS text FROM events",
        "label_file": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label::VARCHAR AS label FROM embeddings",
        "tsv_file": "SELECT vec_id::VARCHAR AS name, len(embedding) AS length, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings",
        "whole_file_texts": "SELECT item_id, text FROM benchmark",
        "distance_lines": f"WITH {_V} SELECT a.i || ' ' || b.i || ' ' || printf('%.5E', {_COS}) AS value FROM v a JOIN v b ON a.i > b.i WHERE a.i % 20 = 0 AND b.i % 20 = 0",
        "embedding_lines": "SELECT vec_id AS row_id, k - 1 AS pos, printf('%10.8f', embedding[k]::DOUBLE) AS value FROM embeddings, range(1, 65) r(k) WHERE vec_id % 20 = 0",
        "entry_lines": """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: printf('% 12E ', x::DOUBLE)) AS f FROM embeddings WHERE vec_id % 20 = 0)
SELECT vec_id AS row_id, md5(array_to_string(list_transform(range(0, 64, 5), lambda i: array_to_string(f[i + 1 : i + 5], '')), chr(10)) || chr(10) || coalesce(text, '')) AS value_md5 FROM n LEFT JOIN documents ON doc_id = vec_id""",
        "bit_operations": """WITH v AS (SELECT vec_id AS i, embedding AS e FROM embeddings), p AS (SELECT a.i, a.e, b.e AS f FROM v a JOIN v b ON b.i = a.i + 1)
SELECT i AS row_id, array_to_string(list_transform(range(1, 65), lambda k: (e[k] > 0 OR f[k] > 0)::INT), '') AS either, array_to_string(list_transform(range(1, 65), lambda k: (e[k] > 0 AND f[k] > 0)::INT), '') AS both,
  array_to_string(list_transform(range(1, 65), lambda k: (e[k] > 0 OR k = 8)::INT), '') AS with_7, e[8] > 0 AS has_7 FROM p""",
        "sane_vectors": "SELECT vec_id AS row_id, vec_id % 3 = 2 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 AS sane FROM embeddings",
        "server_messages": "SELECT item_id, text AS prompt, text AS content, text AS streamed, text AS whole, CASE WHEN item_id % 2 = 0 THEN item_id + 0.5::DOUBLE END AS x, item_id % 2 = 1 AS too_large FROM benchmark",
        "embedding_retries": _RETRIES,
        "stream_counts": """SELECT event_type, count(*) AS windows, sum(n)::BIGINT AS events, max(n) AS most FROM (SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS w, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type""",
        "word_counts": f"WITH {_WORDS} SELECT word, count(*) AS n FROM w GROUP BY word",
        "first_occurrence_words": """WITH l AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM l) SELECT doc_id AS row_id, word, min(pos) AS first, count(*) AS n FROM w GROUP BY doc_id, word""",
        "longest_word": f"WITH {_WORDS} SELECT max(strlen(word))::BIGINT AS bytes FROM w",
        "byte_alphabet": f"WITH {_WORDS}, h AS (SELECT unnest({_HEX}) AS h FROM w) SELECT row_number() OVER (ORDER BY h) - 1 AS id, ('0x' || h)::BIGINT AS byte, count(*) AS n FROM h GROUP BY h",
        "bpe_best_pair": f"""WITH {_WORDS}, u AS (SELECT word, count(*) AS n FROM w GROUP BY word), h AS (SELECT {_HEX} AS h, n FROM u),
alphabet AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS id FROM (SELECT DISTINCT unnest(h) AS h FROM h)),
p AS (SELECT unnest(h) AS x, unnest(list_append(h[2:], 'end')) AS y, n FROM h),
i AS (SELECT a.id AS a, coalesce(b.id, (SELECT count(*) FROM alphabet)) AS b, n FROM p JOIN alphabet a ON a.h = x LEFT JOIN alphabet b ON b.h = y)
SELECT a, b, sum(n)::BIGINT AS n FROM i GROUP BY a, b ORDER BY 3 DESC, b, a LIMIT 1""",
        "text_slices": _SLICED.format(begins="VALUES (0::BIGINT)"),
        "text_slices_overlap": _SLICED.format(begins=f"VALUES (0::BIGINT), ({SLICE // 2}::BIGINT)"),
        "jsonl_extract": "SELECT event_id AS row_id, json_extract_string(props, '$.k') AS text FROM events",
        "qrels_max_score": f"WITH {_QRELS} SELECT q::VARCHAR AS query_id, max(score)::BIGINT AS best FROM q GROUP BY q",
        "beir_accuracy": f"""WITH {_V}, {_QRELS}, near AS (SELECT a.i AS q, b.i AS c, row_number() OVER (PARTITION BY a.i ORDER BY {_COS}, b.i) AS rank FROM v a JOIN v b ON a.i % 20 = 0),
two AS (SELECT q, max(c) FILTER (rank = 1) AS one, max(c) FILTER (rank = 2) AS two FROM near WHERE rank <= 2 GROUP BY q),
best AS (SELECT sum(m)::BIGINT AS possible FROM (SELECT max(score) AS m FROM q GROUP BY q)),
got AS (SELECT coalesce(sum(score), 0)::BIGINT AS reached FROM two JOIN q ON q.q = two.q AND q.c = two.two WHERE one = two.q)
SELECT reached, possible, round(reached / possible, 6) AS accuracy FROM got, best""",
        "label_ids": "SELECT label::BIGINT AS label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS id, min(vec_id) AS first FROM embeddings GROUP BY label",
        "contingency": _LAYERS + _CELLS + " SELECT layer, cluster, truth AS label, n FROM t",
        "ari_score": _LAYERS + _MARGINS + """ SELECT layer, docs, CASE WHEN k >= 2 THEN round(CASE WHEN (pa + pb) / 2 = pa * pb / (docs * (docs - 1) / 2) THEN 1.0
ELSE (p - pa * pb / (docs * (docs - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (docs * (docs - 1) / 2)) END, 6) END AS ari FROM s JOIN rr USING (layer) JOIN cc USING (layer) JOIN tt USING (layer)""",
        "nmi_score": _LAYERS + _MARGINS + " SELECT layer, docs, CASE WHEN k >= 2 THEN round(mi / ((ha + hb) / 2), 6) END AS nmi FROM s JOIN rr USING (layer) JOIN cc USING (layer) JOIN tt USING (layer)",
        "corpus_stats": r"WITH w AS (SELECT len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS n FROM documents) SELECT count(*) AS texts, round(avg(n), 6) AS mean_words, round(stddev_pop(n), 6) AS sd_words FROM w",
        "node_label_mix": _LAYERS + _CELLS + " SELECT layer, cluster, truth AS label, n, round(ln(1 + n) / max(ln(1 + n)) OVER (PARTITION BY layer), 6) AS intensity FROM t",
        "rag_prompt": f"""WITH {_V}, near AS (SELECT a.i AS q, b.i AS c, row_number() OVER (PARTITION BY a.i ORDER BY {_COS}, b.i) AS rank FROM v a JOIN v b ON a.i % 20 = 0),
body AS (SELECT q, string_agg('Context ' || rank || ':' || chr(10) || coalesce(text, '') || ' ' || chr(10) || ' ', '' ORDER BY rank) AS body FROM near LEFT JOIN documents ON doc_id = c WHERE rank <= 3 GROUP BY q)
SELECT item_id * 20 AS query_id, {_quoted(rag.SYSTEM + rag.WITH_CONTEXT)} || coalesce(body, '') || {_quoted(rag.USER)} || text || {_quoted(rag.ASSISTANT)} AS prompt FROM benchmark LEFT JOIN body ON q = item_id * 20""",
        "chat_prompt": _CHAT.format(user=_quoted(rag.USER), end=_quoted(rag.ANSWER), start=_quoted(rag.SYSTEM + rag.PLAIN), name="prompt"),
        "conversation_history": _CHAT.format(user=_quoted(rag.USER), end=_quoted(rag.ASSISTANT), start="''", name="history"),
        "annotation_chunks": _LAYERS + f" SELECT layer, cluster, unnest(range(CASE WHEN n > {CHUNK} THEN ceil(3 * n / {CHUNK})::BIGINT ELSE 1 END)) AS chunk, least(n, {CHUNK}) AS n FROM size",
        "annotation_qc": "SELECT conv_id, turn, b AS bad, CASE WHEN b THEN least(length(text), 20000) END AS n_correction FROM (SELECT *, coalesce(contains(rtrim(text), chr(10)) OR length(text) > 80, true) AS b FROM conversations)",
        "mapping_rows": _LAYERS + " SELECT 'L' || layer || 'C' || cluster || 'N' || count(*) AS key, count(*) AS doc_count, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS article_ids, NULL::VARCHAR AS label FROM mem GROUP BY layer, cluster",
        "article_rows": "SELECT event_id::VARCHAR AS id, coalesce(json_extract_string(props, '$.k'), '') AS title, coalesce(json_extract_string(props, '$.v'), '') AS content FROM events WHERE trim(props) <> ''",
        "tree_ancestry": _LAYERS + _UP + " SELECT node, ancestor, distance::BIGINT AS distance FROM up",
        "top_branch": _LAYERS + _UP + " SELECT node, arg_min(ancestor, n) AS branch FROM (SELECT *, -row_number() OVER (PARTITION BY node ORDER BY distance DESC) AS n FROM up) WHERE n >= -2 GROUP BY node",
        "tree_stats": _LAYERS + " SELECT count(*) AS nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM edge WHERE edge.layer = node.layer AND edge.cluster = node.cluster)) AS leaves, count(*) FILTER (up IS NULL) AS roots FROM node",
    }
