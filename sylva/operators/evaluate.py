"""Scores: retrieval against relevance judgements, and clusters against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators.knn import knn


def qrels_max(qrels: DataFrame) -> DataFrame:
    """query_id, best: the highest score of each question, 0 at least."""
    return qrels.groupBy("query_id").agg(F.greatest(F.max("score"), F.lit(0)).alias("best"))


def retrieval_accuracy(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, metric: str = "yule", bits: int | None = None) -> DataFrame:
    """reached, possible, accuracy for queries and corpus of (row_id, name, vector) and qrels of (query_id, corpus_id, score).

    A query with judgements adds its highest score to what is possible. If the corpus row nearest to it has its own name,
    it reaches the scores of the judgements that name the second nearest. 0/0 is NaN.
    """
    near = knn(queries, corpus, 2, metric, bits)
    named = near.join(corpus.select("row_id", F.col("name").alias("found")), "row_id").join(queries.select(F.col("row_id").alias("query_id"), "name"), "query_id")
    two = named.groupBy("query_id", "name").agg(F.max(F.when(F.col("rank") == 1, F.col("found"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col("found"))).alias("second"))
    possible = queries.select("name").join(qrels_max(qrels), F.col("name") == F.col("query_id")).agg(F.sum("best").alias("possible"))
    got = two.where("first = name").join(qrels.select(F.col("query_id").alias("q"), "corpus_id", "score"), (F.col("name") == F.col("q")) & (F.col("second") == F.col("corpus_id"))).agg(F.sum("score").alias("reached"))
    both = possible.join(got).select(F.coalesce("reached", F.lit(0)).cast("long").alias("reached"), F.coalesce("possible", F.lit(0)).cast("long").alias("possible"))
    return both.withColumn("accuracy", F.when(F.col("possible") == 0, F.lit(float("nan"))).otherwise(F.col("reached") / F.col("possible")))


def contingency(members: DataFrame, labels: DataFrame) -> DataFrame:
    """layer, cluster, label, n over covered rows with a label."""
    return members.join(labels, "row_id").groupBy("layer", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def cluster_scores(table: DataFrame) -> DataFrame:
    """layer, docs, ari, nmi from a contingency table; NaN where there are fewer than two clusters.

    Adjusted Rand index and normalised mutual information (arithmetic mean of the entropies, natural logarithm).
    """
    rows = table.groupBy("layer", "cluster").agg(F.sum("n").alias("a"))
    columns = table.groupBy("layer", "label").agg(F.sum("n").alias("b"))
    total = table.groupBy("layer").agg(F.sum("n").alias("docs"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    plogp = lambda c: F.col(c) / F.col("docs") * F.log(F.col(c) / F.col("docs"))
    each = table.join(rows, ["layer", "cluster"]).join(columns, ["layer", "label"]).join(total, "layer")
    mutual = F.col("n") / F.col("docs") * (F.log(F.col("n").cast("double")) + F.log(F.col("docs").cast("double")) - F.log(F.col("a").cast("double")) - F.log(F.col("b").cast("double")))
    cells = each.groupBy("layer").agg(F.sum(pairs("n")).alias("same"), F.sum(mutual).alias("mi"))
    left = rows.join(total, "layer").groupBy("layer").agg(F.sum(pairs("a")).alias("row_pairs"), (-F.sum(plogp("a"))).alias("h_rows"), F.count(F.lit(1)).alias("clusters"))
    right = columns.join(total, "layer").groupBy("layer").agg(F.sum(pairs("b")).alias("column_pairs"), (-F.sum(plogp("b"))).alias("h_columns"))
    known = total.join(cells, "layer").join(left, "layer").join(right, "layer")
    all_pairs = F.greatest(pairs("docs"), F.lit(1.0))
    expected = F.col("row_pairs") * F.col("column_pairs") / all_pairs
    most = (F.col("row_pairs") + F.col("column_pairs")) / 2
    ari = F.when(most == expected, F.lit(1.0)).otherwise((F.col("same") - expected) / F.nullif(most - expected, F.lit(0.0)))
    mean = (F.col("h_rows") + F.col("h_columns")) / 2
    nmi = F.when(F.abs("mi") < 1e-15, F.lit(0.0)).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0)))
    few = F.col("clusters") < 2
    return known.select("layer", "docs", F.when(few, F.lit(float("nan"))).otherwise(ari).alias("ari"), F.when(few, F.lit(float("nan"))).otherwise(nmi).alias("nmi"))
