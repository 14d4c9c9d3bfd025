"""Text sources and sinks: JSON lines, whole files, retrieval corpora, judgements, tables, cluster folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.operators.bpe import binary_embedding
from sylva.operators.tree import CLUSTER_FILE
from sylva.session import numbered


def lines(spark: SparkSession, path: str) -> DataFrame:
    """row_id, value: every line, numbered from 0 by file name and place in it.

    Only the line counts of the file blocks meet in one place, to give each block its first number.
    """
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    blocks = at.groupBy("file", "start").agg(F.count(F.lit(1)).alias("count"), F.min("n").alias("low"))
    before = F.sum("count").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "start", "low", F.coalesce(before, F.lit(0)).alias("before"))
    return at.join(F.broadcast(blocks), ["file", "start"]).select((F.col("before") + F.col("n") - F.col("low")).alias("row_id"), "value")


def jsonl(spark: SparkSession, path: str, key: str) -> DataFrame:
    """row_id, text: one key of each line; values that are not strings as their JSON; null where the key is missing."""
    return lines(spark, path).select("row_id", F.get_json_object("value", f"$['{key}']").alias("text"))


def labels(spark: SparkSession, path: str, key: str) -> DataFrame:
    """row_id, label of each line that is not blank; a missing key is an error."""
    found = lines(spark, path).where(F.trim("value") != "")
    value = F.get_json_object("value", f"$['{key}']")
    return found.select("row_id", F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"no {key} in line "), F.col("row_id").cast("string")))).alias("label"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def beir(spark: SparkSession, path: str) -> DataFrame:
    """name, text of a retrieval corpus or its queries."""
    return spark.read.schema("_id string, text string").json(path).select(F.col("_id").alias("name"), "text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score of a tab-separated file with a header."""
    return spark.read.schema("query_id string, corpus_id string, score int").csv(path, sep="\t", header=True)


def qrels_by_query(judged: DataFrame) -> DataFrame:
    """query_id, answers: (corpus_id, score) of each question."""
    return judged.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("corpus_id", "score"))).alias("answers"))


def tsv_vectors(spark: SparkSession, path: str) -> DataFrame:
    """name, vector of lines of a name and tab-separated numbers."""
    part = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(part[0].alias("name"), F.transform(F.slice(part, F.lit(2), F.size(part) - 1), lambda x: x.cast("double")).alias("vector"))


def cluster_folder(spark: SparkSession, path: str) -> DataFrame:
    """layer, cluster, row_id of files named L<layer>-C-<cluster> with a row id a line; a row twice in a layer is an error."""
    name = F.regexp_extract(F.col("_metadata.file_path"), CLUSTER_FILE, 0)
    found = spark.read.text(path).select(name.alias("name"), F.trim("value").alias("value")).where("name <> '' and value <> ''")
    rows = found.select(*[F.regexp_extract("name", CLUSTER_FILE, g).cast("int").alias(c) for g, c in ((1, "layer"), (2, "cluster"))], F.col("value").cast("long").alias("row_id"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("layer", "row_id")) > 1
    message = F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(" stands twice in layer "), F.col("layer").cast("string"))
    return rows.withColumn("_twice", twice).select(F.when(F.col("_twice"), F.raise_error(message).cast("int")).otherwise(F.col("layer")).alias("layer"), "cluster", "row_id")


# ---- sinks


def projection_lines(projected: DataFrame) -> DataFrame:
    """Tab-separated components with six decimals, in order of row_id."""
    return projected.orderBy("row_id").select(F.array_join(F.transform("pc", lambda x: F.format_string("%f", x)), "\t").alias("value"))


def eigenvalue_lines(values: DataFrame) -> DataFrame:
    """All eigenvalues of (k, eigenvalue) in ascending order, one a line, with six decimals."""
    return values.orderBy("k").select(F.format_string("%f", "eigenvalue").alias("value"))


def beir_vectors(lines: DataFrame, tokenizer) -> DataFrame:
    """row_id, name, vector (set positions) of the texts of a retrieval corpus (name, text); row_id follows the name."""
    rows = numbered(lines, ["name"], "row_id")
    bits = binary_embedding(rows, tokenizer)
    return bits.join(rows.select("row_id", "name"), "row_id").select("row_id", "name", F.col("bits").alias("vector"))


def vector_lines(rows: DataFrame) -> DataFrame:
    """One component a line, as %10.8f."""
    return rows.select("row_id", F.posexplode("vector").alias("pos", "x")).select("row_id", "pos", F.format_string("%10.8f", "x").alias("value"))


def entry_lines(rows: DataFrame) -> DataFrame:
    """row_id, value: five components a line in scientific notation, and the text."""
    number = F.transform("vector", lambda x: F.format_string("% 12E ", x))
    per = F.transform(F.sequence(F.lit(0), F.floor((F.size("vector") - 1) / 5).cast("int")), lambda i: F.array_join(F.slice(number, i * 5 + 1, F.lit(5)), ""))
    return rows.select("row_id", F.concat_ws("\n", F.when(F.size("vector") > 0, per).otherwise(F.array().cast("array<string>")), F.coalesce("text", F.lit(""))).alias("value"))


def details(rows: DataFrame, kind: str = "double") -> DataFrame:
    """type, vector_length, entries."""
    return rows.agg(F.lit(kind).alias("type"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("vector_length"), F.count(F.lit(1)).alias("entries"))
