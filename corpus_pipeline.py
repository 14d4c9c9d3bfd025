"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read
again. All but the last return the columns of documents. Columns of any name come through; rows are never told apart by
their ids alone, and an empty table goes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import langid, minhash, mixing, packing, subword
from sylva.session import fresh_folder, remove


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is found; `und` and ambiguous ones go. The model learns from these documents.

    Null, empty and letterless texts go; repeated rows go or stay together; null ids, and null languages, do not teach.
    """
    return langid.filter_known(docs, langid.fit(docs))


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents predicted to be of quality; the model learns from these documents' labels.

    Null texts are scored as empty ones; a score at the threshold stays; repeated rows go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return subword.filter_good(docs, subword.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near-duplicates.

    Null, empty and white texts and null ids stay; rows that share an id go by their texts; of equal rows one stays.
    """
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; of a last copy taken in part, its first words alone.

    Null sources are one source; null and empty texts have no words and are not taken; repeated rows are mixed each by itself.
    """
    return mixing.apply_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens.

    Null texts count as empty; null ids stay null; repeated rows are packed each by itself.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can state neither the trained models nor the samples; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder and removed once it is used."""
    folder, before = fresh_folder(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        now = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        docs = spark.read.parquet(now)
        if before:
            remove(spark, before)
        before = now
    return docs
