"""The queries opN_<name> over the driver tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylva.llm import langid, merkle, minhash, mixing, packing, subword, token_counts, toxicity, vectors, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": minhash.query,
        "op2_merkle_fingerprint": merkle.query,
        "op3_hilbert_packing": packing.query,
        "op4_quality": subword.query,
        "op5_toxicity": toxicity.query,
        "op6_token_counts": token_counts.query,
        "op7_language_id": langid.query,
        "op8_embedding_dedup": vectors.query,
        "op9_mixing": mixing.query,
        "op10_warc": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_embedding_dedup": vectors.SQL, "op9_mixing": mixing.SQL, "op10_warc": warc.SQL}
