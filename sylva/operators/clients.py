"""Clients of embedding and completion servers, one connection a task at a time, with an offline stand-in."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from urllib.error import HTTPError
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.text import slices_of
from sylva.session import ship

#: Shorter beginnings tried after a refusal: the text less r eighths.
RETRIES = 7


def post(url: str, body: dict, timeout: float = 600) -> bytes:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return answer.read()


def server_embedder(host: str, port: int) -> Callable[[str], list[float] | None]:
    """Embeds one text by POST /embedding; None where the server calls it too large."""

    def embed(text: str) -> list[float] | None:
        try:
            got = json.loads(post(f"http://{host}:{port}/embedding", {"content": text}))
        except HTTPError as e:
            got = json.loads(e.read())
        if isinstance(got, list):
            return got[0]["embedding"][0]
        if "input is too large" in str(got.get("error", {}).get("message", "")):
            return None
        raise ValueError(f"unexpected answer: {str(got)[:200]}")

    return embed


def hash_embedder(dims: int = 32, longest: int | None = None) -> Callable[[str], list[float] | None]:
    """A deterministic stand-in: sums of hashed word vectors; None for texts of more than `longest` bytes."""

    def embed(text: str) -> list[float] | None:
        if longest is not None and len(text.encode()) > longest:
            return None
        out = np.zeros(dims)
        for w in text.lower().split() or [""]:
            out += np.frombuffer(hashlib.shake_128(w.encode()).digest(dims), np.int8) / 128
        return out.tolist()

    return embed


def embed(docs: DataFrame, embedder: Callable[[str], list[float] | None]) -> DataFrame:
    """row_id, text, vector, retries for docs (row_id, text).

    A text that is too large is tried again by its first slice of 7/8, 6/8, ... 1/8 of its bytes; after that the vector is
    null. The text stays whole.
    """
    ship(docs.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, vectors, tries = batch.column("text").to_pylist(), [], []
            for text in texts:
                data, vector, r = (text or "").encode("utf-8", "replace"), embedder(text or ""), 0
                while vector is None and r < RETRIES and len(data) >= 8:
                    r += 1
                    vector = embedder(slices_of(data, len(data) - r * len(data) // 8)[0].decode("utf-8", "replace"))
                vectors.append(vector)
                tries.append(r)
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array(tries, pa.int32())], ["row_id", "text", "vector", "retries"])

    return docs.select(F.col("row_id").cast("long"), "text").mapInArrow(run, "row_id long, text string, vector array<double>, retries int")


def server_completer(host: str, port: int, n_tokens: int, stream: bool = True) -> Callable[[str], str]:
    """Completes one prompt by a POST /completion, streamed or in one piece."""

    def complete(prompt: str) -> str:
        raw = post(f"http://{host}:{port}/completion", {"prompt": prompt, "n_predict": n_tokens, "stream": stream})
        if not stream:
            return json.loads(raw).get("content", "")
        events = (json.loads(line[5:]) for line in raw.decode().splitlines() if line.startswith("data:"))
        return "".join(e.get("content", "") for e in events)

    return complete


def complete(prompts: DataFrame, completer: Callable[[str], str]) -> DataFrame:
    """query_id, answer for prompts (query_id, prompt)."""
    ship(prompts.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array([completer(p or "") for p in batch.column("prompt").to_pylist()], pa.string())], ["query_id", "answer"])

    return prompts.select(F.col("query_id").cast("long"), "prompt").mapInArrow(run, "query_id long, answer string")
