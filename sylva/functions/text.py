"""Words and slices of texts. Slices count bytes of UTF-8 and may split a character, which then decodes to U+FFFD."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylva.session import numbered, ship


def words(text: Column) -> Column:
    """Words between U+0020 alone: line ends and tabs stay inside."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts; counted before the shuffle in each task."""
    return docs.select(F.explode(words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_list(docs: DataFrame) -> DataFrame:
    """row_id, word, first (position of its first occurrence), n: the distinct words of each text."""
    each = docs.select("row_id", F.posexplode(words(F.col("text"))).alias("pos", "word"))
    return each.groupBy("row_id", "word").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n"))


def positions(docs: DataFrame) -> DataFrame:
    """row_id, words (distinct, by first occurrence), positions (of each word of the text in that list)."""
    all_ = words(F.col("text"))
    return docs.select("row_id", all_.alias("_all")).select("row_id", F.array_distinct("_all").alias("words"), F.transform("_all", lambda w: F.array_position(F.array_distinct("_all"), w) - 1).alias("positions"))


def longest_word(docs: DataFrame) -> DataFrame:
    """bytes of the longest word."""
    return docs.select(F.explode(words(F.col("text"))).alias("w")).agg(F.max(F.octet_length("w")).alias("bytes"))


def slices_of(data: bytes, size: int, drop_last_byte: bool = True) -> list[bytes]:
    """Cut at the last space at or before each multiple of size from the previous cut, or hard where there is none.

    A text shorter than size is one slice. Otherwise the last slice lacks the last byte, unless drop_last_byte is false.
    """
    if size <= 0:
        raise ValueError("slices have at least one byte")
    n = len(data)
    if n < size:
        return [data]
    out, last, at = [], 0, size
    while at < n - 1:
        space = data.rfind(b" ", last + 1, at + 1)
        end = space if space > last else last + size
        out.append(data[last:end])
        last, at = end, end + size
    out.append(data[last : n - 1 if drop_last_byte else n])
    return out


def slices(docs: DataFrame, size: int, overlap: bool = False, drop_last_byte: bool = True) -> DataFrame:
    """row_id, pos, start, bytes, slice; with overlap, the slices of the text after its first size / 2 bytes follow.

    A text of less than size / 2 bytes has nothing after them: its plain slice stands alone. A size below one is an error.
    Null text is one empty slice.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, pos, start, out = [], [], [], []
            for row, text in zip(batch.column("row_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                first = len(pos)
                for begin in (0, size // 2) if overlap and size // 2 <= len(data) else (0,):
                    for s in slices_of(data[begin:], size, drop_last_byte):
                        ids.append(row)
                        pos.append(len(pos) - first)
                        start.append(begin)
                        out.append(s)
                        begin += len(s)
            arrays = [pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(start, pa.int64()), pa.array([len(s) for s in out], pa.int64()), pa.array([s.decode("utf-8", "replace") for s in out], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row_id", "pos", "start", "bytes", "slice"])

    return docs.select(F.col("row_id").cast("long"), "text").mapInArrow(run, "row_id long, pos int, start long, bytes long, slice string")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """texts, mean_words, sd_words (population) over white-space words."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    return docs.agg(F.count(F.lit(1)).alias("texts"), F.avg(n).alias("mean_words"), F.stddev_pop(n).alias("sd_words"))


def dense_ids(values: DataFrame, column: str) -> DataFrame:
    """column, id: distinct values numbered by their first row_id, from 0."""
    return numbered(values.groupBy(column).agg(F.min("row_id").alias("first")), ["first"], "id").select(column, "id", "first")
