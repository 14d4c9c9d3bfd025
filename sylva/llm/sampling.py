"""Bounded training samples: ids are chosen by hash from the labels alone, then only their texts are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import held_out

#: Bounds of any training sample: label values (the most frequent ones), rows over all of them, and bytes of text.
CLASSES, ROWS, BYTES = 256, 25_600, 256 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: str) -> tuple[list[tuple[str, object]], dict[object, int]]:
    """Up to per_class whole texts of each label value, and how often each value occurs among all training rows.

    Rows of the held-out fold, null labels, null ids and null texts are left out. The ids of a class with the smallest
    seeded hashes are taken, so reruns agree; an id stands for one text, the smallest where rows share it. CLASSES, ROWS and
    BYTES bound the sample whatever the tables hold: of more classes the most frequent are learned, each class has an
    equal share of the rows, and a class stops before the text that would go beyond its share of the bytes.

    The hashes are compared with a bound that so many ids of a class are expected to pass, so that no class is sorted; in
    the rare case that too few do, the bound is raised.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().orderBy(F.desc("count"), "y").limit(CLASSES).collect()}
    if not counts:
        return [], {}
    spark, each = docs.sparkSession, max(1, min(per_class, ROWS // len(counts)))
    wanted = {y: min(each, n) for y, n in counts.items()}
    kind = known.schema["y"].dataType.simpleString()
    hashed = known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    order, spare = Window.partitionBy("y").orderBy("h", "doc_id"), 1.25
    while True:
        bounds = [(y, -(1 << 63) + min((1 << 64) - 1, int((1 << 64) * min(1.0, (spare * w + 64) / counts[y]))), w) for y, w in wanted.items()]
        bounds = spark.createDataFrame(bounds, f"y {kind}, bound long, wanted int")
        passed = hashed.join(F.broadcast(bounds), "y").where("h <= bound")
        ids = passed.withColumn("n", F.row_number().over(order)).where("n <= wanted").select("doc_id", "y").collect()
        if len(ids) == sum(wanted.values()):
            break
        spare *= 4
    chosen = spark.createDataFrame(ids, known.schema)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    before = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("y").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id"))
    rows = texts.withColumn("bytes", before).where(F.col("bytes") <= BYTES // len(counts)).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").collect()
    return [(r.text, r.y) for r in rows], counts
