"""Operator 2: document fingerprints by Merkle trees, in DataFrame functions alone.

A text falls into sections (after blank lines), sections into paragraphs (after line ends), paragraphs into leaves (after
sentence ends, and every 80 characters of a long sentence); nothing is dropped at the cuts. Each leaf, paragraph, section
and the root has a SHA-256 digest over what is below it, so equal roots mean equal texts, and branches that differ show
where two texts differ.

A fingerprint is `root|section=paragraph:leaves,paragraph:leaves;section=...|leaf,leaf,...`: the root in full, 12 hex
digits of each branch, how many leaves each paragraph has, 10 hex digits of each leaf. Its likeness to another is 1 for
equal roots, else the Dice coefficient of the two sets of leaves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BRANCH, LEAF = 12, 10
#: Rows of a bucket of neighbouring ids, and the most buckets: with 100 TB of text a bucket of as many has 1.6 GB, and spills.
BUCKET_ROWS, MOST_BUCKETS = 2048, 65_536


def _parts(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern), lambda x: x != "")


def _leaves(paragraph: Column) -> Column:
    return F.flatten(F.transform(_parts(paragraph, r"(?<=[.!?]\s)"), lambda s: F.regexp_extract_all(s, F.lit(r"(?s).{1,80}"), F.lit(0))))


def tree(text: Column) -> Column:
    """The leaf digests by section and paragraph."""
    digest = lambda leaf: F.sha2(leaf.cast("binary"), 256)
    return F.transform(_parts(text, r"(?<=\n\s{0,8}\n)(?!\n)"), lambda s: F.transform(_parts(s, r"(?<=\n)"), lambda p: F.transform(_leaves(p), digest)))


def _branches(of: Column) -> Column:
    """Per section, its paragraphs' digests, leaf counts and leaf digests."""
    hash_ = lambda parts: F.sha2(F.concat_ws("", parts).cast("binary"), 256)
    return F.transform(of, lambda s: F.transform(s, lambda p: F.struct(hash_(p).alias("digest"), F.size(p).alias("n"), F.array_join(F.transform(p, lambda x: F.left(x, F.lit(LEAF))), ",").alias("leaves"))))


def _written(of: Column) -> Column:
    """The fingerprint of branches whose sections have digests."""
    root = F.sha2(F.concat_ws("", F.transform(of, lambda s: s["digest"])).cast("binary"), 256)
    paragraph = lambda p: F.concat(F.left(p["digest"], F.lit(BRANCH)), F.lit(":"), p["n"].cast("string"))
    section = lambda s: F.concat(F.left(s["digest"], F.lit(BRANCH)), F.lit("="), F.array_join(F.transform(s["paragraphs"], paragraph), ","))
    leaves = F.array_join(F.transform(of, lambda s: F.array_join(F.transform(s["paragraphs"], lambda p: p["leaves"]), ",")), ",")
    return F.concat(root, F.lit("|"), F.array_join(F.transform(of, section), ";"), F.lit("|"), leaves)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column; null counts as the empty text, whose tree has no branches."""
    made = df.withColumn("_branches", _branches(tree(F.coalesce(F.col(text), F.lit("")))))
    hashed = F.transform("_branches", lambda s: F.struct(F.sha2(F.concat_ws("", F.transform(s, lambda p: p["digest"])).cast("binary"), 256).alias("digest"), s.alias("paragraphs")))
    made = made.withColumn("_sections", hashed).withColumn(name, _written(F.col("_sections")))
    return made.drop("_branches", "_sections")


def _leaf_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.element_at(F.split(fingerprint, r"\|"), 3), ","), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the Dice coefficient of their leaves: 0 (nothing shared) to 1."""
    x, y = _leaf_set(a), _leaf_set(b)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.nullif(F.size(x) + F.size(y), F.lit(0)), F.lit(0.0)))


def differing_sections(a: Column, b: Column) -> Column:
    """The 0-based numbers of the sections of a whose digests b does not have: where a was edited."""
    digests = lambda f: F.transform(F.filter(F.split(F.element_at(F.split(f, r"\|"), 2), ";"), lambda s: s != ""), lambda s: F.substring_index(s, "=", 1))
    return F.filter(F.transform(digests(a), lambda s, i: F.when(~F.array_contains(digests(b), s), i)), lambda i: i.isNotNull())


def with_next(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with next_<column> of the row that follows in descending doc_id; after the last row comes the first.

    Buckets of neighbouring ids end at ids that occur; the row of such an id also stands, as a ghost, at the end of the
    bucket above, and that of the largest id at the end of the lowest. So each bucket knows every successor, and a row is
    shuffled once. Null ids come last; rows of equal ids follow one another by their text's hash and text.
    """
    lowest = -(1 << 63)
    keyed = df.withColumn("_id", F.coalesce("doc_id", F.lit(lowest)))
    n = keyed.count()
    if not n:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    buckets = max(1, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)))
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    shares = listed([k / buckets for k in range(1, buckets)] or [0.5], "double")
    found = keyed.agg(F.percentile_approx("_id", shares, 10 * buckets).alias("p"), F.max("_id").alias("top")).first()
    ends = sorted({*(found.p if buckets > 1 else []), found.top})
    step = max(1, math.isqrt(len(ends)))
    bounds, coarse = listed(ends, "long"), listed(ends[step - 1 :: step], "long")
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("_id")))
    at = keyed.withColumn("_coarse", below(coarse))
    at = at.withColumn("_bucket", F.col("_coarse") * step + below(F.slice(bounds, F.col("_coarse") * step + 1, step)))
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.pmod(F.col("_bucket") + 1, F.lit(len(ends))).cast("int").alias("bucket"), F.lit(1).alias("ghost"))
    placed = at.withColumn("_at", F.explode(F.when(F.element_at(bounds, F.col("_bucket") + 1) == F.col("_id"), F.array(own, ghost)).otherwise(F.array(own))))
    order = Window.partitionBy("_at.bucket").orderBy("_at.ghost", F.desc("_id"), F.xxhash64("text"), "text")
    return placed.select(*df.columns, "_at", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).where("_at.ghost = 0").drop("_at")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next document
    in descending doc_id. Null text counts as empty; of one row alone the next is itself; repeated rows follow one
    another; an empty table gives no rows; other columns are not read. Texts of any length are hashed whole, and have as
    many leaves as they need.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(with_fingerprint(slim, "text", "fingerprint"), ["text", "fingerprint"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = near.withColumn("n_chars", F.length("text").cast("long")).withColumn("_edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    made = with_fingerprint(edited.drop("text", "next_text"), "_edited", "edited_fingerprint")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
