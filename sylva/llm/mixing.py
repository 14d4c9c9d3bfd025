"""Operator 9: mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

Equal-token blocks go to the sources one at a time, each to the highest quotient target / (2 * blocks so far + 1); the
blocks of a source go to its shards in the same way, by shard size. Only the quotients near the outcome are made: a
source's blocks lie within (number of sources) / (2 * blocks) of its exact share, one block more or less. A shard's documents
stand in seeded order; whole passes over the shard and then its first blocks make up the quota.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.llm.common import partitions_for
from sylva.session import cut, give_back

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Documents of a shard; a source of more has several, so that no source is one task.
SHARD_ROWS = 20_000
#: Tokens of a block, at most; fewer where that would make fewer than LEAST_BLOCKS blocks.
BLOCK_TOKENS, LEAST_BLOCKS = 512, 10_000
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame) -> DataFrame:
    """sources (key, source, source_size, ...) with rank, weight and target.

    All sizes are shared by weight; a target stops at REPEATS times its source's size and the excess is shared again. In
    order of cap per weight, the level is the largest (total - caps before) / (weights from here on).
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("long"))
    ranked = ranked.withColumn("cap", REPEATS * F.col("source_size")).withColumn("total", F.sum("source_size").over(everything))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).drop("level")


def apportion(df: DataFrame, groups: list[str], share: str, seats: str, tie: str, name: str) -> DataFrame:
    """df with the seats that highest quotients give each row of a group; rows of no share get none.

    `seats` is the same throughout a group. Ties go to the smallest `tie`.
    """
    group = Window.partitionBy(*groups)
    exact = F.when(F.col("_all") > 0, F.col(seats) * (F.col(share) / F.col("_all"))).otherwise(0.0)
    slack = F.ceil(F.when(F.col(seats) > 0, F.col("_exact") * F.col("_n") / (2 * F.col(seats))).otherwise(0.0)) + 1
    known = df.withColumn("_all", F.sum(share).over(group)).withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_exact", exact)
    known = known.withColumn("_base", F.greatest(F.lit(0), F.floor("_exact") - slack).cast("long")).withColumn("_more", F.when(F.col(share) > 0, F.floor("_exact") + slack - F.col("_base")).otherwise(0).cast("long"))
    known = known.withColumn("_left", F.col(seats) - F.sum("_base").over(group))
    tried = known.where("_more > 0").select(*groups, tie, "_left", share, F.explode(F.sequence(F.col("_base"), F.col("_base") + F.col("_more") - 1)).alias("_k"))
    best = Window.partitionBy(*groups).orderBy(F.desc(F.col(share) / (2 * F.col("_k") + 1)), tie)
    won = tried.withColumn("_rank", F.row_number().over(best)).where("_rank <= _left").groupBy(*groups, tie).agg(F.count(F.lit(1)).alias("_won"))
    out = known.join(won, [*groups, tie], "left").withColumn(name, F.col("_base") + F.coalesce("_won", F.lit(0)))
    return out.drop("_all", "_n", "_exact", "_base", "_more", "_left", "_won")


def mix(docs: DataFrame, shard_rows: int = SHARD_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, source and the columns to carry, for each row of docs (doc_id, text, source, ...).

    taken counts words with repeats: a multiple of the size, and part of it at the last block. Null text has size 0;
    null sources are one source, ranked last; repeated rows are documents of their own; an empty table, or one without
    words, takes nothing; other columns are not read. Texts of any length are counted whole. A document's place in the mix
    comes from its id and its text, so null or repeated ids are dealt over all shards.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    slim = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), *carry)
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest").cast("binary"))
    slim = cut(slim.withColumn("key", key).withColumn("order", order).drop("digest"))
    sources = slim.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TOKENS), F.expr(f"total div {LEAST_BLOCKS}"))).cast("long")
    plan = water_fill(sources).withColumn("block", block).withColumn("seats", F.expr("total div block")).withColumn("all", F.lit(0))
    plan = apportion(plan, ["all"], "target", "seats", "rank", "quota").withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("rows") / shard_rows)).cast("long"))
    plan = cut(plan.select("key", "source_size", "target", "block", "quota", "shards"))

    dealt = slim.join(plan, "key").withColumn("shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    shards = apportion(shards, ["key"], "shard_size", "quota", "shard", "blocks")
    budget = F.least(F.col("blocks") * F.col("block"), REPEATS * F.col("shard_size"))
    shards = shards.withColumn("budget", budget).select("key", "shard", "shard_size", "budget")
    run = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0))).join(shards, ["key", "shard"])
    passes = F.when(F.col("shard_size") > 0, F.expr("budget div shard_size")).otherwise(0)
    rest = F.col("budget") - passes * F.col("shard_size")
    taken = passes * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", *carry)


def apply_mix(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mixed corpus, with the columns of docs: each row as often as the mix takes it.

    Of a last pass taken in part the text is cut after that many words, and n_chars, where there is one, follows. Rows
    not taken are left out, those without words among them; repeated rows, rows that share an id, and null ids or sources
    are rows of their own; an empty table gives no rows. Each row has a number from the start, and by that it meets its
    part of the mix; columns of any name come through.
    """
    spark, names = docs.sparkSession, docs.columns
    give_back(spark)
    held = cut(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*names).alias("row")))
    bytes_ = held.agg(F.coalesce(F.sum(F.octet_length("row.text").cast("long")), F.lit(0))).first()[0]
    taken = mix(held.select("row.doc_id", "row.text", "row.source", "at"), shard_rows, ("at",)).where("taken > 0")
    parts = partitions_for(spark, bytes_)
    both = held.repartition(parts, "at").join(taken.select("at", F.expr("taken div size").alias("full"), (F.col("taken") % F.col("size")).alias("part")).repartition(parts, "at"), "at")
    each = F.concat(F.array_repeat(F.lit(None).cast("long"), F.col("full").cast("int")), F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<long>")))
    copies = both.select("row", F.explode(each).alias("words"))
    spoken = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", (F.col("words") + 1).cast("int"))
    text = F.when(F.col("words").isNull(), F.col("row.text")).otherwise(F.array_join(F.slice(spoken, F.lit(1), F.col("words").cast("int")), ""))
    copies = copies.select("row", "words", text.alias("text"))
    own = {"text": F.col("text")}
    if "n_chars" in names:
        own["n_chars"] = F.when(F.col("words").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return copies.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce('=' || source, '-') AS key,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord FROM documents),
a AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank, {REPEATS} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total
  FROM (SELECT key, source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY key, source)),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM a),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, max(level) OVER () * weight) AS target, greatest(1, least({BLOCK_TOKENS}, total // {LEAST_BLOCKS})) AS block,
  greatest(1, ceil(n / {SHARD_ROWS}))::BIGINT AS shards FROM l),
q AS (SELECT key, count(*) AS quota FROM (SELECT key, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS r
  FROM (SELECT key, target, rank, total // block AS seats, unnest(range(total // block)) AS k FROM t WHERE target > 0)) WHERE r <= seats GROUP BY key),
p AS (SELECT t.*, coalesce(quota, 0) AS quota FROM t LEFT JOIN q USING (key)),
e AS (SELECT d.*, p.source_size, p.target, p.block, p.quota, ('0x' || ord[1:8])::BIGINT % p.shards AS shard FROM d JOIN p USING (key)),
s AS (SELECT key, shard, sum(size)::BIGINT AS shard_size, any_value(quota) AS quota, any_value(block) AS block FROM e GROUP BY key, shard),
b AS (SELECT key, shard, count(*) AS blocks FROM (SELECT key, shard, quota, row_number() OVER (PARTITION BY key ORDER BY shard_size / (2 * k + 1) DESC, shard) AS r
  FROM (SELECT key, shard, quota, shard_size, unnest(range(quota)) AS k FROM s WHERE shard_size > 0)) WHERE r <= quota GROUP BY key, shard),
g AS (SELECT s.key, s.shard, shard_size, least(coalesce(blocks, 0) * block, {REPEATS} * shard_size) AS budget FROM s LEFT JOIN b USING (key, shard)),
o AS (SELECT e.*, shard_size, budget, coalesce(sum(size) OVER (PARTITION BY e.key, e.shard ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM e JOIN g ON e.key = g.key AND e.shard = g.shard)
SELECT doc_id, size, source_size, target,
  (CASE WHEN shard_size > 0 THEN budget // shard_size * size + greatest(0, least(size, budget % shard_size - start)) ELSE 0 END)::BIGINT AS taken FROM o
"""
