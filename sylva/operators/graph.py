"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.session import cut


def components(links: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """node, component (the smallest reachable id) for each end of links (a long, b long).

    With columns to stay within, as many graphs as these have values are solved at once; they come first in the result.
    """
    ends = links.select(*within, F.explode(F.array("a", "b")).alias("node")).distinct()
    edges = cut(links.where("a <> b").select(*within, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*within, "a", "b").cast("decimal(20,0)"))).first())
    end = [*within, "a"]
    before = state(edges)
    while before[0]:
        both = edges.union(edges.select(*within, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*end).agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, end).select(*within, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy(*end).agg(F.min("b").alias("m"))
        small = large.join(low, end).select(*within, F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select(*within, "e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    found = ends.join(edges.select(*within, F.col("a").alias("node"), F.col("b").alias("component")), [*within, "node"], "left")
    return found.select(*within, "node", F.coalesce("component", "node").alias("component"))
