"""Cluster-set algebra, links between layers, and exports of the cluster tree.

A layer is rows (layer, row_id, cluster). Clusters of a layer are disjoint, and a child belongs to a parent that holds
more than 0.8 of it, so a child has at most one parent.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.session import cut, numbered

OVERLAP = 0.8
#: Fixed value: how the files of clusters are named.
CLUSTER_FILE = r"L(\d+)-C-(\d+)$"


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_counts(members: DataFrame) -> DataFrame:
    """layer, clusters."""
    return members.groupBy("layer").agg(F.countDistinct("cluster").alias("clusters"))


def intersections(a: DataFrame, b: DataFrame) -> DataFrame:
    """cluster_a, cluster_b, common for the clusters of two layers that share members."""
    return a.select("row_id", F.col("cluster").alias("cluster_a")).join(b.select("row_id", F.col("cluster").alias("cluster_b")), "row_id").groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("common"))


def layer_intersections(members: DataFrame) -> DataFrame:
    """layer, cluster_a, cluster_b, common for each layer (a) and the next (b)."""
    a = members.select("row_id", "layer", F.col("cluster").alias("cluster_a"))
    b = members.select("row_id", (F.col("layer") - 1).alias("layer"), F.col("cluster").alias("cluster_b"))
    return a.join(b, ["row_id", "layer"]).groupBy("layer", "cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("common"))


def edges(members: DataFrame, overlap: float = OVERLAP) -> DataFrame:
    """layer, cluster, child_layer, child, common: clusters of each layer and those of the layer before that they absorb."""
    new, old = members.alias("n"), members.alias("o")
    both = new.join(old, (F.col("n.row_id") == F.col("o.row_id")) & (F.col("n.layer") == F.col("o.layer") + 1))
    common = both.groupBy(F.col("n.layer").alias("layer"), F.col("n.cluster").alias("cluster"), F.col("o.layer").alias("child_layer"), F.col("o.cluster").alias("child")).agg(F.count(F.lit(1)).alias("common"))
    size = sizes(members).select(F.col("layer").alias("child_layer"), F.col("cluster").alias("child"), "size")
    return common.join(size, ["child_layer", "child"]).where(F.col("common") > F.lit(overlap) * F.col("size")).select("layer", "cluster", "child_layer", "child", "common")


def coverage(members: DataFrame, rows: DataFrame) -> DataFrame:
    """layer, covered, noise, coverage."""
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    by = members.groupBy("layer").agg(F.count(F.lit(1)).alias("covered"))
    return by.join(n).select("layer", "covered", (F.col("n") - F.col("covered")).alias("noise"), (F.col("covered") / F.col("n")).alias("coverage"))


def noise(members: DataFrame, rows: DataFrame, layer: int) -> DataFrame:
    """row_id of the rows in no cluster of a layer."""
    return rows.select("row_id").join(members.where(F.col("layer") == layer), "row_id", "left_anti")


def gather(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each cluster: layer, cluster, pos and the columns of rows; pos counts from 0 by row_id."""
    pos = F.row_number().over(Window.partitionBy("layer", "cluster").orderBy("row_id")) - 1
    return members.select("layer", "cluster", "row_id", pos.alias("pos")).join(rows, "row_id")


def rows_by_index(rows: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of a list of positions (pos, row_id), repeats included; unknown positions are left out."""
    return index.join(rows, "row_id")


def node_key(layer: Column, cluster: Column, size: Column) -> Column:
    """L<layer>C<cluster>N<size>."""
    return F.concat(F.lit("L"), layer.cast("string"), F.lit("C"), cluster.cast("string"), F.lit("N"), size.cast("string"))


def file_key(name: Column) -> Column:
    """The key of a cluster file named L0014-C-000683, less the size."""
    part = lambda g: F.regexp_extract(name, CLUSTER_FILE, g).cast("long").cast("string")
    return F.concat(F.lit("L"), part(1), F.lit("C"), part(2))


def mapping(members: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """key, doc_count, article_ids (as strings, ascending), label (stripped, or null): labels are (layer, cluster, label)."""
    by = members.groupBy("layer", "cluster").agg(F.count(F.lit(1)).alias("doc_count"), F.array_sort(F.collect_list("row_id")).alias("ids"))
    if labels is not None:
        by = by.join(labels.select("layer", "cluster", F.nullif(F.trim("label"), F.lit("")).alias("label")), ["layer", "cluster"], "left")
    else:
        by = by.withColumn("label", F.lit(None).cast("string"))
    return by.select(node_key(F.col("layer"), F.col("cluster"), F.col("doc_count")).alias("key"), "doc_count", F.transform("ids", lambda i: i.cast("string")).alias("article_ids"), "label")


def articles(rows: DataFrame, title: str = "title", content: str = "content") -> DataFrame:
    """id, title, content of JSON lines (row_id, value); blank lines are left out but counted; missing fields are empty."""
    field = lambda f: F.coalesce(F.get_json_object("value", f"$['{f}']"), F.lit(""))
    return rows.where(F.trim("value") != "").select(F.col("row_id").cast("string").alias("id"), field(title).alias("title"), field(content).alias("content"))


def nodes(members: DataFrame) -> DataFrame:
    """node (layer and cluster in one long), layer, cluster, size, parent (null at a root)."""
    link = edges(members).select(F.col("child_layer").alias("layer"), F.col("child").alias("cluster"), ident(F.col("layer"), F.col("cluster")).alias("parent"))
    return sizes(members).join(link, ["layer", "cluster"], "left").select(ident(F.col("layer"), F.col("cluster")).alias("node"), "layer", "cluster", "size", "parent")


def ident(layer: Column, cluster: Column) -> Column:
    return F.shiftleft(layer.cast("long"), 32).bitwiseOR(cluster.cast("long"))


def ancestry(tree: DataFrame) -> DataFrame:
    """node, ancestor, distance for each node of nodes(); every node is its own ancestor at distance 0.

    Paths double at each round, so a tree of depth d takes log2(d) joins.
    """
    up = tree.select("node", F.col("parent").alias("ancestor")).where("ancestor is not null").withColumn("distance", F.lit(1).cast("long"))
    found, reach = cut(up), 1
    while True:
        longer = found.where(F.col("distance") == reach).select("node", F.col("ancestor").alias("mid"), F.col("distance").alias("d"))
        more = longer.join(found.select(F.col("node").alias("mid"), "ancestor", "distance"), "mid").select("node", "ancestor", (F.col("d") + F.col("distance")).alias("distance"))
        more = cut(more)
        if more.isEmpty():
            break
        found, reach = cut(found.unionByName(more)), 2 * reach
    return found.unionByName(tree.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("long").alias("distance")))


def top_branch(tree: DataFrame) -> DataFrame:
    """node, branch: the ancestor just below the root; a root is its own branch."""
    path = ancestry(tree).withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("distance"))))
    return path.where("n <= 2").groupBy("node").agg(F.max_by("ancestor", "n").alias("branch"))


def tree_stats(tree: DataFrame) -> DataFrame:
    """nodes, leaves, roots."""
    parents = tree.select(F.col("parent").alias("node")).where("node is not null").distinct().withColumn("inner", F.lit(1))
    return tree.join(parents, "node", "left").agg(F.count(F.lit(1)).alias("nodes"), F.count(F.when(F.col("inner").isNull(), 1)).alias("leaves"), F.count(F.when(F.col("parent").isNull(), 1)).alias("roots"))


def significant(named: DataFrame, least: int = 100) -> DataFrame:
    """Inner nodes with a label and at least so many documents: (node, label, doc_count, inner)."""
    return named.where(F.col("inner") & F.col("label").isNotNull() & (F.col("doc_count") >= least))


def node_label(name: Column) -> Column:
    """Null for technical names; else without trailing underscores and spaces; empty falls back to the name with spaces."""
    stripped = F.regexp_replace(name, r"[_ ]+$", "")
    return F.when(name.rlike(r"^L\d+C\d+"), F.lit(None).cast("string")).otherwise(F.when(stripped != "", stripped).otherwise(F.regexp_replace(name, "_", " ")))


def doc_counts(names: DataFrame, mapped: DataFrame) -> DataFrame:
    """names (key, ...) with the doc_count and label of a mapping(); a key that is not mapped has 0 documents."""
    return names.join(mapped.select("key", "doc_count", "label"), "key", "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def shortened(label: Column, most: int) -> Column:
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most), F.lit("..."))).otherwise(label)


def every_nth(df: DataFrame, order: str, skip: int) -> DataFrame:
    """Every skip-th row in order, the first included."""
    return numbered(df, [order], "_n").where(F.col("_n") % skip == 0).drop("_n")


def label_mix(members: DataFrame, labels: DataFrame) -> DataFrame:
    """layer, cluster, label, n, intensity: members per label, and log(1 + n) over the layer's largest."""
    by = members.join(labels, "row_id").groupBy("layer", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("intensity", F.log1p("n") / F.max(F.log1p("n")).over(Window.partitionBy("layer")))


# ---- nested forms, assembled at the sink from the edge table


def nested(tree: DataFrame) -> list[dict]:
    """{name, children} (children null at leaves) of each root: the tree has one row a cluster, few beside the data."""
    rows = tree.orderBy("layer", "cluster").collect()
    made = {r.node: {"name": f"L{r.layer}C{r.cluster}N{r['size']}", "children": None} for r in rows}
    roots = []
    for r in rows:
        if r.parent is None:
            roots.append(made[r.node])
        else:
            made[r.parent]["children"] = [*(made[r.parent]["children"] or []), made[r.node]]
    return roots


def newick(roots: list[dict]) -> str:
    """The forest in Newick form, one tree under an unnamed root if there are several."""
    def write(n: dict) -> str:
        inner = "(" + ",".join(map(write, n["children"])) + ")" if n["children"] else ""
        return inner + n["name"]

    return (write(roots[0]) if len(roots) == 1 else "(" + ",".join(map(write, roots)) + ")") + ";"


def parse_newick(text: str) -> dict:
    """{name, children} of a Newick string; branch lengths are dropped."""
    stack, now = [], {"name": "", "children": None}
    for token in re.findall(r"[(),;]|[^(),;]+", text.strip()):
        if token == "(":
            child = {"name": "", "children": None}
            now["children"] = [child]
            stack.append(now)
            now = child
        elif token == ",":
            now = {"name": "", "children": None}
            stack[-1]["children"].append(now)
        elif token == ")":
            now = stack.pop()
        elif token != ";":
            now["name"] = token.split(":")[0].strip()
    return now


def tree_json(roots: list[dict]) -> str:
    return json.dumps(roots[0] if len(roots) == 1 else {"name": "", "children": roots})


def annotation_chunks(members: DataFrame, most: int = 1500, seed: int = 1) -> DataFrame:
    """layer, cluster, chunk, row_id: for clusters of more than `most`, ceil(3n / most) random chunks of `most` rows; else one of all.

    A cluster is shuffled a few times, and each time cut into as many whole chunks as it has; so a chunk is any set of
    `most` rows alike, and a row is handled at most six times however large its cluster is.
    """
    n = F.col("size")
    chunks = F.when(n > most, F.ceil(3 * n / most)).otherwise(1).cast("long")
    size = sizes(members).withColumn("chunks", chunks).withColumn("whole", F.greatest(F.floor(n / most), F.lit(1)))
    dealt = members.join(size, ["layer", "cluster"]).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("chunks") / F.col("whole")) - 1)))
    order = Window.partitionBy("layer", "cluster", "pass").orderBy(F.xxhash64(F.lit(seed), "layer", "cluster", "pass", "row_id"), "row_id")
    placed = dealt.withColumn("place", F.floor((F.row_number().over(order) - 1) / most)).where("place < whole")
    return placed.withColumn("chunk", F.col("pass") * F.col("whole") + F.col("place")).where("chunk < chunks").select("layer", "cluster", "chunk", "row_id")


def chunks_of(n: int, most: int = 1500) -> int:
    return math.ceil(3 * n / most) if n > most else 1
