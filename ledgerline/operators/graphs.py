"""Reference graphs: broken references, orphans, statistics, parent chains, topological order; and Merkle trees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def broken_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("target")), "target", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no end of any edge."""
    ends = edges.select(F.col("source").alias("node")).unionByName(edges.select(F.col("target").alias("node")))
    return nodes.join(ends, "node", "left_anti")


def edge_statistics(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(kind, edges, broken) per kind of edge."""
    known = nodes.select(F.col("node").alias("target"), F.lit(True).alias("known")).distinct()
    return edges.join(known, "target", "left").groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("known").isNull()).alias("broken"))


def link_kind(target: Column) -> Column:
    """url, anchor, mail or path, by shape."""
    return F.when(target.rlike(r"^(https?:)?//"), "url").when(target.startswith("#"), "anchor").when(target.rlike(r"^mailto:"), "mail").otherwise("path")


def parent_chains(nodes: DataFrame, keep_unknown: bool = True) -> DataFrame:
    """(node, chain): ids from the root to the parent of (node, parent), however many; a node already in the chain ends it.

    An unknown parent's id stays at the chain's start, unless ``keep_unknown`` is false. A checkpointed join for each level of the deepest chain.
    """
    up = nodes.select(F.col("node").alias("at"), F.col("parent").cast("string").alias("above"), F.lit(True).alias("known")).checkpoint()
    left, done = nodes.select("node", F.array().cast("array<string>").alias("chain"), F.col("parent").cast("string").alias("at")), []
    while True:
        more = F.col("at").isNotNull() & ~F.array_contains("chain", F.col("at")) & (F.col("at") != F.col("node").cast("string"))
        add = more if keep_unknown else more & F.col("known")
        now = left.join(up, "at", "left").select("node", F.when(add, F.array_prepend("chain", F.col("at"))).otherwise(F.col("chain")).alias("chain"), F.when(more, F.col("above")).alias("at")).checkpoint()
        done.append(now.where("at is null").select("node", "chain"))
        left = now.where("at is not null")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 without incoming edges, else one more than the deepest source. Nodes of a cycle, and those behind one, have no level.

    Joins are merges: a broadcast for each level would bring the nodes and edges to the driver again and again.
    """
    done, level = None, 0
    left, open_edges = nodes.select("node"), edges.select("source", "target").where("source <> target").distinct()
    while True:
        ready = left.join(open_edges.select(F.col("target").alias("node")).hint("merge"), "node", "left_anti").checkpoint()
        if not ready.limit(1).count():
            break
        done = ready.withColumn("level", F.lit(level)) if done is None else done.unionByName(ready.withColumn("level", F.lit(level)))
        left = left.join(ready.hint("merge"), "node", "left_anti").checkpoint()
        open_edges = open_edges.join(ready.withColumnRenamed("node", "source").hint("merge"), "source", "left_anti").checkpoint()
        level += 1
    return nodes.select("node").join(done.hint("merge"), "node", "left") if done is not None else nodes.select("node", F.lit(None).cast("int").alias("level"))


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels (idx long, hash) from the leaves (consecutive idx from 0) up to the root; an odd last node pairs with itself.

    Each level halves the one below in one aggregation; there are about log2(n) of them, each checkpointed.
    """
    levels, n = [leaves.select("idx", "hash")], leaves.count()
    while n > 1:
        up = levels[-1].groupBy(F.floor(F.col("idx") / 2).cast("long").alias("up")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        levels.append(up.select(F.col("up").alias("idx"), F.sha2(F.concat_ws("\n", "a", "b"), 256).alias("hash")).checkpoint())
        n = -(-n // 2)
    return levels


def merkle_proofs(levels: list[DataFrame]) -> DataFrame:
    """(idx, leaf, path): for each leaf the siblings up to the root, as structs (side, hash).

    Paths grow from the root down: a node's path goes to its two children in one join of the two levels, checkpointed, so all joins together move about twice the leaves.
    """
    paths = levels[-1].select("idx", "hash", F.array().cast("array<struct<side:string,hash:string>>").alias("path"))
    hop = lambda side, h: F.concat(F.array(F.struct(F.lit(side).alias("side"), F.col(h).alias("hash"))), F.col("path"))
    kid = lambda idx, h, path: F.struct(idx.alias("idx"), F.col(h).alias("hash"), path.alias("path"))
    for level in reversed(levels[:-1]):
        pairs = level.groupBy(F.floor(F.col("idx") / 2).cast("long").alias("up")).agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"), F.count(F.lit(1)).alias("n"))
        both = pairs.join(paths.select(F.col("idx").alias("up"), "path"), "up")
        kids = F.array_compact(F.array(kid(F.col("up") * 2, "a", hop("right", "b")), F.when(F.col("n") > 1, kid(F.col("up") * 2 + 1, "b", hop("left", "a")))))
        paths = both.select(F.explode(kids).alias("x")).select("x.*").checkpoint()
    return paths.select("idx", F.col("hash").alias("leaf"), "path")


def fold_proof(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.when(p["side"] == "right", F.concat_ws("\n", h, p["hash"])).otherwise(F.concat_ws("\n", p["hash"], h)), 256))


def sequenced(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``idx`` from 0 in order, without one task for all rows: ranks within range partitions, moved by the sizes before them."""
    part = rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()).checkpoint()
    sizes = part.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.withColumn("before_", F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).drop("n_")  # one row a partition
    nth = F.row_number().over(Window.partitionBy("part_").orderBy(*order))
    return part.withColumn("nth_", nth).join(F.broadcast(before), "part_").withColumn("idx", F.col("before_") + F.col("nth_") - 1).drop("part_", "nth_", "before_")
