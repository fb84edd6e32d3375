"""Digests of trees of any width, level by level, and their verification; chains of envelopes, followed by pointer doubling.

Children are digested in blocks of ``BLOCK`` consecutive places, then the blocks in blocks, so no aggregation gathers more than a block, however wide a node is.
Needs a checkpoint folder: every level and every doubling ends in a checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graphs import sequenced
from .sizes import left_join_known

BLOCK = 1024


def placed(rows: DataFrame, parent: str, order: list[str]) -> DataFrame:
    """Adds ``place``, from 0 among rows of one parent in this order, and ``siblings``, their number; ranks come from range partitions, so no parent is one task."""
    ranked = sequenced(rows, [parent, *order]).checkpoint()
    firsts = ranked.groupBy(parent).agg(F.min("idx").alias("first_"), F.count(F.lit(1)).alias("siblings"))
    return ranked.join(firsts, parent).withColumn("place", F.col("idx") - F.col("first_")).drop("idx", "first_")


def folded_children(children: DataFrame, block: int = BLOCK) -> DataFrame:
    """(parent, fold): of ``children(parent, place, siblings, digest)``, the digests joined in blocks until one is left."""
    left, done = children.select("parent", "place", F.col("siblings").alias("n"), "digest"), []
    while True:
        up = left.groupBy("parent", F.floor(F.col("place") / block).cast("long").alias("place"), F.ceil(F.col("n") / block).cast("long").alias("n")).agg(F.sort_array(F.collect_list(F.struct("place", "digest"))).alias("x"))
        up = up.select("parent", "place", "n", F.sha2(F.array_join("x.digest", ""), 256).alias("digest")).checkpoint()
        done.append(up.where("n = 1").select("parent", F.col("digest").alias("fold")))
        left = up.where("n > 1")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def node_digest(payload: Column, fold: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(payload, F.lit("")), F.coalesce(fold, F.lit(""))), 256)


def tree_digests(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, parent, place, siblings, depth, payload, digest) of ``nodes(node, parent, depth, place, siblings, payload)``: a node's digest covers its payload and, in order, its children's digests.

    Depth grows from parent to child, by one or more; each depth is one aggregation, deepest first. A null parent is a root.
    """
    above = nodes.select(F.col("node").alias("parent"), F.col("depth").alias("above"))
    rows = left_join_known(nodes.select("node", "parent", "place", "siblings", "depth", "payload"), above, "parent").checkpoint()
    levels = sorted((r["depth"] for r in rows.select("depth").distinct().collect()), reverse=True)  # one for each depth of the tree
    done: list[DataFrame] = []
    for level in levels:
        own = rows.where(F.col("depth") == level)
        below = [t.where(F.col("above") == level) for t in done]
        folds = folded_children(reduce(DataFrame.unionByName, below), block) if below else rows.limit(0).select("parent", F.lit("").alias("fold"))
        with_fold = own.join(folds.withColumnRenamed("parent", "node"), "node", "left")
        done.append(with_fold.select(*rows.columns, node_digest(F.col("payload"), F.col("fold")).alias("digest")).checkpoint())
    return reduce(DataFrame.unionByName, done).drop("above") if done else rows.withColumn("digest", F.lit("")).drop("above")


def tampered_nodes(stated: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, path) of ``stated(node, parent, place, siblings, payload, digest)``: nodes whose digest does not follow from their payload and their children's stated digests, with the way down to them from the root.

    One fold over all parents, whatever the depth; ways are only looked up for the nodes that were found.
    """
    stated = stated.checkpoint()
    folds = folded_children(stated.where("parent is not null").select("parent", "place", "siblings", "digest"), block)
    bad = stated.join(folds.withColumnRenamed("parent", "node"), "node", "left").where(node_digest(F.col("payload"), F.col("fold")) != F.coalesce("digest", F.lit("")))
    up = stated.select(F.col("node").alias("at"), F.col("parent").alias("next"))
    left, done = bad.select("node", F.array("node").alias("path"), F.col("parent").alias("at")).checkpoint(), []
    while True:
        done.append(left.where("at is null").select("node", "path"))
        left = left.where("at is not null").join(up, "at", "left").select("node", F.array_prepend("path", F.col("at")).alias("path"), F.when(~F.array_contains("path", F.col("next")), F.col("next")).alias("at")).checkpoint()
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)


def envelope_hash(content: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", content, F.coalesce(previous, F.lit(""))), 256)


def chain_report(envelopes: DataFrame) -> DataFrame:
    """(envelope, codes, start, length, broken): of ``envelopes(envelope, content, previous, hash)``, linked by the hash of the one before.

    Codes: ``tampered`` (its hash does not follow from content and previous), ``missing`` (no envelope has the previous hash), ``forked`` (another has the same previous one),
    ``duplicate`` (another has the same hash; links go to the least envelope), ``cycle`` (its chain has no start). ``start`` is the chain's first
    envelope, ``length`` the number of links to it, ``broken`` the first envelope on the way from the start that is tampered or whose previous is missing; all null in a cycle.

    Each round doubles how far back a row has looked, so a chain of n links takes log2(n) joins. Rows that have reached a start join no more.
    """
    rows = envelopes.select("envelope", "content", "previous", "hash").checkpoint()
    targets = rows.groupBy("hash").agg(F.min("envelope").alias("target"), F.count(F.lit(1)).alias("alike")).checkpoint()
    heirs = rows.where("previous is not null").groupBy("previous").agg(F.count(F.lit(1)).alias("heirs"))
    before = targets.select(F.col("hash").alias("previous"), F.col("target").alias("before")).join(heirs, "previous", "full")
    known = left_join_known(left_join_known(rows, targets, "hash"), before, "previous")
    tampered, missing = envelope_hash(F.col("content"), F.col("previous")) != F.coalesce("hash", F.lit("")), F.col("previous").isNotNull() & F.col("before").isNull()
    own = known.select(
        "envelope", "before", (tampered | missing).alias("bad"),
        F.array_compact(F.array(F.when(tampered, "tampered"), F.when(missing, "missing"), F.when(F.col("heirs") > 1, "forked"), F.when(F.col("alike") > 1, "duplicate"))).alias("codes"),
    ).checkpoint()
    at = own.select("envelope", F.col("before").alias("to"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("long").alias("length"), F.coalesce("before", "envelope").alias("start"), F.when(F.col("bad"), F.col("envelope")).alias("broken")).checkpoint()
    span, total, done, left = 1, own.count(), [at.where("to is null")], at.where("to is not null")
    while span <= total and left.limit(1).count():
        far = reduce(DataFrame.unionByName, [*done, left]).select(F.col("envelope").alias("to"), F.col("to").alias("to2"), F.col("length").alias("length2"), F.col("start").alias("start2"), F.col("broken").alias("broken2"))
        now = left.join(far, "to", "left").select("envelope", F.col("to2").alias("to"), (F.col("length") + F.coalesce("length2", F.lit(0))).alias("length"), F.coalesce("start2", "start").alias("start"), F.coalesce("broken2", "broken").alias("broken")).checkpoint()
        done, left = [*done, now.where("to is null")], now.where("to is not null")
        span *= 2
    at = reduce(DataFrame.unionByName, [*done, left])
    ended = F.col("to").isNull()
    codes = F.when(ended, F.col("codes")).otherwise(F.array_append("codes", F.lit("cycle")))
    return own.join(at, "envelope").select("envelope", F.array_join(codes, ",").alias("codes"), *(F.when(ended, F.col(c)).alias(c) for c in ("start", "length", "broken")))
