"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the table stays within the bound; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to several partitions a core, for work on a row that takes far longer than reading it: few tasks read a small file."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def left_join_known(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which rows without a key take no part: a shuffle would bring all of them to one task."""
    return rows.where(F.col(key).isNotNull()).join(right, key, "left").unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def left_join_spread(rows: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with ``right(key, ...)``, one narrow row a key, for rows of which very many may share a key or have none, or one that ``right`` doesn't know. Needs a checkpoint folder.

    Keys of very many rows are counted and go by broadcast; their rows, and those without a key, are dealt evenly in the shuffle.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_")).checkpoint()
    many = max(1_000, (counts.agg(F.sum("n_")).first()[0] or 0) // (BROADCAST_ROWS // 2))  # at most BROADCAST_ROWS / 2 keys have more rows
    values = [c for c in right.columns if c != key]
    hot = counts.where(F.col("n_") > many).select(key, F.lit(True).alias("hot_")).join(right, key, "left").select(key, "hot_", *(F.col(c).alias(f"hot_{c}") for c in values))
    apart = F.col("hot_").isNotNull() | F.col(key).isNull()
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("deal_", F.when(apart, 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 16))).otherwise(0))
    out = dealt.join(right.withColumn("deal_", F.lit(0).cast("long")), [key, "deal_"], "left")
    return out.select(*rows.columns, *(F.when(F.col("hot_"), F.col(f"hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))


def join_counted(rows: DataFrame, groups: DataFrame, key: str, n: str) -> DataFrame:
    """Rows joined with their groups (key, n, ...), both written tables: keys of very many rows, of which there are few, go by broadcast, the others by a shuffle, so that no task gets a large group."""
    many = max(1_000, (groups.agg(F.sum(n)).first()[0] or 0) // (BROADCAST_ROWS // 2))  # at most BROADCAST_ROWS / 2 keys have more rows
    hot = F.broadcast(groups.where(F.col(n) > many))
    few = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(n) <= many), key)
    return few.unionByName(rows.join(hot, key))
