"""Windows by key whose groups may hold any number of rows: ranges of (key, order) are pieces, and what earlier pieces hold of a key is carried in.

Only the first and the last key of a piece can go on in another one, so what is carried is at most two rows a piece, and is broadcast.
Rows without a key are a group of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources.shared import ensure_checkpoints

EARLIER = (Window.unboundedPreceding, -1)


def in_pieces(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds ``part_``, which rises with key and order; rows that are equal in both share one. Written once, as ranges may be drawn differently in a second run."""
    ensure_checkpoints(rows.sparkSession)
    return rows.repartitionByRange(key, *order).withColumn("part_", F.spark_partition_id()).checkpoint()


def with_carried(part: DataFrame, key: str, own: Column, merge: Callable[[Column], Column]) -> DataFrame:
    """Adds ``carried_``: the aggregate ``own`` of the key's rows in all earlier pieces, put together by ``merge``; null without any."""
    ends = part.groupBy("part_").agg(F.min(F.struct(key)).alias("lo_"), F.max(F.struct(key)).alias("hi_"))
    edge = part.join(F.broadcast(ends), "part_").where(F.struct(key).eqNullSafe(F.col("lo_")) | F.struct(key).eqNullSafe(F.col("hi_")))
    sums = edge.groupBy("part_", key).agg(own.alias("own_"))
    carried = sums.select(F.col("part_").alias("p_"), F.col(key).alias("k_"), merge(F.col("own_")).over(Window.partitionBy(key).orderBy("part_").rowsBetween(*EARLIER)).alias("carried_")).where("carried_ is not null")
    return part.join(F.broadcast(carried), (F.col("part_") == F.col("p_")) & F.col(key).eqNullSafe(F.col("k_")), "left").drop("p_", "k_")


def running_max(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the greatest value of all earlier rows of the key, null for its first."""
    part = with_carried(in_pieces(rows, key, order), key, F.max(value), F.max)
    w = Window.partitionBy("part_", key).orderBy(*order).rowsBetween(*EARLIER)
    return part.withColumn(name, F.greatest(F.max(value).over(w), "carried_")).drop("part_", "carried_")


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds the row's place within its key, from 1."""
    part = with_carried(in_pieces(rows, key, order), key, F.count(F.lit(1)), F.sum)
    w = Window.partitionBy("part_", key).orderBy(*order)
    return part.withColumn(name, F.row_number().over(w) + F.coalesce("carried_", F.lit(0))).drop("part_", "carried_")


def with_neighbours(rows: DataFrame, key: str, order: list[str], value: str, previous: str | None = None, following: str | None = None) -> DataFrame:
    """Adds the value of the row before and of the row behind within the key, null where there is none."""
    part = in_pieces(rows, key, order)
    ends = part.groupBy("part_").agg(*(f(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(key, *order)).alias(name) for f, name in ((F.min_by, "first_"), (F.max_by, "last_"))))
    across = Window.orderBy("part_")  # one row a piece
    ends = ends.select("part_", F.lag("last_").over(across).alias("near_a_"), F.lead("first_").over(across).alias("near_z_"))
    w, there = Window.partitionBy("part_", key).orderBy(*order), F.lit(True)
    beyond = lambda c: F.when(F.col(c).isNotNull() & F.col(f"{c}.k").eqNullSafe(F.col(key)), F.col(f"{c}.v"))
    out = part.join(F.broadcast(ends), "part_")
    if previous:
        out = out.withColumn(previous, F.when(F.lag(there).over(w).isNull(), beyond("near_a_")).otherwise(F.lag(value).over(w)))
    if following:
        out = out.withColumn(following, F.when(F.lead(there).over(w).isNull(), beyond("near_z_")).otherwise(F.lead(value).over(w)))
    return out.drop("part_", "near_a_", "near_z_")
