"""Validity intervals and event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_as_of(atoms: DataFrame, asked: DataFrame) -> DataFrame:
    """(work_id, as_of, atom_id, status): the atom in force at a date, both ends included, an open end allowed.

    The latest start wins, then the larger id; it is one maximum per question, so no group is sorted. Misses stay.
    """
    a = asked.select("work_id", "as_of")
    inside = (F.col("effective_from") <= F.col("as_of")) & (F.col("effective_to").isNull() | (F.col("as_of") <= F.col("effective_to")))
    best = a.join(atoms, "work_id").where(inside).groupBy("work_id", "as_of").agg(F.max_by("atom_id", F.struct("effective_from", "atom_id")).alias("atom_id"))
    return a.join(best, ["work_id", "as_of"], "left").withColumn("status", F.when(F.col("atom_id").isNull(), "not_in_force").otherwise("in_force"))


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], value: str) -> DataFrame:
    """Counts and sums per window; the same function serves batches and streams."""
    return events.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Sessions that end after a gap without events."""
    return events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("session_start"), "n")
