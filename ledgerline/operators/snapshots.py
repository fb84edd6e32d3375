"""Snapshot comparison: diffs, approvals, undeclared files, and delta plans for an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, old_hash, new_hash, status) of two (path, content_hash): added, changed, removed, archived or unchanged."""
    a = old.select("path", F.col("content_hash").alias("old_hash"))
    b = new.select("path", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "added")
        .when(F.col("new_hash").isNull(), F.when(F.lower("path").contains("archive"), "archived").otherwise("removed"))
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged")
    )
    return a.join(b, "path", "full_outer").withColumn("status", status)


def unapproved(snapshot: DataFrame, lock: DataFrame) -> DataFrame:
    """Files of a snapshot whose (path, content_hash) no lock entry approves."""
    return snapshot.join(lock.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def validate_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Findings (path, code): declared but missing, hash mismatch, and files nobody declared."""
    both = manifest.select("path", F.col("content_hash").alias("declared"), F.lit(True).alias("in_manifest")).join(files.select("path", F.col("content_hash").alias("actual"), F.lit(True).alias("in_files")), "path", "full_outer")
    code = F.when(F.col("in_files").isNull(), "SOURCE_MISSING").when(F.col("in_manifest").isNull(), "SOURCE_UNDECLARED").when(F.col("declared") != F.col("actual"), "SOURCE_HASH_MISMATCH")
    return both.select("path", code.alias("code")).where("code is not null")


def chunk_delta(old: DataFrame, new: DataFrame, full_reason: str | None = None) -> DataFrame:
    """(chunk_id, source_id, action, reason) that takes an index of the old chunks to the new ones; unchanged chunks are not listed.

    Both sides are (chunk_id, source_id, source_hash, body_hash, embedding_hash). ``full_reason`` makes every kept chunk an embedding.
    """
    cols = ("source_id", "source_hash", "body_hash", "embedding_hash")
    side = lambda df, p: df.select("chunk_id", F.lit(True).alias(f"{p}_in"), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    both = side(old, "o").join(side(new, "n"), "chunk_id", "full_outer")
    differs = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    full = F.lit(full_reason).cast("string")
    reason = (
        F.when(F.col("n_in").isNull(), "removed")
        .when(full.isNotNull(), full)
        .when(F.col("o_in").isNull(), "added")
        .when(differs("body_hash"), "body_changed")
        .when(differs("embedding_hash"), "context_changed")
        .when(differs("source_hash"), "source_hash_changed")
    )
    action = F.when(F.col("reason") == "removed", "delete").when(F.col("reason") == "source_hash_changed", "update_metadata").otherwise("embed")
    return both.withColumn("reason", reason).where("reason is not null").select("chunk_id", F.coalesce("n_source_id", "o_source_id").alias("source_id"), action.alias("action"), "reason")


def source_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_id, status, old_chunks, new_chunks) of two (source_id, source_hash, chunk_digest, chunk_count)."""
    a = old.select("source_id", F.col("source_hash").alias("oh"), F.col("chunk_digest").alias("od"), F.col("chunk_count").alias("old_chunks"))
    b = new.select("source_id", F.col("source_hash").alias("nh"), F.col("chunk_digest").alias("nd"), F.col("chunk_count").alias("new_chunks"))
    status = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "removed").when((F.col("oh") != F.col("nh")) | (F.col("od") != F.col("nd")), "changed").otherwise("unchanged")
    return a.join(b, "source_id", "full_outer").select("source_id", status.alias("status"), F.coalesce("old_chunks", F.lit(0)).cast("long").alias("old_chunks"), F.coalesce("new_chunks", F.lit(0)).cast("long").alias("new_chunks"))


def ordered_digest(order: Column, *parts: Column) -> Column:
    """Aggregate: SHA-256 over NUL-ended parts of the rows in order."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.concat(*(F.concat(F.coalesce(p, F.lit("")), F.lit("\x00")) for p in parts)).alias("x"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["x"]), ""), 256)


def manifest_sources(records: DataFrame) -> DataFrame:
    """(source_id, source_hash, chunk_count, chunk_digest) of records (chunk_id, source_id, source_hash, embedding_hash); the hash is the first chunk's."""
    return records.groupBy("source_id").agg(F.min_by("source_hash", "chunk_id").alias("source_hash"), F.count(F.lit(1)).alias("chunk_count"), ordered_digest(F.col("chunk_id"), F.col("chunk_id"), F.col("source_hash"), F.col("embedding_hash")).alias("chunk_digest"))


def retrieval_contract(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, records, distinct_values, values): for each filter field that occurs, how many records carry it and its sorted vocabulary."""
    kinds = dict(records.dtypes)
    as_list = lambda f: F.filter(F.col(f), lambda x: F.coalesce(x, F.lit("")) != "") if kinds[f].startswith("array") else F.filter(F.array(F.col(f).cast("string")), lambda x: F.coalesce(x, F.lit("")) != "")
    long = records.select("chunk_id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), as_list(f).alias("values")) for f in fields))).alias("x"))
    long = long.select("chunk_id", "x.field", F.explode("x.values").alias("value"))
    # Values meet per field only after equal ones have been merged.
    carried = long.select("field", "chunk_id").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("records"))
    values = long.select("field", "value").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vocabulary"))
    return carried.join(values, "field")
