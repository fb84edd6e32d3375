"""Deterministic ids, classes of runtime chunks, and external snapshots: records checked, sealed under a Merkle root, verified by recomputing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank, raw_hash

from .graphs import merkle_levels, sequenced

#: Fixed values.
RECORD_HASH, CAPTURED = r"^(sha256|sha384|sha512):[A-Fa-f0-9]+$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
REPOSITORY = r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


def atom_id(ref: Column, file: Column, start_line: Column, end_line: Column) -> Column:
    return F.concat(F.lit("atom-"), F.substring(raw_hash(F.concat_ws("|", ref, file, start_line.cast("string"), end_line.cast("string"))), 1, 16))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), raw_hash(text))


def html_node_id(prefix: Column, index: Column) -> Column:
    return F.concat(F.lit("hn-"), F.substring(raw_hash(F.concat_ws(":", F.lit("html"), prefix, index.cast("string"))), 1, 12))


def safe_node_id(c: Column) -> Column:
    """Upper case, anything but letters, digits, dot, underscore and hyphen as a hyphen, none of the last three in front; a hash if nothing is left."""
    clean = F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9._-]", "-"), "^[._-]+", "")
    return F.when(clean == "", F.concat(F.lit("N-"), F.upper(F.substring(raw_hash(c), 1, 8)))).otherwise(clean)


def repository_of(remote: Column) -> Column:
    """owner/name from the last two parts of a remote's address; empty where these are no names."""
    own = F.regexp_extract(F.regexp_replace(F.trim(remote), r"\.git$", ""), r"([^/:]+[/:]+[^/:]+)[/:]*$", 1)
    name = F.regexp_replace(own, "[/:]+", "/")
    return F.when(name.rlike(REPOSITORY), name).otherwise("")


def authority(node_type: Column, priority: Column) -> Column:
    return (
        F.when(node_type.isin("document", "chapter"), "authoritative").when(node_type.isin("section", "article"), F.when(priority.isin("critical", "high"), "authoritative").otherwise("reference"))
        .when(node_type == "paragraph", "reference").otherwise("derived")
    )


def confidence(status: Column, level: Column) -> Column:
    """By a node's status and its authority."""
    return F.when(status == "active", F.when(level.isin("authoritative", "reference"), "high").otherwise("medium")).when(status.isin("pending", "draft", "repealed"), "low").otherwise("medium")


def runtime_chunks(nodes: DataFrame) -> DataFrame:
    """(node_id, chunk_id, authority, confidence) of nodes (feed_id, node_id, source_hash, node_type, priority, status)."""
    level = authority(F.col("node_type"), F.col("priority"))
    chunk = F.concat(F.lit("rag-"), F.substring(raw_hash(F.concat_ws("\x00", "feed_id", "node_id", "source_hash")), 1, 24))
    return nodes.select("node_id", chunk.alias("chunk_id"), level.alias("authority"), confidence(F.col("status"), level).alias("confidence"))


def record_findings(records: DataFrame) -> DataFrame:
    """(source_id, version_id, code): the first fault of each record (source_id, version_id, locator, content_hash, captured_at), and versions that occur twice."""
    code = (
        F.when(is_blank(F.col("source_id")) | is_blank(F.col("version_id")) | is_blank(F.col("locator")), "malformed").when(~F.coalesce(F.trim("content_hash"), F.lit("")).rlike(RECORD_HASH), "unstable_hash")
        .when(~F.coalesce(F.trim("captured_at"), F.lit("")).rlike(CAPTURED), "bad_captured_at")
    )
    own = records.select("source_id", "version_id", code.alias("code")).where("code is not null")
    twice = records.groupBy("source_id", "version_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("source_id", "version_id", F.lit("duplicate").alias("code"))
    return own.unionByName(twice)


def leaf_hash() -> Column:
    return raw_hash(F.concat_ws("\x00", F.lit("snapshot-record"), "source_id", "version_id", F.lower("content_hash")))


def snapshot_root(records: DataFrame) -> DataFrame:
    """(hash): the Merkle root over the records' leaves in the order of source and version; needs a checkpoint folder."""
    return merkle_levels(sequenced(records.select("source_id", "version_id", leaf_hash().alias("hash")), ["source_id", "version_id"]))[-1].select("hash")


def verify_snapshot(records: DataFrame, stated: DataFrame) -> DataFrame:
    """(sources, versions, faults, root, refusal) for each row of ``stated(root, sources, versions)``: faults, counts or the recomputed root of the records refuse what is stated, in this order."""
    counts = records.agg(F.countDistinct("source_id").alias("sources"), F.count(F.lit(1)).alias("versions"))
    faults = record_findings(records).agg(F.count(F.lit(1)).alias("faults"))
    found = counts.crossJoin(faults).crossJoin(snapshot_root(records).withColumnRenamed("hash", "root"))  # one row each
    said = stated.select(F.regexp_replace(F.lower(F.trim("root")), "^sha256:", "").alias("said_root"), F.col("sources").alias("said_sources"), F.col("versions").alias("said_versions"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"said_{c}"))
    refusal = F.when(F.col("faults") > 0, "record_faults").when(differs("sources"), "source_count").when(differs("versions"), "version_count").when(differs("root"), "root_differs")
    return said.crossJoin(F.broadcast(found)).select("sources", "versions", "faults", "root", F.coalesce(refusal, F.lit("")).alias("refusal"))
