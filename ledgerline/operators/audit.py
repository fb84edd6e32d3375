"""Audits of feeds and corpora: totals, shares, coverage by extension, indexes, histograms, assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.spans import with_bytes
from ledgerline.functions.text import is_blank

from .integrity import source_derived

#: Depth of each structural node type, node types without a depth of their own, states and priorities.
NODE_DEPTH = {"document": 0, "chapter": 1, "section": 2, "subsection": 3, "article": 4, "paragraph": 5, "alinea": 6}
SEMANTIC_TYPES = ("table", "code_block", "callout", "link", "image")
NODE_STATUS = ("active", "amended", "repealed", "pending", "draft")
PRIORITIES = ("critical", "high", "medium", "low")
NODE_ID, ORDINAL, HASH = r"^[A-Z0-9][A-Z0-9._-]*$", r"^[0-9]+(\.[0-9]+)*$", r"^(sha256|sha384|sha512):[A-Fa-f0-9]+$"


def feed_totals(units: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row of counts. A source without a status is active; a unit uses its source_id and all source_ids."""
    u = units.agg(F.count(F.lit(1)).alias("units"), F.count_if(source_derived()).alias("source_backed_units"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(~is_blank(F.col("source_segment_id"))).alias("source_backed_chunks"))
    active = sources.where(is_blank(F.col("status")) | (F.trim("status") == "active")).select("source_id").distinct()
    used = units.select(F.explode(F.array_append(F.coalesce("source_ids", F.array().cast("array<string>")), F.col("source_id"))).alias("source_id")).distinct()
    s = active.join(used.withColumn("used", F.lit(True)), "source_id", "left").agg(F.count(F.lit(1)).alias("active_sources"), F.count_if(F.col("used").isNull()).alias("sources_without_units"))
    return u.crossJoin(c).crossJoin(s)  # one row each


def kind_share(units: DataFrame, kind: str) -> DataFrame:
    """One row: units of the kind, all units, and the share (0 without units)."""
    out = units.agg(F.count_if(F.col("kind") == kind).alias("of_kind"), F.count(F.lit(1)).alias("units"))
    return out.withColumn("ratio", F.when(F.col("units") > 0, F.col("of_kind") / F.col("units")).otherwise(F.lit(0.0)))


def extension_coverage(files: DataFrame, units: DataFrame) -> DataFrame:
    """(ext, sources, with_units, byte_coverage_pct) of ``files(path, size_bytes)``; overlapping spans count twice, as bytes are summed."""
    size = F.greatest(F.col("end_byte") - F.col("start_byte"), F.lit(0))
    per = units.where(~is_blank(F.col("source_path"))).groupBy(F.trim("source_path").alias("path")).agg(F.sum(size).alias("covered"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    rows = files.join(per, "path", "left").withColumn("ext", F.when(ext == "", "<none>").otherwise(ext))
    out = rows.groupBy("ext").agg(F.count(F.lit(1)).alias("sources"), F.count("covered").alias("with_units"), F.sum("size_bytes").alias("bytes"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))
    return out.select("ext", "sources", "with_units", F.when(F.col("bytes") > 0, F.col("covered") / F.col("bytes") * 100).alias("byte_coverage_pct"))


def first_without_units(files: DataFrame, units: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` paths, in order, of files without a unit: a report's list, cut where the report cuts it."""
    used = units.where(~is_blank(F.col("source_path"))).select(F.trim("source_path").alias("path"))
    return files.join(used, "path", "left_anti").select("path", "size_bytes").orderBy("path").limit(most)


def text_mismatches(units: DataFrame, texts: DataFrame) -> DataFrame:
    """(unit_id, source): units (unit_id, source, start_byte, end_byte, text) whose trimmed text differs from the bytes at their span; a span outside the text holds nothing, units without a span or a text are left out."""
    spanned = units.where("start_byte is not null and end_byte is not null")
    return with_bytes(spanned, texts, "source", "source_text").where(F.col("size_").isNotNull() & (F.trim(F.coalesce("raw_", F.lit(""))) != F.trim("text"))).select("unit_id", "source")


def corpus_index(sources: DataFrame, units: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source_id, kind, position, id): unit and chunk ids of each declared source in input order, as rows, so that no source is gathered in one."""
    u = units.select(F.explode("source_ids").alias("source_id"), F.lit("unit").alias("kind"), F.col("ord").alias("position"), F.col("unit_id").alias("id"))
    c = chunks.select("source_id", F.lit("chunk").alias("kind"), F.col("ord").alias("position"), F.col("chunk_id").alias("id"))
    return u.unionByName(c).join(sources.select("source_id").distinct(), "source_id", "left_semi")


def histograms(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(axis, value, n): a histogram of each column in one pass; nulls count as empty."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns)))
    return rows.select(pairs.alias("p")).groupBy("p.axis", "p.value").agg(F.count(F.lit(1)).alias("n"))


def governance_summary(nodes: DataFrame) -> DataFrame:
    """One row: nodes, active ones, their share, and stale ones (repealed or amended)."""
    out = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status").isin("repealed", "amended")).alias("stale"))
    return out.withColumn("active_ratio", F.when(F.col("nodes") > 0, F.col("active") / F.col("nodes")).otherwise(F.lit(0.0)))


def node_errors(nodes: DataFrame) -> DataFrame:
    """(node_id, error): every rule that a node breaks."""
    bad = lambda c, p: ~F.coalesce(F.col(c), F.lit("")).rlike(p)
    depth = F.create_map(*(F.lit(x) for kv in NODE_DEPTH.items() for x in kv))[F.col("node_type")]
    known = F.coalesce(F.col("node_type").isin(*NODE_DEPTH, *SEMANTIC_TYPES), F.lit(False))
    not_in = lambda c, values: ~F.coalesce(F.col(c).isin(*values), F.lit(False))
    rules = {
        "node_id": bad("node_id", NODE_ID), "document_id": bad("document_id", NODE_ID), "node_type": ~known, "canonical_ref": is_blank(F.col("canonical_ref")), "display_ref": is_blank(F.col("display_ref")),
        "depth_range": ~F.col("depth").between(0, 7), "depth_of_type": depth.isNotNull() & (F.col("depth") != depth), "ordinal_path": bad("ordinal_path", ORDINAL), "source_hash": bad("source_hash", HASH),
        "status": not_in("status", NODE_STATUS), "priority": not_in("priority", PRIORITIES), "domain": is_blank(F.col("domain")),
    }
    return nodes.select("node_id", F.explode(F.array_compact(F.array(*(F.when(on, name) for name, on in rules.items())))).alias("error"))


def span_coverage(nodes: DataFrame, source_bytes: int | Column) -> DataFrame:
    """One row: nodes with and without a valid span, bytes covered, and their share of the source, at most 1."""
    total = F.lit(source_bytes) if isinstance(source_bytes, int) else source_bytes
    valid = F.coalesce((F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line")), F.lit(False))
    out = nodes.agg(F.count_if(valid).alias("with_span"), F.count_if(~valid).alias("without_span"), F.coalesce(F.sum(F.when(valid, F.col("byte_length"))), F.lit(0)).alias("covered_bytes"))
    return out.withColumn("coverage_ratio", F.when(total > 0, F.least(F.col("covered_bytes") / total, F.lit(1.0))).otherwise(F.lit(0.0)))


def overall_compliance(assessments: DataFrame, key: str) -> DataFrame:
    """(key, overall) of assessments (key, compliance): satisfied if all are satisfied or not applicable, else not satisfied before partial."""
    has = lambda *v: F.bool_or(F.col("compliance").isin(*v))
    worst = F.when(~F.coalesce(has("not_satisfied", "partial"), F.lit(False)), "satisfied").when(has("not_satisfied"), "not_satisfied").otherwise("partial")
    return assessments.groupBy(key).agg(worst.alias("overall"))


def control_verdict(results: DataFrame) -> DataFrame:
    """One row of results (control_id, status, gate_mode): tallies, blocking failures, and whether the gate passes."""
    out = results.agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "failed") & (F.col("gate_mode") == "blocking")).alias("blocking_failures"))
    return out.withColumn("gate_passes", F.col("blocking_failures") == 0)


def snapshot_sources(records: DataFrame) -> DataFrame:
    """(source_type, records, web_sources): records without a type are unspecified."""
    kind = F.when(is_blank(F.col("source_type")), "unspecified").otherwise(F.col("source_type"))
    return records.groupBy(kind.alias("source_type")).agg(F.count(F.lit(1)).alias("records"), F.count("web_source").alias("web_sources"))
