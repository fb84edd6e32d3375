"""Integrity of segment ledgers and of feeds: rules on one row in one pass, one shuffle for each rule across rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank, once
from ledgerline.sources.shared import ensure_checkpoints

from .pieces import running_max
from .segments import duplicate_findings

#: What alone makes no atom (a table separator line has no other characters), and what backs no chunk.
JUNK = r"(?U)^[-_*~|.,;:!?()\[\]{}<>+=`\s]*$"
DISPOSITIONS = ("canonical_atom", "structure_only", "coverage_only", "excluded_by_policy", "unsupported_blocking")
NON_SEMANTIC_KINDS = ("blank", "decorative_separator", "table_separator", "metadata", "structure_only")


def is_junk_atom(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(JUNK)


def _invalid_range(of: Callable[[str], Column] = F.col) -> Column:
    one_line = (of("start_line") == of("end_line")) & (of("start_column") > of("end_column"))
    return (of("start_byte") > of("end_byte")) | (of("start_line") > of("end_line")) | one_line


def segment_error() -> Column:
    """The first rule that a segment breaks, else null. Each column is named once, so a filter on the error doesn't multiply what the columns are computed from."""
    named = ("segment_id", "source_id", "source_path", "kind")

    def broken(x: Column) -> Column:
        atom, blanks = x["disposition"] == "canonical_atom", F.when(F.lit(False), "")
        for c in named:
            blanks = blanks.when(is_blank(x[c]), f"{c} must be non-empty")
        return (
            blanks.when(~x["disposition"].isin(*DISPOSITIONS) | x["disposition"].isNull(), "disposition is not a recognised value")
            .when(x["start_byte"] > x["end_byte"], "start_byte must be <= end_byte").when(x["start_line"] > x["end_line"], "start_line must be <= end_line").when(_invalid_range(lambda c: x[c]), "start_column must be <= end_column")
            .when((x["disposition"] == "unsupported_blocking") & is_blank(x["unsupported_reason"]), "unsupported_reason must be non-empty")
            .when(atom & is_blank(x["raw_text_hash"]), "raw_text_hash must be non-empty").when(atom & is_blank(x["normalized_text_hash"]), "normalized_text_hash must be non-empty")
        )

    return once(F.struct(*named, "disposition", "start_byte", "end_byte", "start_line", "end_line", "start_column", "end_column", "unsupported_reason", "raw_text_hash", "normalized_text_hash"), broken)


def uncovered_ranges(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, start_byte, end_byte) of ``sources(source_id, total_bytes)`` that no segment covers, the ends included."""
    spans = segments.where("start_byte <= end_byte").select("source_id", "start_byte", "end_byte")
    ends = sources.select("source_id", F.explode(F.array(F.lit(0).cast("long"), F.col("total_bytes").cast("long"))).alias("start_byte")).withColumn("end_byte", F.col("start_byte"))
    known = spans.join(sources.select("source_id"), "source_id", "left_semi")
    gaps = running_max(known.unionByName(ends), "source_id", ["start_byte", "end_byte"], "end_byte", "reach").where("start_byte > reach")
    return gaps.select("source_id", F.col("reach").alias("start_byte"), F.col("start_byte").alias("end_byte"))


def source_integrity(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, segment_id, code, start_byte, end_byte): all findings on a ledger; the first of equal atom spans, by segment id, stays."""
    ensure_checkpoints(segments.sparkSession)
    atom = F.col("disposition") == "canonical_atom"
    rules = F.array(
        F.when(_invalid_range(), "SOURCE_SEGMENT_INVALID_RANGE"),
        F.when(atom & (is_blank(F.col("raw_text_hash")) | is_blank(F.col("normalized_text_hash"))), "SOURCE_SEGMENT_MISSING_HASH"),
        F.when(F.col("disposition") == "unsupported_blocking", "SOURCE_UNSUPPORTED_BLOCKING"),
        F.when(atom & is_junk_atom(F.col("text")), "SOURCE_JUNK_SEMANTIC_ATOM"),
    )
    place = ["source_id", "segment_id", "code", "start_byte", "end_byte"]
    own = segments.select("source_id", "segment_id", "start_byte", "end_byte", F.explode(F.array_compact(rules)).alias("code"))
    atoms = segments.where(atom).select("segment_id", "source_id", "start_byte", "end_byte", F.struct("source_id", "start_byte", "end_byte").alias("span_")).checkpoint()
    dup = duplicate_findings(atoms, "span_", ["segment_id"]).withColumn("code", F.lit("SOURCE_DUPLICATE_SEMANTIC_SPAN"))
    gaps = uncovered_ranges(segments, sources).withColumns({"segment_id": F.lit(""), "code": F.lit("SOURCE_UNCOVERED_RANGE")})
    return own.select(*place).unionByName(dup.select(*place)).unionByName(gaps.select(*place))


def source_derived() -> Column:
    """Whether a unit bears any mark of a source segment."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return said("source_segment_id") | said("source_path") | said("normalized_text_hash") | (F.col("start_byte") != 0) | (F.col("end_byte") != 0) | (F.size(F.coalesce("heading_path", F.array().cast("array<string>"))) > 0)


def chunk_findings(chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, code) of chunks (chunk_id, canonical_unit_id, unit_ids, source_segment_id) against a ledger (segment_id, disposition, kind)."""
    known = segments.select(F.trim("segment_id").alias("asked"), "disposition", "kind", F.lit(True).alias("known"))
    rows = chunks.withColumn("asked", F.trim("source_segment_id")).join(known, "asked", "left")
    non_semantic = (F.col("disposition") != "canonical_atom") | F.col("kind").isin(*NON_SEMANTIC_KINDS)
    rules = F.array(
        F.when(is_blank(F.col("canonical_unit_id")) & (F.size(F.coalesce("unit_ids", F.array().cast("array<string>"))) == 0), "RAG_CHUNK_NO_UNIT"),
        F.when(F.col("known").isNull(), "RAG_CHUNK_NO_SEGMENT").when(non_semantic, "RAG_CHUNK_NON_SEMANTIC_SOURCE"),
    )
    return rows.select(F.col("chunk_id").alias("id"), F.explode(F.array_compact(rules)).alias("code"))


def feed_quality(units: DataFrame, chunks: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, code): findings on source-derived units and on chunks; units without any mark of a source are left out."""
    ensure_checkpoints(units.sparkSession)
    own = units.where(source_derived())
    segment = ~is_blank(F.col("source_segment_id"))
    rules = F.array(
        F.when(~segment, "FEED_UNIT_NO_SEGMENT"),
        F.when(segment & is_blank(F.col("source_id")), "FEED_UNIT_NO_SOURCE"),
        F.when(segment & (F.col("start_byte") == 0) & (F.col("end_byte") == 0), "FEED_UNIT_NO_SPAN"),
        F.when(is_blank(F.col("text")), "FEED_EMPTY_TEXT").when(is_junk_atom(F.col("text")), "FEED_JUNK_TEXT"),
    )
    found = own.select(F.col("unit_id").alias("id"), F.explode(F.array_compact(rules)).alias("code"))
    spans = own.where(segment & ~((F.col("start_byte") == 0) & (F.col("end_byte") == 0))).select("unit_id", F.struct("source_id", "start_byte", "end_byte").alias("span_")).checkpoint()
    dup = duplicate_findings(spans, "span_", ["unit_id"]).select(F.col("unit_id").alias("id"), F.lit("FEED_DUPLICATE_SPAN").alias("code"))
    return found.unionByName(dup).unionByName(chunk_findings(chunks, segments))


def context_findings(units: DataFrame, cells_need_rows: bool = True, metadata_tables: bool = False, mismatch: str = "informational") -> DataFrame:
    """(unit_id, code, severity): cells without their row, leaked metadata tables, and values that differ from their text."""
    bare = is_blank(F.col("table_id")) | (F.size(F.coalesce("column_headers", F.array().cast("array<string>"))) == 0)
    said = ~(is_blank(F.col("raw_text")) & is_blank(F.col("decoded_value")))
    differs = said & (F.coalesce("business_rule_mode", F.lit("")) != "raw") & (F.trim(F.coalesce("raw_text", F.lit(""))) != F.trim(F.coalesce("decoded_value", F.lit(""))))
    finding = lambda on, code, severity: F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    rules = F.array(
        finding(F.lit(cells_need_rows) & (F.col("kind") == "table_cell") & bare, "FEED_TABLE_CELL_NOT_ROW_CONTEXT", "blocking"),
        finding(F.lit(not metadata_tables) & (F.col("table_role") == "metadata_table"), "FEED_METADATA_TABLE_LEAKED", "blocking"),
        finding(differs, "FEED_RAW_DECODED_MISMATCH", mismatch),
    )
    return units.select("unit_id", F.explode(F.array_compact(rules)).alias("f")).select("unit_id", "f.code", "f.severity")


def gate_status(findings: DataFrame) -> DataFrame:
    """One row: the number of findings, and pass only without any."""
    return findings.agg(F.count(F.lit(1)).alias("findings")).withColumn("status", F.when(F.col("findings") == 0, "pass").otherwise("fail"))
