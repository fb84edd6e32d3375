"""Record encoders, referential checks, cross references and table rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode(records: DataFrame, shape: str, text: str, ident: str, metadata: list[str]) -> DataFrame:
    """One JSON line per record: ``neutral`` (flat, blank values left out), ``document`` (page_content, metadata) or ``node`` (id_, text, metadata)."""
    present = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in metadata]
    if shape == "neutral":
        body = F.struct(F.col(ident), F.col(text), *present)
    elif shape == "document":
        body = F.struct(F.col(text).alias("page_content"), F.struct(F.col(ident), *present).alias("metadata"))
    elif shape == "node":
        body = F.struct(F.col(ident).alias("id_"), F.col(text).alias("text"), F.struct(*present).alias("metadata"))
    else:
        raise ValueError(f"unknown shape {shape!r}")
    return records.select(F.to_json(body, {"ignoreNullFields": "true"}).alias("value"))


def referential_findings(rows: DataFrame, key: list[str], checks: list[tuple[str, list[str], DataFrame]]) -> DataFrame:
    """(key, code): rows whose columns name nothing in a table, for each (code, columns, table), and keys that come twice."""
    ident = F.concat_ws("/", *key).alias("id")
    out = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(ident, F.lit("DUPLICATE_ID").alias("code"))
    for code, cols, table in checks:
        known = table.toDF(*cols).distinct()
        out = out.unionByName(rows.join(known, cols, "left_anti").select(ident, F.lit(code).alias("code")))
    return out


def cross_references(atoms: DataFrame, text: str) -> DataFrame:
    """(source, locator, target): cues like "article 12" in atoms (atom_id, locator, text), joined to the first atom of the locator; none to itself."""
    cues = F.regexp_extract_all(text, F.lit(r"(?i)((?:article|section|annex)\s+[0-9]+)"), F.lit(1))
    hits = atoms.select(F.col("atom_id").alias("source"), F.explode(F.transform(cues, normal_locator)).alias("locator")).distinct()
    first = atoms.groupBy(normal_locator(F.col("locator")).alias("locator")).agg(F.min("atom_id").alias("target"))
    return hits.join(first, "locator", "left").where("target is null or target <> source")


def normal_locator(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", "-")


def row_cells(line: Column) -> Column:
    """Trimmed cells of a pipe row, the empty ones outside the first and last pipe left out."""
    bare = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.transform(F.split(bare, r"\|", -1), lambda x: F.trim(x))


def row_text(headers: Column, cells: Column) -> Column:
    """``Header=cell; Header=cell`` over the cells that aren't blank."""
    pairs = F.zip_with(headers, cells, lambda h, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat_ws("=", h, c)))
    return F.array_join(F.array_compact(pairs), "; ")


def envelope(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, members, envelope_hash): a group's members sealed by the hash of their sorted (order, content_hash)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order), F.col("content_hash"))))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.sha2(F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p[order].cast("string"), p["content_hash"])), ";"), 256).alias("envelope_hash"))


def bill_of_materials(rows: DataFrame, group: str) -> DataFrame:
    """(group, bom): the group's components (name, version, hash) as one JSON document, sorted by name."""
    parts = F.array_sort(F.collect_list(F.struct("name", "version", "hash")))
    return rows.groupBy(group).agg(F.to_json(F.struct(F.lit("1.5").alias("specVersion"), parts.alias("components"))).alias("bom"))


def similarity(a: Column, b: Column) -> Column:
    """Characters in common, with repeats, over the longer one's bytes; 1 for equal texts."""
    counts = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    shared = F.aggregate(F.array_distinct(counts(a)), F.lit(0), lambda n, ch: n + F.least(F.length(a) - F.length(F.replace(a, ch, F.lit(""))), F.length(b) - F.length(F.replace(b, ch, F.lit("")))))
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(a == b, 1.0).otherwise(F.round(shared / longest, 4))
