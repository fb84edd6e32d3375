"""Markdown below block level, with byte spans: inline references, table cells, list items. All are expressions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.arrays import running_sums

from .selection import INLINE_REFERENCE

#: A cell border that no backslash escapes, and a list item's indent and marker.
BORDER = r"(?<!\\)\|"
ITEM = r"^(\s*)([-*+]|\d+[.)])\s+"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_references(lines: DataFrame) -> DataFrame:
    """(source, line_no, kind, label, target, start_byte, end_byte) of links and images in lines (source, line_no, start_byte, line); gaps and matches of one pattern add up to the positions."""
    p = _sql(INLINE_REFERENCE)
    found = lines.where(F.col("line").rlike(INLINE_REFERENCE)).withColumns({"gaps": F.expr(f"split(line, {p}, -1)"), **{f"m{k}": F.expr(f"regexp_extract_all(line, {p}, {k})") for k in range(4)}})
    starts = running_sums("transform(m0, (x, i) -> octet_length(x) + octet_length(gaps[i]))")
    rows = found.select("source", "line_no", "start_byte", F.posexplode(F.expr(f"transform({starts}, (at, i) -> named_struct('at', at + octet_length(gaps[i]), 'size', octet_length(m0[i]), 'bang', m1[i], 'label', m2[i], 'target', m3[i]))")).alias("nth", "m"))
    start = F.col("start_byte") + F.col("m.at")
    return rows.select("source", "line_no", F.when(F.col("m.bang") == "!", "image_ref").otherwise("link").alias("kind"), "m.label", F.trim("m.target").alias("target"), start.alias("start_byte"), (start + F.col("m.size")).alias("end_byte"))


def table_cells(lines: DataFrame) -> DataFrame:
    """(source, line_no, cell_no, text, start_byte, end_byte) of the cells of table rows; what stands before a leading and behind a trailing border is none."""
    parts = F.split("line", BORDER, -1)
    rows = lines.where(F.col("line").rlike(BORDER)).withColumn("parts", parts)
    starts = running_sums("transform(parts, x -> octet_length(x) + 1)")
    cells = rows.select("source", "line_no", "start_byte", F.size("parts").alias("n"), F.posexplode(F.expr(f"transform({starts}, (at, i) -> named_struct('at', at, 'text', parts[i]))")).alias("nth", "c"))
    inner = cells.where(~((F.trim("c.text") == "") & ((F.col("nth") == 0) | (F.col("nth") == F.col("n") - 1))))
    start = F.col("start_byte") + F.col("c.at")
    return inner.select("source", "line_no", F.col("nth").alias("cell_no"), F.trim("c.text").alias("text"), start.alias("start_byte"), (start + F.octet_length("c.text")).alias("end_byte"))


def list_items(lines: DataFrame) -> DataFrame:
    """(source, line_no, marker, depth, text, start_byte, end_byte): an item's depth is half its indent, its span the text behind the marker."""
    head = F.regexp_extract("line", f"({ITEM})", 1)
    text = F.substring(F.col("line"), F.length(head) + 1, F.length("line"))
    start = F.col("start_byte") + F.octet_length(head)
    rows = lines.where(F.col("line").rlike(ITEM))
    return rows.select("source", "line_no", F.regexp_extract("line", ITEM, 2).alias("marker"), F.floor(F.length(F.regexp_extract("line", ITEM, 1)) / 2).cast("int").alias("depth"), text.alias("text"), start.alias("start_byte"), (start + F.octet_length(text)).alias("end_byte"))
