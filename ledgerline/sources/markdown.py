"""Markdown sources: contiguous block segments with byte and line spans, in one pass over each text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parsed

SEGMENT = "source string, seq int, kind string, level int, start_byte long, end_byte long, start_line int, end_line int, text string, text_hash string"
_HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_KINDS = (
    ("rule", re.compile(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*$")), ("table", re.compile(r"\s*\|.*\|\s*$")), ("quote", re.compile(r"\s{0,3}>")),
    ("list", re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])\s+")), ("html", re.compile(r"\s{0,3}</?[A-Za-z!][^>]*>")),
)


def line_kind(line: str) -> str:
    if not line.strip():
        return "blank"
    if _HEADING.match(line):
        return "heading"
    return next((k for k, p in _KINDS if p.match(line)), "paragraph")


def blocks(text: str) -> Iterator[tuple[str, int, list[str], int]]:
    """(kind, level, lines with their line ends, first line) of consecutive blocks; together they are the whole text.

    A fence runs to its closing line or the end; a list goes on over indented lines; other kinds run while the kind lasts, headings alone.
    """
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text)
    i = 0
    while i < len(lines):
        j, fence = i + 1, _FENCE.match(lines[i])
        if fence:
            close = re.compile(rf"\s{{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$")
            while j < len(lines) and not close.match(lines[j]):
                j += 1
            yield "code", 0, lines[i : j + 1], i
            i = min(j + 1, len(lines))
            continue
        kind = line_kind(lines[i])
        head = _HEADING.match(lines[i])
        if kind not in ("heading", "rule"):
            while j < len(lines) and not _FENCE.match(lines[j]):
                same = line_kind(lines[j])
                if same != kind and not (kind == "list" and same != "blank" and lines[j][:2] == "  "):
                    break
                j += 1
        yield kind, len(head[1]) if kind == "heading" and head else 0, lines[i:j], i
        i = j


def markdown_segments(docs: DataFrame) -> DataFrame:
    """Root segments of ``docs(source, text)``, without gaps or overlaps; null text has none. A source is a row, so rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

        def parse(source: str, text: str | None) -> Iterator[tuple]:
            at = 0
            for seq, (kind, level, lines, first) in enumerate(blocks(text or "")):
                raw = "".join(lines)
                data = raw.encode()
                yield source, seq, kind, level, at, at + len(data), first + 1, first + len(lines), raw, hashlib.sha256(data).hexdigest()
                at += len(data)

        return parsed(batches, parse, names, types)

    return docs.select(F.col("source").cast("string"), "text").mapInArrow(run, SEGMENT)


def heading_title(text):
    """Title of a heading segment, as a Column."""
    return F.regexp_extract(text, r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
