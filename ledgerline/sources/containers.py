"""Container blocks of Markdown: what lists, quotes, callouts and tables hold, with parents and byte spans.

Root blocks come from ``markdown.blocks``. Those that hold others are opened from a stack of work: a list gives its items by their indentation, an item the
blocks of its own lines, a quote the blocks behind its markers, a table its header, rows and cells. Paragraphs, items, cells and headings give the
references in their lines. A segment names its parent, so every cell, item and reference hangs below a root segment, and a child lies within its parent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.selection import INLINE_REFERENCE

from .batches import parsed
from .markdown import blocks

TREE = "source string, segment_id string, parent_id string, kind string, depth int, start_byte long, end_byte long, start_line int, end_line int, text string, text_hash string, row_index int, row_text string, table_role string"
_TYPES = [pa.string()] * 4 + [pa.int32()] + [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.string()] * 2 + [pa.int32()] + [pa.string()] * 2
_ITEM = re.compile(r"( *)(?:[-*+]|\d{1,9}[.)])(\s+)")
_QUOTE = re.compile(r" {0,3}> ?")
_CALLOUT = re.compile(r"\s*>?\s*\[!(\w+)\]")
_REFERENCE = re.compile(INLINE_REFERENCE)
_SEPARATOR = re.compile(r"\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*")
#: Fixed labels, English and French, of tables that describe the document: a key column and a value column, in either order.
_KEYS, _VALUES = {"field", "champ", "key", "cle", "clé", "property", "propriete", "propriété"}, {"value", "valeur", "setting", "statut", "status"}
_RENAMED = {"quote": "blockquote", "code": "code_block", "rule": "decorative_separator", "html": "unsupported_block"}

Line = tuple[int, str, int]  # byte at which it starts, its text with its end, its number


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _cut(line: Line, chars: int) -> Line:
    return line[0] + _size(line[1][:chars]), line[1][chars:], line[2]


def cells(line: str) -> list[tuple[int, int]]:
    """Spans of the cells of a table's line, between bars; a backslash keeps a bar within its cell, and what stands outside the outer bars is a cell unless blank."""
    body = line.rstrip("\r\n")
    bars = [m.start() for m in re.finditer(r"(?<!\\)\|", body)]
    edges = [-1, *bars, len(body)]
    spans = [(a + 1, b) for a, b in zip(edges, edges[1:])]
    return [s for k, s in enumerate(spans) if 0 < k < len(spans) - 1 or body[s[0] : s[1]].strip()] if bars else []


def is_metadata(header: list[str]) -> bool:
    """Two columns, one named as a key and one as a value."""
    names = {h.strip(" *_`:").lower() for h in header}
    return len(header) == 2 and bool(names & _KEYS) and bool(names & _VALUES)


def row_text(header: list[str], row: list[str]) -> str:
    """``column=value; column=value`` of the cells that are not blank."""
    return "; ".join(f"{header[i]}={x}" if i < len(header) and header[i] else x for i, x in enumerate(row) if x)


class Tree:
    """The segments of one source, parents before children; ``work`` holds containers still to be opened."""

    def __init__(self, source: str, text: str):
        self.source, self.rows, self.work = source, [], []
        lines, at = [], 0
        for n, line in enumerate(re.findall(r"[^\n]*\n|[^\n]+$", text)):
            lines.append((at, line, n + 1))
            at += _size(line)
        self.hold(None, 0, lines)
        while self.work:
            step, *known = self.work.pop()
            step(*known)
        self.rows.sort(key=lambda r: (r[5], -r[6], r[4]))

    def add(self, parent: str | None, depth: int, kind: str, lines: list[Line], row_index: int | None = None, row: str | None = None, role: str | None = None) -> str:
        start, end = lines[0][0], lines[-1][0] + _size(lines[-1][1])
        own = f"seg:{self.source}:{start}-{end}:{kind}"
        text = "".join(x[1] for x in lines)
        self.rows.append((self.source, own, parent, kind, depth, start, end, lines[0][2], lines[-1][2], text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), row_index, row, role))
        return own

    def hold(self, parent: str | None, depth: int, lines: list[Line]) -> None:
        """The blocks of a container's lines."""
        for kind, _, own, first in blocks("".join(x[1] for x in lines)):
            mine = lines[first : first + len(own)]
            if kind == "table" and not (len(mine) > 1 and _SEPARATOR.fullmatch(mine[1][1].rstrip("\r\n"))):
                kind = "paragraph"
            if kind == "quote" and _CALLOUT.match(mine[0][1]):
                kind = "callout"
            if kind == "blank" and parent is not None:
                continue
            me = self.add(parent, depth, _RENAMED.get(kind, kind), mine)
            if kind in ("paragraph", "heading"):
                self.references(me, depth + 1, mine)
            elif kind in ("quote", "callout"):
                inner = [_cut(x, m.end() if (m := _QUOTE.match(x[1])) else 0) for x in mine]
                if kind == "callout":
                    inner = inner[1:]
                if inner:
                    self.work.append((self.hold, me, depth + 1, inner))
            elif kind == "list":
                self.work.append((self.items, me, depth + 1, mine))
            elif kind == "table":
                self.table(me, depth + 1, mine)

    def items(self, parent: str, depth: int, lines: list[Line]) -> None:
        """Items of one list: each from its marker to the next at its own indentation or less; lines indented further are within it."""
        starts, column = [], None
        for i, (_, line, _) in enumerate(lines):
            m = _ITEM.match(line)
            if m and (column is None or len(m[1]) <= column + 1):
                column = len(m[1]) if column is None else min(column, len(m[1]))
                starts.append(i)
        for a, b in zip(starts, [*starts[1:], len(lines)]):
            own = lines[a:b]
            me = self.add(parent, depth, "list_item", own)
            head = _ITEM.match(own[0][1])
            self.references(me, depth + 1, own[:1])
            rest = [_cut(x, min(len(head[0]), len(x[1]) - len(x[1].lstrip(" ")))) for x in own[1:]]
            nested = next((k for k, x in enumerate(rest) if _ITEM.match(x[1]) or _QUOTE.match(x[1])), None)
            if nested is None:
                self.references(me, depth + 1, own[1:])
            else:
                self.references(me, depth + 1, rest[:nested])
                self.work.append((self.hold, me, depth + 1, rest[nested:]))

    def table(self, parent: str, depth: int, lines: list[Line]) -> None:
        names = [lines[0][1][a:b].strip() for a, b in cells(lines[0][1])]
        role = "metadata_table" if is_metadata(names) else None
        for i, line in enumerate(lines):
            kind = "table_header" if i == 0 else "table_separator" if i == 1 else "table_row"
            spans = cells(line[1]) if i != 1 else []
            values = [line[1][a:b].strip() for a, b in spans]
            me = self.add(parent, depth, kind, [line], i - 2 if i > 1 else None, row_text(names, values) if i > 1 else None, role)
            for a, b in spans:
                if b > a:
                    start = line[0] + _size(line[1][:a])
                    cell = self.add(me, depth + 1, "table_cell", [(start, line[1][a:b], line[2])])
                    self.references(cell, depth + 2, [(start, line[1][a:b], line[2])])

    def references(self, parent: str, depth: int, lines: list[Line]) -> None:
        for line in lines:
            for m in _REFERENCE.finditer(line[1]):
                self.add(parent, depth, "image_ref" if m[1] else "link", [(line[0] + _size(line[1][: m.start()]), m[0], line[2])])


def markdown_tree(docs: DataFrame) -> DataFrame:
    """All segments of ``docs(source, text)``: root blocks (depth 0, which tile the text) and what they hold; null text has none. A source is a row, so rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in TREE.split(", ")]
        return parsed(batches, lambda source, text: Tree(source, text or "").rows, names, _TYPES)

    return docs.select(F.col("source").cast("string"), "text").mapInArrow(run, TREE)
