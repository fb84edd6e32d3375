"""JSON and YAML sources: every leaf with its path, kind and exact span, and segments that cover a source byte by byte."""

from __future__ import annotations

import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import yaml_scan
from .batches import parsed
from .places import Places, tiled

SCALAR = "source string, path string, kind string, value string, start int, end int"
_SPACE, _ATOM = re.compile(r"\s*"), re.compile(r"true|false|null|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


def leaves(text: str) -> list[tuple[str, str, str | None, int, int]]:
    """(path, kind, decoded value, start, end) of a document's leaves, in order; paths are dotted keys and bracketed places.

    Malformed text is a ValueError. The stack is explicit, so depth is not bounded by recursion.
    """
    out, at, stack, path = [], 0, [], ""

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def need(i: int, chars: str) -> str:
        if i >= len(text) or text[i] not in chars:
            raise ValueError(f"one of {chars!r} is needed at {i}")
        return text[i]

    def key(i: int) -> tuple[str, int]:
        need(i, '"')
        name, i = scanstring(text, i + 1)
        i = skip(i)
        need(i, ":")
        return name, skip(i + 1)

    at = skip(0)
    while True:
        opened = text[at : at + 1]
        if opened in ("{", "["):
            inner = skip(at + 1)
            if text[inner : inner + 1] == {"{": "}", "[": "]"}[opened]:
                at = inner + 1
            elif opened == "{":
                stack.append(("}", path, 0))
                name, at = key(inner)
                path = f"{path}.{name}" if path else name
                continue
            else:
                stack.append(("]", path, 0))
                path, at = f"{path}[0]", inner
                continue
        elif opened == '"':
            value, end = scanstring(text, at + 1)
            out.append((path, "string", value, at, end))
            at = end
        else:
            m = _ATOM.match(text, at)
            if not m:
                raise ValueError(f"no value at {at}")
            kind = {"true": "boolean", "false": "boolean", "null": "null"}.get(m[0], "number")
            out.append((path, kind, None if kind == "null" else m[0], at, m.end()))
            at = m.end()
        while True:
            at = skip(at)
            if not stack:
                if at < len(text):
                    raise ValueError(f"text after the document at {at}")
                return out
            close, outer, n = stack.pop()
            if need(at, close + ",") == close:
                path, at = outer, at + 1
                continue
            at = skip(at + 1)
            stack.append((close, outer, n + 1))
            if close == "}":
                name, at = key(at)
                path = f"{outer}.{name}" if outer else name
            else:
                path = f"{outer}[{n + 1}]"
            break


def json_scalars(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs(source, text)``; a malformed text is one row of kind ``error`` with the message, null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [x.split()[0] for x in SCALAR.split(", ")], [pa.string()] * 4 + [pa.int32()] * 2

        def parse(source: str, text: str | None) -> list[tuple]:
            try:
                return [(source, *x) for x in leaves(text)] if text is not None else []
            except ValueError as e:
                return [(source, "", "error", str(e), 0, len(text))]

        return parsed(batches, parse, names, types)

    return docs.select(F.col("source").cast("string"), "text").mapInArrow(run, SCALAR)


SEGMENT = "source string, segment_id string, kind string, path string, node_kind string, value string, start_byte long, end_byte long, start_line int, start_column int, end_line int, end_column int"
_SEGMENT_TYPES = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.int32()] * 4


def scalars(form: str, text: str) -> list[tuple[str, str, str, int, int]]:
    """(path, node kind, value, start, end) of a text's leaves in order; node kinds tell integers from other numbers. A JSON text that is one scalar has the path ``$``."""
    if form == "yaml":
        return yaml_scan.leaves(text)
    if form != "json":
        raise ValueError(f"unknown format {form!r}")
    kinds = {"string": "scalar_string", "boolean": "scalar_bool", "null": "scalar_null"}
    return [(path or "$", kinds.get(kind) or ("scalar_float" if set(value) & set(".eE") else "scalar_int"), "" if value is None else value, start, end) for path, kind, value, start, end in leaves(text)]


def segments(source: str, form: str, text: str) -> list[tuple]:
    """Rows of ``SEGMENT``: a leaf each, and ``structured_coverage`` for what lies between leaves. Malformed text is one row of kind ``error`` that covers it."""
    places = Places(text)
    try:
        found = [(places.byte(start), places.byte(end), path, kind, value) for path, kind, value, start, end in scalars(form, text)]
        kind_of = f"{form}_scalar"
    except ValueError as e:
        found, kind_of = [(0, places.size, "", "error", str(e))], "error"
    rows = []
    for start, end, leaf in tiled(found, places.size):
        kind = kind_of if leaf else "structured_coverage"
        rows.append((source, f"seg:{source}:{start}-{end}:{kind}", kind, *(leaf[2:] if leaf else (None, None, None)), start, end, *places.line(start), *places.line(end)))
    return rows


def structured_segments(docs: DataFrame) -> DataFrame:
    """Leaves and gaps of ``docs(source, format, text)``, format ``json`` or ``yaml``; they cover each text once. Null text has none; leaves without bytes have none either. A source is a row, so rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SEGMENT.split(", ")]
        return parsed(batches, lambda source, form, text: segments(source, form, text) if text is not None else [], names, _SEGMENT_TYPES)

    return docs.select(F.col("source").cast("string"), "format", "text").mapInArrow(run, SEGMENT)


def coverage(rows: DataFrame) -> DataFrame:
    """(source, leaves, bytes, tiles) of segments: ``tiles`` says that they cover the bytes from 0 to the last without gap or overlap.

    Every end but the last has to be a start and every start but 0 an end, so xors of their hashes cancel; no group is sorted.
    """
    ends = F.bit_xor(F.xxhash64("start_byte")).bitwiseXOR(F.bit_xor(F.xxhash64("end_byte")))
    size = F.max("end_byte")
    edges = F.xxhash64(F.lit(0).cast("long")).bitwiseXOR(F.xxhash64(size))
    tiles = (F.min("start_byte") == 0) & (F.sum(F.col("end_byte") - F.col("start_byte")) == size) & (ends == edges)
    return rows.groupBy("source").agg(F.count_if(F.col("kind").isin("json_scalar", "yaml_scalar", "text")).alias("leaves"), size.alias("bytes"), tiles.alias("tiles"))
