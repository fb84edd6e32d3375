"""XML and HTML sources: every run of characters with its element path, identity and exact byte span.

A stack of open elements with counters of like-named siblings gives paths such as ``/act/section[2]/p``. An identity is an attribute value that
holds the marker of a legislation identifier; it goes down to all that an element holds, and anchors the references of its atoms.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import parsed
from .places import Places, tiled

ATOM = "source string, kind string, path string, identity string, ref string, atom_id string, depth int, text string, text_hash string, start_byte long, end_byte long, start_line int, start_column int, end_line int, end_column int"
_TYPES = [pa.string()] * 6 + [pa.int32()] + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.int32()] * 4
#: Fixed by what identifiers look like; of XML only these attributes carry them.
MARKER, CARRIERS = "/eli/", ("about", "resource", "href", "id")
#: Fixed by HTML: elements without content, elements of raw text, and which element an opening tag closes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSED_BY = {"p": _CLOSES_P, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}, "head": {"body"}}

_XML = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![A-Z](?:[^<>\[]|\[[^\]]*\])*>|</(?P<close>[^\s<>/]+)\s*>|<(?P<open>[^\s<>/!?]+)(?P<rest>(?:\s+[^\s=<>/]+\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*)(?P<self>/?)>|(?P<text>[^<]+)", re.S)
_XML_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_XML_ENTITY = re.compile(r"&(?:(lt|gt|amp|apos|quot)|#([0-9]+)|#x([0-9a-fA-F]+));|&")
_XML_NAMES = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}
_HTML = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?P<close>[A-Za-z][^\s>/]*)[^>]*(?:>|\Z)|<(?P<open>[A-Za-z][^\s>/]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(?P<text><?[^<]*)", re.S)
_HTML_ATTRIBUTE = re.compile(r"[^\s=\"'/>]+\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _decoded(text: str, at: int) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return _XML_NAMES[m[1]]
        if not (m[2] or m[3]):
            raise ValueError(f"an entity that is not defined at {at + m.start()}")
        n = int(m[2]) if m[2] else int(m[3], 16)
        if n > 0x10FFFF or 0xD800 <= n < 0xE000:
            raise ValueError(f"no character {n} at {at + m.start()}")
        return chr(n)

    return _XML_ENTITY.sub(one, text) if "&" in text else text


class _Open:
    """An open element: its name, path, identity, and how many children of each name it has had."""

    __slots__ = ("name", "path", "identity", "children")

    def __init__(self, name: str, path: str, identity: str):
        self.name, self.path, self.identity, self.children = name, path, identity, Counter()

    def child(self, name: str, identity: str | None) -> _Open:
        self.children[name] += 1
        n = self.children[name]
        return _Open(name, f"{self.path}/{name}" + (f"[{n}]" if n > 1 else ""), identity or self.identity)


def xml_runs(text: str) -> Iterator[tuple[str, str, int, str, int, int]]:
    """(path, identity, depth, decoded text, start, end) of each run that is not blank, in order; comments, sections and tags divide runs. Spans are those of the raw run, blanks included. Text that is not well-formed is a ValueError."""
    at, stack = 0, [_Open("", "", "")]
    while at < len(text):
        m = _XML.match(text, at)
        if not m:
            raise ValueError(f"markup that is not well-formed at {at}")
        if m["open"]:
            local = m["open"].rpartition(":")[2]
            found = [(k.rpartition(":")[2], _decoded(a or b, at)) for k, a, b in _XML_ATTRIBUTE.findall(m["rest"])]
            own = stack[-1].child(local, next((v for k, v in found if k in CARRIERS and MARKER in v), None))
            if not m["self"]:
                own.name = m["open"]
                stack.append(own)
        elif m["close"]:
            if len(stack) == 1 or stack[-1].name != m["close"]:
                raise ValueError(f"an element that closes none at {at}")
            stack.pop()
        elif m["text"] is not None or m["cdata"] is not None:
            run = m["cdata"] if m["cdata"] is not None else _decoded(m["text"], at)
            if len(stack) > 1 and run.strip():
                yield stack[-1].path, stack[-1].identity, len(stack) - 1, run.strip(), at, m.end()
        at = m.end()
    if len(stack) > 1:
        raise ValueError(f"{stack[-1].name} is never closed")


def html_runs(text: str) -> Iterator[tuple[str, str, int, str, int, int]]:
    """As ``xml_runs``, for HTML, which is never malformed: missing end tags are supplied, others ignored. Scripts and styles give no run, spans leave out outer blanks, and text is as written (``html.unescape`` decodes it)."""
    at, stack = 0, [_Open("", "", "")]
    open_ = Counter()
    while at < len(text):
        m = _HTML.match(text, at)
        end = m.end()
        if m["open"]:
            name = m["open"].lower()
            while name in _CLOSED_BY.get(stack[-1].name, ()):
                open_[stack.pop().name] -= 1
            identity = next((v for v in (a or b or c for a, b, c in _HTML_ATTRIBUTE.findall(m["rest"])) if MARKER in v), None)
            own = stack[-1].child(name, identity)
            if name in _RAW:
                closing = re.compile(rf"</{name}\b[^>]*>", re.I).search(text, end)
                end = closing.end() if closing else len(text)
            elif name not in _VOID and not m["rest"].endswith("/"):
                stack.append(own)
                open_[name] += 1
        elif m["close"]:
            name = m["close"].lower()
            if open_[name]:
                while (gone := stack.pop().name) != name:
                    open_[gone] -= 1
                open_[name] -= 1
        elif m["text"] and (run := m["text"].strip()):
            start = at + m["text"].index(run)
            yield stack[-1].path, stack[-1].identity, len(stack) - 1, run, start, start + len(run)
        at = max(end, at + 1)


def atoms(source: str, form: str, text: str) -> list[tuple]:
    """Rows of ``ATOM``: runs as kind ``text``, all between them as kind ``markup``; together they cover the text once. Malformed XML is one row of kind ``error``."""
    places, spans, seen, rows = Places(text), [], Counter(), []
    try:
        for path, identity, depth, run, start, end in (xml_runs if form == "xml" else html_runs)(text):
            ref = f"{identity or source}#{path}"
            seen[ref] += 1
            ref += f"~{seen[ref]}" if seen[ref] > 1 else ""
            atom_id = "A-" + hashlib.sha256(ref.encode("utf-8", "replace")).hexdigest()[:16].upper()
            spans.append((places.byte(start), places.byte(end), path, identity, ref, atom_id, depth, run))
    except ValueError as e:
        return [(source, "error", "", "", "", "", 0, str(e), None, 0, places.size, 1, 1, *places.line(places.size))]
    for start, end, span in tiled(spans, places.size):
        where = (start, end, *places.line(start), *places.line(end))
        if span is None:
            rows.append((source, "markup", None, None, None, None, None, None, None, *where))
        else:
            rows.append((source, "text", *span[2:], hashlib.sha256(span[7].encode("utf-8", "replace")).hexdigest(), *where))
    return rows


def markup_atoms(docs: DataFrame) -> DataFrame:
    """Runs and gaps of ``docs(source, format, text)``, format ``xml`` or ``html``; null text has none, an unknown format is an error row. A source is a row, so rows are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ATOM.split(", ")]

        def parse(source: str, form: str, text: str | None) -> list[tuple]:
            if text is not None and form not in ("xml", "html"):
                return [(source, "error", "", "", "", "", 0, f"unknown format {form!r}", None, 0, len(text.encode()), 1, 1, 1, 1)]
            return atoms(source, form, text) if text is not None else []

        return parsed(batches, parse, names, _TYPES)

    return docs.select(F.col("source").cast("string"), "format", "text").mapInArrow(run, ATOM)


def plain_text(run: str) -> str:
    """An HTML run with its entities decoded."""
    return html.unescape(run)
