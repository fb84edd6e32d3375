"""Leaves of one YAML text with their exact character spans: block and flow collections on a stack of indentations.

The first document of a text is read: block and flow maps and lists, compact lists in lists, plain, quoted and block scalars over several lines,
comments, tags and anchors. Aliases give no leaf, as their content stands elsewhere. A map key that is itself a collection, text that fits
no place, and unclosed quotes or brackets are a ValueError. Lines end at line feeds.
"""

from __future__ import annotations

import re

#: Fixed by YAML's core schema.
_KINDS = (
    ("scalar_bool", re.compile(r"true|True|TRUE|false|False|FALSE")),
    ("scalar_int", re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")),
    ("scalar_float", re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")),
)
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}

_VOID = re.compile(r"(?:[ \t]*(?:#[^\n]*)?\n)*[ \t]*(?:#[^\n]*\Z)?")
_BLOCK_KEY = re.compile(r"""("(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\n]|'')*'|[^\s\-?:,\[\]{}#&*!|>'"%@`](?:[^\n:#]|:(?=\S)|(?<=\S)#)*|[-?:](?=\S)(?:[^\n:#]|:(?=\S)|(?<=\S)#)*)[ \t]*:(?=[ \t\n]|\Z)""")
_PROPERTY = re.compile(r"(?:[&!][^\s,\[\]{}]*[ \t]*)+")
_BLOCK_HEAD = re.compile(r"([|>])([1-9]?)([-+]?)([1-9]?)[ \t]*(?:#[^\n]*)?(?:\n|\Z)")
_PLAIN = re.compile(r"(?:[^\n:#]|:(?=[^\s])|(?<=\S)#)*")
_FLOW_PLAIN = re.compile(r"(?:[^\n:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)*")
_END = re.compile(r"(?:---|\.\.\.)(?=\s|\Z)")
_REST = re.compile(r"[ \t]*(?:[ \t]#[^\n]*)?(?=\n|\Z)")
_HEX = {"x": 2, "u": 4, "U": 8}


def kind_of(plain: str) -> str:
    return next((k for k, p in _KINDS if p.fullmatch(plain)), "scalar_string")


def folded(text: str) -> str:
    """Lines joined: one line end is a space, of several all but one stay."""
    return re.sub(r"[ \t]*\n[ \t]*(\n[ \t]*)*", lambda m: "\n" * (m[0].count("\n") - 1) or " ", text)


class Scan:
    """One pass over ``text``; ``leaves`` holds (path, kind, value, start, end)."""

    def __init__(self, text: str):
        self.text, self.at, self.leaves = text, 0, []
        self.stack: list[list] = []  # [column, "map" or "list", path, items so far]
        self.open: tuple[str, int, int] | None = ("", -1, 0)  # a node's path, its parent's column, and where it may start

    def fail(self, what: str) -> None:
        raise ValueError(f"{what} at {self.at}")

    def leaf(self, path: str, kind: str, value: str, start: int, end: int) -> None:
        self.leaves.append((path, kind, value, start, end))
        self.at = end

    def column(self, at: int) -> int:
        return at - (self.text.rfind("\n", 0, at) + 1)

    def absent(self) -> None:
        """The open node has no content: an empty leaf, unless it is the whole text."""
        if self.open and self.open[0]:
            self.leaves.append((self.open[0], "scalar_string", "", self.open[2], self.open[2]))
        self.open = None

    def run(self) -> list[tuple[str, str, str, int, int]]:
        text = self.text
        while self.at < len(text) and text[self.at] == "%":
            self.at = text.find("\n", self.at) + 1 or len(text)
        self.at = _VOID.match(text, self.at).end()
        if m := _END.match(text, self.at):
            self.at = m.end()
        while True:
            here = self.at
            self.at = _VOID.match(text, here).end()
            if self.at >= len(text) or self.column(self.at) == 0 and _END.match(text, self.at):
                self.absent()
                return self.leaves
            self.node(self.column(self.at))

    def node(self, column: int | None) -> None:
        """What starts at ``at``: an item, a key, or the content of the open node; and what an item holds on its own line."""
        while column is not None:
            column = self.step(column)

    def step(self, column: int) -> int | None:
        text = self.text
        item = text[self.at] == "-" and (self.at + 1 >= len(text) or text[self.at + 1] in " \t\n")
        if self.open and (column < self.open[1] or column == self.open[1] and not (item and self.stack and self.stack[-1][1] == "map")):
            self.absent()
        while not self.open and self.stack and (self.stack[-1][0] > column or self.stack[-1][0] == column and self.stack[-1][1] == "list" and not item):
            self.stack.pop()
        if item:
            self.place(column, "list")
            top = self.stack[-1]
            return self.opened(f"{top[2]}[{top[3] - 1}]", column, self.at + 1)
        if m := _BLOCK_KEY.match(text, self.at):
            self.place(column, "map")
            path, key = self.stack[-1][2], m[1]
            key = self.quoted(self.at)[0] if key[0] in "\"'" else key.rstrip()
            return self.opened(f"{path}.{key}" if path else key, column, m.end())
        if not self.open:
            self.fail("text without a place")
        path, parent, _ = self.open
        self.open = None
        self.content(path, parent)
        return None

    def place(self, column: int, kind: str) -> None:
        """The item or key is the next of the collection at this column, or opens one where a node is due."""
        if self.open:
            self.stack.append([column, kind, self.open[0], 0])
            self.open = None
        elif not self.stack or self.stack[-1][:2] != [column, kind]:
            self.fail("an item or key at a column that none has")
        self.stack[-1][3] += 1

    def opened(self, path: str, column: int, at: int) -> int | None:
        """A node is due after a dash or colon; what follows on the line is taken now, or its column returned if it is an item or key."""
        text = self.text
        self.open = (path, column, at)
        self.at = re.compile(r"[ \t]*").match(text, at).end()
        if m := _PROPERTY.match(text, self.at):
            self.at = m.end()
        if self.at >= len(text) or text[self.at] in "\n#":
            return None
        nested = text[self.at] == "-" and text[self.at + 1 : self.at + 2] in ("", " ", "\t", "\n") or text[self.at] not in "[{" and _BLOCK_KEY.match(text, self.at)
        if nested and text[at - 1] == "-":
            return self.column(self.at)
        self.open = None
        self.content(path, column)
        return None

    def content(self, path: str, parent: int) -> None:
        """A scalar, alias or flow collection at ``at``, in a collection at column ``parent``."""
        text, start = self.text, self.at
        if m := _PROPERTY.match(text, start):
            start = self.at = m.end()
            if start >= len(text) or text[start] in "\n#":
                self.open = (path, parent, start)
                return
        first = text[start]
        if first in "|>" and (m := _BLOCK_HEAD.match(text, start)):
            return self.block(path, parent, m)
        if first in "\"'":
            value, end = self.quoted(start)
            self.leaf(path, "scalar_string", value, start, end)
        elif first in "[{":
            self.flow(path)
        elif first == "*":
            self.at = re.compile(r"\*[^\s,\[\]{}]+").match(text, start).end() if text[start + 1 : start + 2].strip() else self.fail("no alias")
        elif first in "?@`%]}|>":
            self.fail(f"{first!r} starts no value")
        else:
            end = start + len(_PLAIN.match(text, start)[0].rstrip())
            if end == start:
                self.fail("no value")
            while m := re.compile(r"[ \t]*\n(?:[ \t]*\n)*([ \t]*)(?=[^\s#])").match(text, end):  # lines that go on
                if len(m[1]) <= parent or _BLOCK_KEY.match(text, m.end()) or parent < 0 and _END.match(text, m.end()):
                    break
                end = m.end() + len(_PLAIN.match(text, m.end())[0].rstrip())
            value = folded(text[start:end])
            self.leaf(path, kind_of(value), value, start, end)
        m = _REST.match(text, self.at)
        if not m:
            self.fail("text after a value")
        self.at = m.end()

    def quoted(self, start: int) -> tuple[str, int]:
        """Value and end of a quoted scalar."""
        text = self.text
        if text[start] == "'":
            m = re.compile(r"'((?:[^']|'')*)'").match(text, start)
            if not m:
                self.fail("a quote without its end")
            return folded(m[1]).replace("''", "'"), m.end()
        m = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S).match(text, start)
        if not m:
            self.fail("a quote without its end")
        out, raw, i = [], m[1], 0
        for part in re.finditer(r"\\\n[ \t]*|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+", raw, re.S):
            x = part[0]
            if x[0] != "\\":
                out.append(folded(x) if "\n" in x else x)
            elif x[1] in _HEX and len(x) == 2 + _HEX[x[1]]:
                out.append(chr(int(x[2:], 16)))
            elif x[1] != "\n":
                if x[1] not in _ESCAPES:
                    self.fail(f"{x!r} is no escape")
                out.append(_ESCAPES[x[1]])
        value = "".join(out)
        if "\ud800" <= max(value, default="") <= "\udfff" or any("\ud800" <= c <= "\udfff" for c in value):
            value = value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        return value, m.end()

    def block(self, path: str, parent: int, head: re.Match) -> None:
        """A literal or folded scalar: all lines indented beyond its parent, and the blank ones between and after."""
        text, start, at = self.text, head.start(), head.end()
        stated = head[2] or head[4]
        indent = max(parent, 0) + int(stated) if stated else 0
        lines = []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            line = text[at:end]
            lead = len(line) - len(line.lstrip(" "))
            if not indent and lead < len(line):
                if lead <= parent:
                    break
                indent = lead
            if indent and lead < indent and lead < len(line):
                break
            lines.append(line[indent:] if indent else "")
            at = min(end + 1, len(text))
        body = list(lines)
        while body and not body[-1]:
            body.pop()
        if head[1] == "|":
            value = "\n".join(body)
        else:
            parts, blank, last = [], 0, ""
            for line in body:
                if not line:
                    blank += 1
                    continue
                if not parts:
                    parts.append("\n" * blank)
                elif last[0] in " \t" or line[0] in " \t":  # lines indented further keep their ends
                    parts.append("\n" * (1 + blank))
                else:
                    parts.append("\n" * blank or " ")
                parts.append(line)
                blank, last = 0, line
            value = "".join(parts)
        chomp = head[3]
        if body:
            value += "" if chomp == "-" else "\n" * (1 + len(lines) - len(body)) if chomp == "+" else "\n"
        elif chomp == "+":
            value = "\n" * len(lines)
        self.leaf(path, "scalar_string", value, start, at)
        self.at = at

    def flow(self, path: str) -> None:
        """A collection in brackets, to its end."""
        text, stack = self.text, []  # [closing bracket, path, items so far, a path for the value that is due or None]

        def skip() -> None:
            self.at = re.compile(r"(?:\s|(?<=\s)#[^\n]*)*").match(text, self.at).end()
            if self.at >= len(text):
                self.fail("a bracket without its end")

        def enter(own: str) -> None:
            stack.append(["]" if text[self.at] == "[" else "}", own, 0, None])
            self.at += 1

        enter(path)
        due = False  # a comma has to come first
        while stack:
            skip()
            top, c = stack[-1], text[self.at]
            if c == top[0] or c == ",":
                if top[3] is not None:
                    self.leaves.append((top[3], "scalar_string", "", self.at, self.at))
                    top[3] = None
                elif c == "," and not due:
                    self.fail("a comma too many")
                self.at += 1
                due = False
                if c == top[0]:
                    stack.pop()
                    due = True
                continue
            if due:
                self.fail("no comma")
            own = top[3]
            if own is None:
                own = f"{top[1]}[{top[2]}]"
                top[2] += 1
                m = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s,\[\]{}"'](?:[^\n:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)*?)\s*:(?=[\s,\[\]{}]|(?<=["']:))""", re.S).match(text, self.at)
                if m or top[0] == "}":
                    if not m:
                        m = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s,\[\]{}"'](?:[^\n:#,\[\]{}]|:(?=[^\s,\[\]{}])|(?<=\S)#)*)""", re.S).match(text, self.at) or self.fail("no key")
                    key = self.quoted(self.at)[0] if m[1][0] in "\"'" else m[1].strip()
                    base = top[1] if top[0] == "}" else own
                    top[3] = f"{base}.{key}" if base else key
                    self.at = m.end()
                    continue
            top[3] = None
            due = True
            if m := _PROPERTY.match(text, self.at):
                self.at = m.end()
                c = text[self.at : self.at + 1]
            if c and c in "[{":
                enter(own)
                due = False
            elif c and c in "\"'":
                value, end = self.quoted(self.at)
                self.leaf(own, "scalar_string", value, self.at, end)
            elif c == "*":
                self.at = re.compile(r"\*[^\s,\[\]{}]*").match(text, self.at).end()
            else:
                start = self.at
                end = start + len(_FLOW_PLAIN.match(text, start)[0].rstrip())
                while m := re.compile(r"[ \t]*\n\s*(?=[^\s#,\[\]{}:])").match(text, end):
                    end = m.end() + len(_FLOW_PLAIN.match(text, m.end())[0].rstrip())
                if end == start:
                    self.fail("no value")
                value = folded(text[start:end])
                self.leaf(own, kind_of(value), value, start, end)


def leaves(text: str) -> list[tuple[str, str, str, int, int]]:
    """(path, kind, value, start, end) of a text's leaves, in order. Malformed text is a ValueError."""
    return Scan(text).run()
