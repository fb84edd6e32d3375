"""Byte offsets, lines and columns of places in a text that was scanned by characters."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np


class Places:
    """Maps character offsets of one text to byte offsets, and byte offsets to lines and columns, which count from 1 in bytes."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        flat = np.frombuffer(raw, np.uint8)
        self.size = len(raw)
        self._bytes = None if len(raw) == len(text) else np.append(np.flatnonzero((flat & 0xC0) != 0x80), len(raw))
        self._lines = [0, *(np.flatnonzero(flat == 10) + 1).tolist()]

    def byte(self, at: int) -> int:
        return at if self._bytes is None else int(self._bytes[at])

    def line(self, byte: int) -> tuple[int, int]:
        k = bisect_right(self._lines, byte)
        return k, byte - self._lines[k - 1] + 1


def tiled(spans: list[tuple], size: int) -> list[tuple[int, int, tuple | None]]:
    """(start, end, span) of the spans, given in order as (start, end, ...), and with None of the gaps between them; spans that are empty or overlap an earlier one are left out. Together they cover 0 to ``size`` once."""
    out, at = [], 0
    for span in spans:
        if span[0] < at or span[1] <= span[0]:
            continue
        if span[0] > at:
            out.append((at, span[0], None))
        out.append((span[0], span[1], span))
        at = span[1]
    if at < size:
        out.append((at, size, None))
    return out
