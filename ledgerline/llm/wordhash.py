"""Vectorised 64-bit hashes of words, which are runs of other characters than space, tab to carriage return.

A word's hash is a polynomial in its bytes modulo 2**64, mixed at the end, taken from running sums over a block
of text; so no Python object is made per word. Words are compared by hash alone, and only those of two documents or lines
that are compared anyway: two lists of n words have a chance agreement with a probability of about n * n / 2**64.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(pow(int(_P), -1, 2**64))
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        up, down = np.full(size, _P), np.full(size, _Q)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _block(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(buf) + 2, bool)
    np.less_equal(buf - np.uint8(9), 4, out=space[1:-1])
    space[1:-1] |= buf == 32
    edges = np.flatnonzero(space[1:] != space[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _power(len(buf))
    run = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * up[: len(buf)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64)), start


def hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte at which it starts) of every word of UTF-8 ``data``, in order. Long data are taken in blocks that end on a space."""
    buf = np.frombuffer(data, np.uint8)
    if len(buf) <= BLOCK:
        return _block(buf)
    parts, at = [], 0
    while at < len(buf):
        end = min(at + BLOCK, len(buf))
        if end < len(buf):
            spaces = np.flatnonzero(_SPACE[buf[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:
                ahead = np.flatnonzero(_SPACE[buf[end:]])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(buf)
        h, s = _block(buf[at:end])
        parts.append((h, s + at))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
