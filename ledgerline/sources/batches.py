"""Texts of Arrow batches to rows, with memory in proportion to a few texts, whatever the size of a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Texts taken from a batch at once, rows of a batch that goes out, and characters of strings in it.
TEXTS, ROWS, CHARS = 64, 4096, 1 << 22


def parsed(batches: Iterator[pa.RecordBatch], parse: Callable[..., Iterable[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows that ``parse`` makes of each row of the batches, in batches of at most ``ROWS`` rows, and of few more than ``CHARS`` characters where a row has no more."""
    rows, chars = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            for given in zip(*(c.to_pylist() for c in batch.slice(at, TEXTS).columns)):
                for row in parse(*given):
                    rows.append(row)
                    chars += sum(len(x) for x in row if isinstance(x, str))
                    if len(rows) == ROWS or chars > CHARS:
                        yield out()
                        rows, chars = [], 0
    if rows:
        yield out()
