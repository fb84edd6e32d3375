"""Array expressions in SQL text."""

from __future__ import annotations

#: Elements that one fold takes: its state is copied per element, so folds stay short.
FOLD = 64


def running(values: str, zero: str, join: str, levels: int = 3) -> str:
    """SQL expression: for each element of an array of numbers, those before it joined, as longs; ``join`` is SQL with ``{0}`` and ``{1}``, associative, with ``zero`` as its neutral value.

    A fold that appends to an array copies it per element. So blocks of ``FOLD`` elements are folded one by one, each from
    the value before it, and these values come from the same expression a level up; the cost is in proportion to the array.
    """
    v = "abcdef"[levels]
    empty = "cast(array() as array<bigint>)"
    fold = lambda array, start: f"aggregate({array}, named_struct('at', cast({start} as bigint), 'out', {empty}), ({v}, {v}x) -> named_struct('at', cast({join.format(f'{v}.at', f'{v}x')} as bigint), 'out', array_append({v}.out, {v}.at)), {v} -> {v}.out)"
    if not levels:
        return fold(values, zero)
    block = f"slice({v}w, {v}k * {FOLD} + 1, {FOLD})"
    joined = f"transform(sequence(0, (size({v}w) - 1) div {FOLD}), {v}k -> aggregate({block}, cast({zero} as bigint), ({v}s, {v}x) -> cast({join.format(f'{v}s', f'{v}x')} as bigint)))"
    whole = f"if(size({v}w) = 0, {empty}, flatten(transform({running(joined, zero, join, levels - 1)}, ({v}p, {v}k) -> {fold(block, f'{v}p')})))"
    short = f"if(size({v}w) <= {FOLD}, {fold(f'{v}w', zero)}, {whole})"
    return f"transform(array({values}), {v}w -> {short})[0]"


def running_sums(lengths: str) -> str:
    """SQL expression: the sum of the elements before each element."""
    return running(lengths, "0", "{0} + {1}")
