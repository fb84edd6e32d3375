"""One form of nested values, whatever the order of their lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(c: Column, kind: T.DataType, ordered: frozenset[str] = frozenset(), path: str = "") -> Column:
    """The value with every list in it sorted, inner lists first, down to any depth of its type; maps become lists of entries by key.

    Lists compare by their elements' fields in order, so put the fields that identify an element first. Lists at ``ordered`` dotted paths
    keep their order, as it means something there. Nulls stay nulls, and come last in a list; an empty list counts as none.
    """
    if isinstance(kind, T.ArrayType):
        inner = F.transform(c, lambda x: canonical(x, kind.elementType, ordered, path)) if _nested(kind.elementType) else c
        return F.when(F.size(c) > 0, inner if path in ordered else F.array_sort(inner))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("key"), canonical(e["value"], kind.valueType, ordered, path).alias("value")))
        return F.when(F.size(c) > 0, F.array_sort(entries))
    if isinstance(kind, T.StructType):
        own = F.struct(*(canonical(c[f.name], f.dataType, ordered, f"{path}.{f.name}" if path else f.name).alias(f.name) for f in kind.fields))
        return F.when(c.isNotNull(), own)
    return c


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType))


def digest(c: Column, kind: T.DataType, ordered: frozenset[str] = frozenset()) -> Column:
    """SHA-256 of the canonical form as JSON; equal for reports that differ in the order of their lists only."""
    return F.sha2(F.to_json(F.struct(canonical(c, kind, ordered).alias("v"))), 256)
