"""Headings: carried paths, numbered tables of contents, drift between two of them, depth rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def heading_paths(rows: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Adds ``path``: the titles of the open headings at each row of (doc, ord, level nullable, title).

    A heading of a level stays open until one as shallow comes: the last one of each level counts if no shallower one came later.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = {k: F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("o"), F.col("title").alias("t"))), ignorenulls=True).over(w) for k in range(1, LEVELS + 1)}
    out = rows.withColumns({f"h{k}_": c for k, c in last.items()})
    kept = []
    for k in range(1, LEVELS + 1):
        above = F.greatest(*(F.coalesce(F.col(f"h{j}_.o"), F.lit(-1)) for j in range(1, k)), F.lit(-1)) if k > 1 else F.lit(-1)
        kept.append(F.when(F.col(f"h{k}_.o") > above, F.col(f"h{k}_.t")))
    return out.withColumn("path", F.array_compact(F.array(*kept))).drop(*(f"h{k}_" for k in range(1, LEVELS + 1)))


def numbered_toc(headings: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Adds ``number`` (1.2.1: places among headings of the same parent), ``parent`` (ord of the nearest shallower heading) and ``children``."""
    w = Window.partitionBy(doc).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    out = headings
    for k in range(1, LEVELS + 1):
        out = out.withColumn(f"last{k}_", F.max(F.when(F.col("level") == k, F.col(order))).over(before))
    parent = F.lit(None).cast("long")
    for k in range(1, LEVELS):
        open_ = F.when(F.col("level") > k, F.col(f"last{k}_"))
        parent = F.greatest(parent, open_.cast("long"))
    out = out.withColumn("parent", parent).drop(*(f"last{k}_" for k in range(1, LEVELS + 1)))
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy(doc, "parent").orderBy(order)))
    # A number is the places of the open headings above and its own: carried along the document, as paths are.
    last = {k: F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("o"), F.col("nth").alias("n"))), ignorenulls=True).over(before) for k in range(1, LEVELS)}
    out = out.withColumns({f"n{k}_": c for k, c in last.items()})
    above = lambda k: F.greatest(*(F.coalesce(F.col(f"n{j}_.o"), F.lit(-1)) for j in range(1, k)), F.lit(-1)) if k > 1 else F.lit(-1)
    parts = [F.when((F.col("level") > k) & (F.col(f"n{k}_.o") > above(k)), F.col(f"n{k}_.n").cast("string")) for k in range(1, LEVELS)]
    out = out.withColumn("number", F.concat_ws(".", *parts, F.col("nth").cast("string"))).drop("nth", *(f"n{k}_" for k in range(1, LEVELS)))
    kids = out.where("parent is not null").groupBy(F.col(doc), F.col("parent").alias(order)).agg(F.count(F.lit(1)).alias("children"))
    return out.join(kids, [doc, order], "left").na.fill(0, ["children"])


def toc_drift(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc, number, codes) of two (doc, number, title, level, hash): removed, added, renamed, depth_changed, hash_changed."""
    side = lambda df, p: df.select("doc", "number", *(F.col(c).alias(f"{p}_{c}") for c in ("title", "level", "hash")))
    both = side(source, "a").join(side(extracted, "b"), ["doc", "number"], "full_outer")
    changed = F.array_compact(F.array(F.when(F.col("a_title") != F.col("b_title"), "renamed"), F.when(F.col("a_level") != F.col("b_level"), "depth_changed"), F.when(F.col("a_hash") != F.col("b_hash"), "hash_changed")))
    codes = F.when(F.col("b_level").isNull(), F.array(F.lit("removed"))).when(F.col("a_level").isNull(), F.array(F.lit("added"))).otherwise(changed)
    return both.select("doc", "number", F.array_join(codes, ",").alias("codes")).where("codes <> ''")


def depth_jumps(headings: DataFrame, doc: str = "doc", order: str = "ord") -> DataFrame:
    """Headings more than one level deeper than the one before."""
    prev = F.lag("level").over(Window.partitionBy(doc).orderBy(order))
    return headings.withColumn("previous", prev).where(F.col("level") > F.col("previous") + 1)


def reordered(matches: DataFrame) -> DataFrame:
    """Rows of (doc, position, matched) whose match stands before that of the previous matched row."""
    prev = F.lag("matched").over(Window.partitionBy("doc").orderBy("position"))
    return matches.where("matched is not null").withColumn("previous", prev).where(F.col("matched") < F.col("previous"))
