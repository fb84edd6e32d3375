"""Ordered matching of two outlines: what is missing, extra, at another depth, behind its predecessor, or truly moved.

An entry matches one of the same title (blanks and case aside), of the same depth if there is one, else the first. An entry counts as moved if it
is not in the longest run of matches whose places rise: entries that others were moved past stay, which neighbour comparison alone can't tell.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def longest_rising(places: list[int]) -> list[bool]:
    """Which places are in a longest run that never falls; of several runs the one that ends last, and before each place the latest that fits."""
    tails, at, before = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_right(tails, p)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [p], [i]
    out, i = [False] * len(places), at[-1] if at else -1
    while i >= 0:
        out[i] = True
        i = before[i]
    return out


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _in_order(places: pd.Series) -> pd.Series:
    return places.map(lambda x: longest_rising(list(x)))


def matched_entries(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """Each entry of ``source(doc, position, title, depth)`` with the first place of its title in ``extracted`` (null: missing) and its match's depth."""
    key = F.lower(F.trim("title")).alias("key")
    places = extracted.select("doc", key, "position", "depth").groupBy("doc", "key", "depth").agg(F.min("position").alias("place"))
    first = places.groupBy("doc", "key").agg(F.min("place").alias("place"), F.min_by("depth", "place").alias("first_depth"))
    same = places.select("doc", "key", "depth", F.lit(True).alias("same"))
    rows = source.select("doc", "position", "title", "depth", key).join(first, ["doc", "key"], "left").join(same, ["doc", "key", "depth"], "left")
    return rows.select("doc", "position", "title", "depth", "key", "place", F.when(F.col("same"), F.col("depth")).otherwise(F.col("first_depth")).alias("match_depth"))


def outline_drifts(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc, kind, position, title, depth, match_depth) of two outlines (doc, position, title, depth): kinds missing, depth, reordered, moved at the source's positions, extra at the extracted one's.

    A document's entries meet in one row; outlines are short beside their texts.
    """
    entry = F.struct("position", "title", "depth", "place", "match_depth")
    docs = matched_entries(source, extracted).groupBy("doc").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    docs = docs.withColumn("found", F.filter("entries", lambda e: e["place"].isNotNull()))
    docs = docs.withColumn("stays", _in_order(F.transform("found", lambda e: e["place"])))
    fell = F.expr("filter(transform(found, (e, i) -> named_struct('e', e, 'k', if(i > 0 and e.place < found[i - 1].place, 'reordered', null))), x -> x.k is not null)")
    moved = F.expr("filter(transform(found, (e, i) -> named_struct('e', e, 'k', if(stays[i], null, 'moved'))), x -> x.k is not null)")
    lacks = F.expr("transform(filter(entries, e -> e.place is null), e -> named_struct('e', e, 'k', 'missing'))")
    other = F.expr("transform(filter(found, e -> not (e.depth <=> e.match_depth)), e -> named_struct('e', e, 'k', 'depth'))")
    rows = docs.select("doc", F.explode(F.concat(lacks, other, fell, moved)).alias("x")).select("doc", F.col("x.k").alias("kind"), "x.e.position", "x.e.title", "x.e.depth", "x.e.match_depth")
    key = F.lower(F.trim("title")).alias("key")
    extra = extracted.select("doc", "position", "title", "depth", key).join(source.select("doc", key), ["doc", "key"], "left_anti")
    return rows.unionByName(extra.select("doc", F.lit("extra").alias("kind"), "position", "title", F.lit(None).cast("int").alias("depth"), F.col("depth").alias("match_depth")))


def outline_scores(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """(doc, matched, drifts, score, aligned): entries matched at their depth over the longer outline; moved entries show among the reordered ones and don't count twice."""
    own = matched_entries(source, extracted).groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("place").isNotNull()) & F.col("depth").eqNullSafe(F.col("match_depth"))).alias("matched"))
    theirs = extracted.groupBy("doc").agg(F.count(F.lit(1)).alias("m"))
    drifts = outline_drifts(source, extracted).where("kind <> 'moved'").groupBy("doc").agg(F.count(F.lit(1)).alias("drifts"))
    both = own.join(theirs, "doc", "full").join(drifts, "doc", "left").na.fill(0, ["n", "m", "matched", "drifts"])
    return both.select("doc", "matched", "drifts", (F.col("matched") / F.greatest("n", "m")).alias("score"), (F.col("drifts") == 0).alias("aligned"))
