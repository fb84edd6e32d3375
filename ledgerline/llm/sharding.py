"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts are a group and stay together. Spark adds up each group's size by a hash of its text (should two texts share
a hash, they go together, which only makes a larger group). Groups of at least one part in ``LARGE`` of all bytes, of which there can be at most that many,
are items of their own; all smaller groups are dealt by hash to ``BUNDLES`` bundles, each an item of the sum of its groups. So the driver holds a bounded number of
items at every size of the input, and no group is ever divided.

Items enter, largest first, the open shard with the least remaining room that still takes them; rooms are kept in a balanced tree, so an
item costs the logarithm of the number of shards. For a stated capacity this keeps the number of shards small. For a stated number of shards
the least capacity that suffices is searched by halving; an item beyond an equal share gets a shard of its own and the others share the rest.

Shards are looked up from a broadcast of at most ``LARGE + BUNDLES`` rows, and slots come from counts of salted parts of a shard, so neither step has a hot task.

Defined cases: a null text counts as empty and has size 1; an item above the capacity has a shard of its own; rows that
repeat doc_id and text get a slot each; with fewer groups than shards the last shards are empty; null ids come first within a part; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, materialise, text_or_empty

SHARDS, LARGE, BUNDLES = 8, 65_536, 65_536
#: Rows of a part in which slots are counted, on average.
PART_ROWS = 100_000


class Rooms:
    """A balanced tree (a treap) of (remaining room, shard)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.made = 0

    def _split(self, t: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below ``key`` and the others."""
        if t is None:
            return None, None
        if t[0] < key:
            t[3], right = self._split(t[3], key)
            return t, right
        left, t[2] = self._split(t[2], key)
        return left, t

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, shard: int) -> None:
        self.made += 1
        priority = hashlib.blake2b(self.made.to_bytes(8, "little"), digest_size=8).digest()
        low, high = self._split(self.root, (room, shard))
        self.root = self._merge(self._merge(low, [(room, shard), priority, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the tightest room of at least ``size``, of equal ones the first shard; None if there is none."""
        low, high = self._split(self.root, (size, -1))
        found = high
        while found is not None and found[2] is not None:
            found = found[2]
        if found is not None:
            _, high = self._split(high, (found[0][0], found[0][1] + 1))
        self.root = self._merge(low, high)
        return found[0] if found is not None else None


def best_fit_decreasing(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The shard of each item, ``sizes`` in descending order; None if more than ``most`` shards would be opened."""
    rooms, opened, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            if opened == most:
                return None
            found, opened = (max(capacity, size), opened), opened + 1
        rooms.add(found[0] - size, found[1])
        out.append(found[1])
    return out


def even_shards(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item, ``sizes`` in descending order, for the least capacity that halving finds to need ``shards`` at most."""
    alone, total = 0, sum(sizes)
    while alone < min(len(sizes), shards - 1) and sizes[alone] * (shards - alone) >= total:
        total -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], shards - alone
    if not rest:
        return list(range(alone))
    low = max(rest[0], -(-total // bins))
    high, step = low, 1
    while (found := best_fit_decreasing(rest, high, bins)) is None:
        low, high, step = high + 1, high + step, 2 * step
    while low < high:
        mid = (low + high) // 2
        tried = best_fit_decreasing(rest, mid, bins)
        low, high, found = (mid + 1, high, found) if tried is None else (low, mid, tried)
    return list(range(alone)) + [alone + s for s in found]


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key), written: all that sharding has to know of a document."""
    text = text_or_empty()
    size, crc = F.octet_length(text).cast("long") + 1, F.crc32(text.cast("binary"))
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text).alias("key")), "sharding-sizes")


def items(rows: DataFrame, large: int, bundles: int) -> list[tuple[int, bool, int]]:
    """(size, is a group, its key or the bundle), descending; at most ``large + bundles``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "sharding-groups")
    is_large = F.col("size") >= max(1, -(-total // large))
    own = [(r["size"], True, r["key"]) for r in groups.where(is_large).select("size", "key").collect()]
    small = groups.where(~is_large).groupBy(F.pmod("key", F.lit(bundles)).alias("key")).agg(F.sum("size").alias("size"))
    return sorted([*own, *((r["size"], False, r["key"]) for r in small.collect())], key=lambda x: (-x[0], not x[1], x[2]))


def slotted(rows: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``slot``, a gapless number from 0 within ``shard``, to a written table."""
    names = rows.columns
    parts = max(1, -(-rows.count() // part_rows))
    salt = F.pmod(F.xxhash64("doc_id", "key"), F.lit(parts)).cast("int")
    once = materialise(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies_")).withColumn("salt_", salt), "sharding-rows")  # rows alike in all count once
    counts = once.groupBy("shard", "salt_").agg(F.sum("copies_").alias("n"))
    before = counts.select("shard", "salt_", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt_")) - F.col("n")).alias("before"))
    until = F.sum("copies_").over(Window.partitionBy("shard", "salt_").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, 0))
    ranged = once.withColumn("until_", until).join(broadcast_if_small(before), ["shard", "salt_"])
    return ranged.select(*names, F.explode(F.expr("sequence(before + until_ - copies_, before + until_ - 1)")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, large: int = LARGE, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of ``docs(doc_id, text)``: ``shards`` of near equal bytes, or as few as best fit finds of ``capacity`` bytes."""
    rows = sized(docs)
    found = items(rows, large, bundles)
    sizes = [x[0] for x in found]
    placed = best_fit_decreasing(sizes, capacity) if capacity is not None else even_shards(sizes, shards)
    spark = rows.sparkSession
    table = spark.createDataFrame([(own, key, s) for (_, own, key), s in zip(found, placed)], "own boolean, key long, shard int")
    groups = F.broadcast(table.where("own").select("key", F.col("shard").alias("own_shard")))  # at most `large` rows
    others = F.broadcast(table.where("not own").select(F.col("key").alias("bundle"), F.col("shard").alias("bundle_shard")))  # at most `bundles` rows
    met = rows.join(groups, "key", "left").withColumn("bundle", F.pmod("key", F.lit(bundles))).join(others, "bundle", "left")
    placed_rows = met.select("doc_id", "size", "text_crc32", "key", F.coalesce("own_shard", "bundle_shard").alias("shard"))
    return slotted(placed_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
