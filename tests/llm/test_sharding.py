"""Best-fit-decreasing against a plain search, and shards of real and odd documents."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerline.llm import sharding
from ledgerline.llm.sharding import best_fit_decreasing, even_shards, op13_sharding, shard_documents
from tests.conftest import DATA


def plain_best_fit(sizes, capacity):
    rooms, out = [], []
    for size in sizes:
        fits = [(room, s) for s, room in enumerate(rooms) if room >= size]
        s = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(max(capacity, size))
        rooms[s] -= size
        out.append(s)
    return out


def test_tree_finds_the_tightest_room():
    r = random.Random(4)
    for capacity in (1, 50, 300, 1000):
        sizes = sorted((r.randint(1, 120) for _ in range(800)), reverse=True)
        assert best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)
    assert best_fit_decreasing([], 5) == [] and best_fit_decreasing([3, 3], 3, 1) is None


def test_fewest_shards_of_a_capacity():
    assert len(set(best_fit_decreasing([7, 6, 5, 5, 4, 3], 10))) == 3
    assert best_fit_decreasing([30, 4, 4], 10) == [0, 1, 1]


def test_even_shards():
    r = random.Random(5)
    sizes = sorted((r.randint(1, 5000) for _ in range(3000)), reverse=True)
    totals = Counter()
    for size, s in zip(sizes, even_shards(sizes, 8)):
        totals[s] += size
    assert len(totals) == 8 and max(totals.values()) - min(totals.values()) <= 16
    sizes = [10_000, *sizes[-200:]]  # a group beyond an equal share stays alone, the others are even
    totals = Counter()
    for size, s in zip(sizes, even_shards(sizes, 8)):
        totals[s] += size
    own = sorted(totals.values())
    assert own[-1] == 10_000 and own[-2] - own[0] <= 40
    assert even_shards([5, 5], 8) == [0, 1] and even_shards([], 8) == []


def checked(spark, d, rows):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t) + 1, zlib.crc32(t)) for i, t in docs)
    slots, totals, places = defaultdict(list), Counter(), defaultdict(set)
    text_of = defaultdict(set)
    for i, t in docs:
        text_of[(i, zlib.crc32(t))].add(t)
    for r in rows:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
        totals[r["shard"]] += r["size"]
        for t in text_of[(r["doc_id"], r["text_crc32"])]:
            places[t].add(r["shard"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in places.values())
    return totals


@pytest.mark.parametrize("d", ["odd", "data"])
def test_documents(spark, odd_dir, d):
    d = odd_dir if d == "odd" else DATA
    totals = checked(spark, d, op13_sharding(spark, d).collect())
    if d == DATA:
        assert max(totals.values()) - min(totals.values()) <= 0.001 * max(totals.values())


def test_bundles_keep_groups_whole(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 20)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = shard_documents(docs, 8, large=20, bundles=64).collect()
    totals = checked(spark, DATA, rows)
    assert max(totals.values()) <= 1.1 * min(totals.values())
    again = shard_documents(docs.repartition(5), 8, large=20, bundles=64).collect()
    assert Counter(rows) == Counter(again)


def test_capacity(spark):
    docs = spark.createDataFrame([(i, "x" * (9 if i < 4 else 4)) for i in range(4)] + [(9, "y" * 40), (10, "z" * 4)], "doc_id long, text string")
    rows = shard_documents(docs, capacity=45).collect()
    assert {r["doc_id"]: r["shard"] for r in rows} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 0, 10: 1}
