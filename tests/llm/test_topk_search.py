"""Shards by space: pairs of query and shard that are skipped, and groups of equal vectors."""

import numpy as np

from ledgerline.llm import topk_search
from tests.llm.test_operators import brute_top


def searched(spark, monkeypatch, rows, **options):
    """Results by query, and how many pairs of a query and a shard were visited."""
    visits, shards = [], []
    plain = topk_search.visit

    def counted(trees, asked, k):
        visits.append(asked.count())
        shards.append(trees.count())
        return plain(trees, asked, k)

    monkeypatch.setattr(topk_search, "visit", counted)
    df = spark.createDataFrame([(i, list(map(int, v))) for i, v in rows], "vec_id long, v array<long>")
    out = {}
    for x in topk_search.top_k(df, df.where("vec_id % 20 = 0"), 5, **options).collect():
        out.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    return {q: sorted(x) for q, x in out.items()}, sum(visits), shards[0]


def test_far_shards_are_skipped(spark, monkeypatch):
    r = np.random.default_rng(1)
    centres = r.normal(0, 1, (16, 8)) * 400
    rows = [(i, centres[i % 16] + r.normal(0, 10, 8)) for i in range(2000)]
    rows = [(i, np.floor(v).astype(int)) for i, v in rows]
    got, visits, shards = searched(spark, monkeypatch, rows, shard_rows=125)
    assert got == brute_top(rows, 20, 5)
    assert shards >= 12 and visits < 0.4 * shards * len(got)


def test_equal_vectors_are_split(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [(i, np.full(4, 3) if i % 3 else r.integers(-5, 6, 4)) for i in range(900)]
    got, visits, shards = searched(spark, monkeypatch, rows, shard_rows=100, next_shards=1)
    assert got == brute_top(rows, 20, 5) and shards >= 9
