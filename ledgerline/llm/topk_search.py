"""Exact top-k search by inner product: KD-trees per shard.

Vectors are quantised to integers and dealt to shards by space: a top tree of median splits, drawn from a bounded sample,
sends every row to a shard, and a shard of too many rows (equal vectors, say) is split by a hash of the id. Each shard
becomes one KD-tree (median splits, tight bounding boxes) kept as arrays in a row.

The bound of an inner product over a shard's box says which shards can matter to a query. In the first round each query
visits the shard of its highest bound, in the second the next ``NEXT`` whose bound reaches its kth score, in the third
all that still do; so the kth score is carried from shard to shard, and a query is only sent where it may find something.
Within a shard the search goes best box first and stops where a box's bound falls below the kth score. Queries of
a shard are dealt in parts, each of which meets the tree in a task of its own.

Defined cases: a vector that is null, empty, or holds null or non-finite components takes no part; vectors of
unlike length don't meet; ties go to the smaller id; a query never finds itself, but finds equal vectors of
other ids; rows that repeat an id are each a candidate, and as queries count once (the smallest vector of the id); empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

K, LEAF = 20, 256
#: Rows of a shard and queries of a part, on average; boxes and queries that are compared in one task.
SHARD_ROWS, PART_ROWS, BOXES, BLOCK_ROWS = 16_384, 8_192, 4_096, 4_096
#: Rows that the top tree's splits are drawn from, at most about, and numbers in them; shards that a query visits in the second round.
SAMPLE_ROWS, SAMPLE_NUMBERS, NEXT = 50_000, 4_000_000, 4


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component as long; null where the vector takes no part."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class KDTree:
    """Rows in leaf order; node 2i+1 and 2i+2 halve node i at the median of its widest dimension; boxes are tight."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF):
        depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        order, spans = np.argsort(ids, kind="stable"), [(0, len(ids))]
        for level in range(depth):
            for a, b in spans[(1 << level) - 1 :]:
                own = order[a:b]
                mid = (b - a) // 2
                if b - a > 1:
                    values = rows[own]
                    axis = int((values.max(0) - values.min(0)).argmax())
                    order[a:b] = own[np.argsort(values[:, axis], kind="stable")]
                spans += [(a, a + mid), (a + mid, b)]
        self.ids, self.rows, self.spans, self.inner = ids[order], rows[order], spans, (1 << depth) - 1
        self.low = np.array([self.rows[a:b].min(0) if b > a else np.zeros(rows.shape[1], rows.dtype) for a, b in spans])
        self.high = np.array([self.rows[a:b].max(0) if b > a else np.zeros(rows.shape[1], rows.dtype) for a, b in spans])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """(query id, id, score) of each query's best k at or above its bound, best box first."""
        upper = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        for q, own in enumerate(query_ids.tolist()):
            boxes, best, floor = [(-upper[q, 0], 0)], [], bound[q]
            while boxes:
                top, node = heapq.heappop(boxes)
                if -top < floor:
                    break
                if node < self.inner:
                    for child in (2 * node + 1, 2 * node + 2):
                        if upper[q, child] >= floor and self.spans[child][1] > self.spans[child][0]:
                            heapq.heappush(boxes, (-upper[q, child], child))
                    continue
                a, b = self.spans[node]
                score = self.rows[a:b] @ queries[q]
                for i in np.flatnonzero(score >= floor):
                    if self.ids[a + i] != own:
                        best.append((-score[i], self.ids[a + i]))
                if len(best) >= k:
                    best = heapq.nsmallest(k, best)
                    floor = max(floor, -best[-1][0])
            for s, i in heapq.nsmallest(k, best):
                yield own, int(i), int(-s)


def packed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows, in the smallest integers that hold them."""
    rows = np.array(pdf["v"].tolist(), np.int64)
    most = np.abs(rows).max(initial=0)
    return pdf["vec_id"].to_numpy(np.int64), rows.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def exact(*sides: np.ndarray) -> list[np.ndarray]:
    """Rows as doubles where every product sum stays below 2**53, else as Python integers."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in sides)
    return [x.astype(np.float64 if sides[0].shape[1] * most**2 < 2**53 else object) for x in sides]


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    tree = KDTree(*packed(pdf))
    return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "low": [tree.low[0].astype(np.int64).tolist()], "high": [tree.high[0].astype(np.int64).tolist()], "tree": [pickle.dumps(tree, 5)]})


def top_splits(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of the median split of each node of a complete tree, in the order of ``KDTree``'s nodes."""
    axis, value, own = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64), [rows]
    for node in range(len(axis)):
        x = own[node]
        if len(x):
            axis[node] = int((x.max(0) - x.min(0)).argmax())
            value[node] = int(np.sort(x[:, axis[node]])[(len(x) - 1) // 2])
        right = x[:, axis[node]] > value[node]
        own += [x[~right], x[right]]
    return axis, value


def dealt_to_shards(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """(dim, shard, vec_id, v): every row of ``vectors(vec_id, v)`` in a shard of about ``shard_rows``."""
    rows = vectors.select(F.size("v").alias("dim"), "vec_id", "v")
    large = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_rows).collect()}  # at most a length for each `shard_rows` rows
    total = sum(large.values())
    plans = {}
    if large:
        most = min(SAMPLE_ROWS, SAMPLE_NUMBERS * total // sum(d * n for d, n in large.items()))
        sample = rows.where(F.col("dim").isin(list(large)) & (F.pmod(F.xxhash64("vec_id", "v"), F.lit(1_000_000)) < min(1_000_000, -(-1_000_000 * most // total)))).toPandas()  # about SAMPLE_NUMBERS numbers
        for dim, n in large.items():
            own = sample.loc[sample["dim"] == dim, "v"].tolist()
            plans[dim] = (depth := int(np.ceil(np.log2(n / shard_rows))), *top_splits(np.array(own, np.int64).reshape(-1, dim), depth))
    shared = vectors.sparkSession.sparkContext.broadcast(plans)  # two numbers a shard

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            shard = np.zeros(len(pdf), np.int64)
            for dim, at in pdf.groupby("dim").indices.items():
                if dim in shared.value:
                    depth, axis, value = shared.value[dim]
                    x, node = np.array(pdf["v"].iloc[at].tolist(), np.int64), np.zeros(len(at), np.int64)
                    for _ in range(depth):
                        node = 2 * node + 1 + (x[np.arange(len(at)), axis[node]] > value[node])
                    shard[at] = node - len(axis)
            yield pdf.assign(shard=shard)

    placed = materialise(rows.mapInPandas(assign, "dim int, vec_id long, v array<long>, shard long"), "topk-placed")
    sizes = materialise(placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / (1.5 * shard_rows)).alias("parts")), "topk-sizes")
    split = F.col("shard") * (1 << 31) + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))
    return placed.join(broadcast_if_small(sizes), ["dim", "shard"]).select("dim", split.alias("shard"), "vec_id", "v")


def every(parts: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)


def promising(queries: DataFrame, boxes: DataFrame, most: int | None) -> DataFrame:
    """(dim, query_id, shard, upper): the shards whose box lets a query (dim, query_id, v, bound) reach its bound; at least the ``most`` best of each query."""
    chunks, blocks = max(1, -(-boxes.count() // BOXES)), max(1, -(-queries.count() // BLOCK_ROWS))

    def run(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({"dim": [], "query_id": [], "shard": [], "upper": []})
        q, low, high = exact(*(np.array(x.tolist(), np.int64) for x in (asked["v"], own["low"], own["high"])))
        upper = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        ok = upper >= asked["bound"].to_numpy(float)[:, None]
        if most is not None and most < len(own):
            cut = np.partition(upper.astype(float), len(own) - most, axis=1)[:, len(own) - most]
            ok &= upper >= cut[:, None]
        i, j = np.nonzero(ok)
        return pd.DataFrame({"dim": asked["dim"].iloc[0], "query_id": asked["query_id"].to_numpy()[i], "shard": own["shard"].to_numpy()[j], "upper": upper[i, j].astype(float)})

    block, chunk = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int").alias("chunk")
    asked = queries.select("dim", "query_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), block, every(chunks, "chunk"))
    return asked.groupBy("dim", "block", "chunk").cogroup(boxes.select("dim", "shard", "low", "high", chunk, every(blocks, "block")).groupBy("dim", "block", "chunk")).applyInPandas(run, "dim int, query_id long, shard long, upper double")


FOUND = "query_id long, vec_id long, score long"


def visit(trees: DataFrame, asked: DataFrame, k: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Search (dim, shard, query_id, v, bound), a written table, in the trees (dim, shard, tree): one tree and one part of its queries in each group."""
    parts = materialise(asked.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")), "topk-parts")
    few = broadcast_if_small(parts)
    own = trees.select("dim", "shard", "tree").join(few, ["dim", "shard"]).select("dim", "shard", "tree", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"))
    dealt = asked.join(few, ["dim", "shard"]).withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int")).drop("parts")

    def run(tree_rows: pd.DataFrame, query_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in tree_rows["tree"] if len(query_rows) else ():
            tree, rows = pickle.loads(t), np.array(query_rows["v"].tolist(), np.int64)
            tree.rows, tree.low, tree.high, rows = exact(tree.rows, tree.low, tree.high, rows)
            out += tree.search(query_rows["query_id"].to_numpy(), rows, query_rows["bound"].fillna(-np.inf).to_numpy(float), k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return own.groupBy("dim", "shard", "part").cogroup(dealt.groupBy("dim", "shard", "part")).applyInPandas(run, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, next_shards: int = NEXT) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``queries`` against ``vectors``, both (vec_id long, v array<long>), v non-null."""
    trees = materialise(dealt_to_shards(vectors, shard_rows).groupBy("dim", "shard").applyInPandas(build_shard, "dim int, shard long, low array<long>, high array<long>, tree binary"), "topk-trees")
    boxes = trees.select("dim", "shard", "low", "high")
    one = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = materialise(one.select(F.size("v").alias("dim"), "query_id", "v"), "topk-queries")
    bound, seen, found = asked.withColumn("bound", F.lit(None).cast("double")), None, None
    for step, most in enumerate((1, 1 + next_shards, None)):
        shards = promising(bound, boxes, most)
        if seen is not None:
            shards = shards.join(seen, ["dim", "query_id", "shard"], "left_anti")
        if most is not None:  # a window of the best of each query
            nth = F.row_number().over(Window.partitionBy("dim", "query_id").orderBy(F.desc("upper"), "shard"))
            shards = shards.withColumn("nth", nth).where(F.col("nth") <= (1 if step == 0 else next_shards))
        now = materialise(shards.select("dim", "query_id", "shard"), "topk-visits")
        seen = now if seen is None else seen.unionByName(now)
        more = materialise(visit(trees, materialise(now.join(bound.drop("dim"), "query_id").select("dim", "shard", "query_id", "v", "bound"), "topk-asked"), k), "topk-found")
        found = more if found is None else materialise(best(found.unionByName(more), k).drop("rank"), "topk-best")
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("bound"))
        bound = asked.join(kth, "query_id", "left").select("dim", "query_id", "v", "bound")
    return best(found, k)


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v")).where("vec_id is not null and v is not null")
    rows = materialise(rows, "topk-vectors")
    return top_k(rows, rows.where("vec_id % 20 = 0"))


ORACLE_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
