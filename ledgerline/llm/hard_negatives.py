"""Hard-negative mining by blocked dense products.

Vectors are quantised to integers. Anchors are broadcast in blocks of bounded size; every task multiplies a block with blocks
of candidate rows in float64, which is exact while all sums stay below 2**53 (Python integers otherwise), so only the stated anchors meet all rows, and
no pair leaves a task that is not among its best.

First pass: each task keeps an anchor's best rows of the same label; those of all tasks are merged by a window. Second pass: for each anchor and positive
the scores that its negatives may have form a window of integers; each task keeps the best rows of another label within it, and these are merged alike.

Defined cases: rows whose id, label or vector is null, whose vector is empty, or holds null or non-finite components take no part; vectors of unlike length don't meet; a row
meets no row of its own id; rows that repeat an id are each a candidate, and as anchors count once (the smallest label and vector);
higher scores come first, ties by the smaller id; an anchor without positives and a positive without negatives give no rows; a positive below
zero has an empty window; scores beyond 64 bits are held at its ends; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise
from .topk_search import exact, quantised

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: A negative's score in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Numbers in a block of anchors that is broadcast (8 bytes each), and scores that a task holds at once.
BLOCK_NUMBERS, SCORES = 2_000_000, 2_000_000
FOUND = "anchor_id long, slot int, vec_id long, score long"


class Best:
    """The best ``k`` of each place seen so far: highest score, then smallest id."""

    def __init__(self, places: int, k: int):
        self.k, self.place, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.last, self.last_id = np.full(places, -np.inf), np.zeros(places, np.int64)  # the kth so far

    def offer(self, place: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Only scores at or above ``last`` need be offered."""
        better = (score > self.last[place]) | (ids < self.last_id[place])
        if not better.any():
            return
        place, score, ids = (np.concatenate([x, y[better]]) for x, y in ((self.place, place), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, place))
        place, score, ids = place[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        nth = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        if score.dtype == np.float64:  # with Python integers all scores are offered
            full = nth == self.k - 1
            self.last[place[full]], self.last_id[place[full]] = score[full], ids[full]
        self.place, self.score, self.id = (x[nth < self.k] for x in (place, score, ids))


def _rows(column: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length of vector: the rows that have it, and their matrix."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(ends)
    return {int(n): (at := np.flatnonzero(lengths == n), values[ends[at][:, None] + np.arange(n)]) for n in np.unique(lengths)}


def _window(scores: list[int | None], positives: int, least: int, most: int) -> tuple[list[int], list[int]]:
    """The least and the highest score of a negative of each positive; an empty window where a positive lacks."""
    bounds = [(1, 0) if s is None else (-(-least * s // 100), most * s // 100) for s in [*scores, *[None] * (positives - len(scores))]]
    return [b[0] for b in bounds], [b[1] for b in bounds]


def _offer_positives(best: Best, own: dict, scores: np.ndarray, same: np.ndarray, other: np.ndarray, ids: np.ndarray) -> None:
    i, j = np.nonzero(same & other & (scores >= best.last[:, None]))
    best.offer(i, scores[i, j], ids[j])


def _offer_negatives(best: Best, own: dict, scores: np.ndarray, same: np.ndarray, other: np.ndarray, ids: np.ndarray) -> None:
    apart, slots = ~same & other, own["low"].shape[1]
    for slot in range(slots):
        i, j = np.nonzero(apart & (scores <= own["high"][:, slot, None]) & (scores >= own["low"][:, slot, None]) & (scores >= best.last[slot::slots, None]))
        best.offer(i * slots + slot, scores[i, j], ids[j])


def _met(block: dict[int, dict], candidates: DataFrame, slots: int, k: int, offers: Callable) -> DataFrame:
    """Rows (anchor_id, slot, vec_id, score): each task's best. ``offers`` gets a block of scores, and which of its labels and ids are equal and other."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim, (at, rows) in _rows(batch.column(2)).items():
                own = shared.value.get(dim)
                if own is None:
                    continue
                step = max(1, SCORES // len(own["id"]))
                top = best.setdefault(dim, Best(len(own["id"]) * slots, k))
                for a in range(0, len(at), step):
                    x, y = exact(own["v"], rows[a : a + step])
                    mine = at[a : a + step]
                    offers(top, own, x @ y.T, own["label"][:, None] == labels[mine][None, :], own["id"][:, None] != ids[mine][None, :], ids[mine])
        for dim, b in best.items():
            score = np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in b.score.tolist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim]["id"][b.place // slots]), pa.array((b.place % slots).astype(np.int32)), pa.array(b.id), pa.array(score)], ["anchor_id", "slot", "vec_id", "score"])

    return candidates.select("vec_id", "label", "v").mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all tasks for each anchor and slot, with their rank."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(anchors: DataFrame, numbers: int) -> Iterator[list]:
    """Rows of a written table in blocks of about ``numbers`` components, dealt by a hash of the id."""
    total = anchors.agg(F.sum(F.size("v"))).first()[0] or 0
    blocks = -(-total // numbers)
    for b in range(blocks):
        yield anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()


def _swept(anchors: DataFrame, candidates: DataFrame, slots: int, k: int, offers: Callable, numbers: int, prepare: Callable[[list], dict] = lambda rows: {}) -> DataFrame:
    """(anchor_id, slot, vec_id, score, rank): the best of all candidates, a written table for each block of anchors."""
    out = candidates.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    for rows in _blocks(anchors, numbers):
        block = {}
        for dim in {len(r["v"]) for r in rows}:
            own = [r for r in rows if len(r["v"]) == dim]
            block[dim] = {"id": np.array([r["vec_id"] for r in own], np.int64), "label": np.array([r["label"] for r in own], np.int32), "v": np.array([r["v"] for r in own], np.int64), **prepare(own)}
        if block:
            out = out.unionByName(materialise(merged(_met(block, candidates, slots, k, offers), k), "negatives-found"))
    return out


def mine(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors`` against ``rows``, both (vec_id long, label int, v array<long>), ``rows`` a written table."""
    one = anchors.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    one = materialise(one.select("vec_id", "x.label", "x.v"), "negatives-anchors")
    pairs = _swept(one, rows, 1, positives, _offer_positives, block_numbers).select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    scores = pairs.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("p"))  # at most `positives`
    known = materialise(one.join(scores, "vec_id").select("vec_id", "label", "v", F.col("p.positive_score").alias("scores")), "negatives-windows")

    def windows(own: list) -> dict:
        bounds = [_window(r["scores"], positives, least, most) for r in own]
        return {"low": np.array([b[0] for b in bounds], np.int64), "high": np.array([b[1] for b in bounds], np.int64)}

    found = _swept(known, rows, positives, negatives, _offer_negatives, block_numbers, windows)
    return found.join(pairs, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def labelled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v) of the rows of ``vectors(vec_id, label, embedding)`` that take part."""
    return vectors.select("vec_id", F.col("label").cast("int").alias("label"), quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and label is not null and v is not null")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = materialise(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "negatives-rows")
    return mine(rows, rows.where("vec_id % 50 = 0"))


ORACLE_OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
r AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3"""
