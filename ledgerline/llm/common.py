"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only when its counted rows stay within this bound.
BROADCAST_ROWS = 200_000
#: Folders that tables are written to now, below the application's own.
_scratch: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())
#: Arrow batches of written tables stay near this size, so that batches of long rows fit beside a small heap.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def give_back() -> None:
    """Return memory that Arrow and the C library hold free in this process to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, its memory goes back to the system, as Python workers outlive it and count beside later stages."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)  # what it holds goes with it, before this goes on
        finally:
            give_back()

    return tidied


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where that is unset in local mode, where all is one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/checkpoints/ledgerline-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialise(df: DataFrame, label: str, outer: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and any executor can reread it. ``outer`` tables outlive the scratch folder."""
    spark = df.sparkSession
    path = f"{own_dir(spark, outer)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before) if before is not None else spark.conf.unset(BATCH_SETTING)
    return spark.read.schema(df.schema).parquet(path)


def own_dir(spark: SparkSession, outer: bool = False) -> str:
    return "/".join([shared_dir(spark), "ledgerline", spark.sparkContext.applicationId, *([] if outer else _scratch.get())])


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables that are written within go when it ends; save what reads them before, as an ``outer`` table."""
    token = _scratch.set((*_scratch.get(), f"{name}-{uuid.uuid4().hex}"))
    folder = own_dir(spark)
    try:
        yield
    finally:
        _scratch.reset(token)
        _delete(spark, folder)


def drop_materialised(spark: SparkSession) -> None:
    """Delete the tables that this application wrote; call it once results that read them are saved."""
    _delete(spark, own_dir(spark))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting that the (materialised) table is within the bound; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, label: str, rounds: int = 40) -> DataFrame:
    """Smallest vertex of each component for every vertex of ``edges(a, b)``.

    Each round takes the smallest label among the neighbours and then jumps to that label's own label, so
    the number of rounds grows with the logarithm of a component's diameter. Every round ends in a written table.
    Returns ``(vertex, component)``; vertices without an edge are not listed. Null ends are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{label}-labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("vertex", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        merged = labels.join(near.withColumnRenamed("a", "vertex"), "vertex", "left").select("vertex", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("vertex").alias("component"), F.col("component").alias("root"))
        now = materialise(merged.join(jump, "component", "left").select("vertex", "was", F.least("component", "root").alias("component")), f"{label}-labels")
        changed = now.where("was <> component").limit(1).count()
        labels = now.select("vertex", "component")
        if not changed:
            return labels
    raise RuntimeError(f"{label}: components did not settle in {rounds} rounds")


#: Parts that hashes are dealt to when rows are sampled, first coarsely, then finely.
COARSE, FINE = 1_000_000, 1 << 40


def sample_shares(bound: int, rows: int) -> tuple[int, int]:
    """Of ``COARSE`` and of ``FINE`` parts those that a sample of about ``bound`` rows takes; at least one of each, however many rows there are."""
    share = min(1.0, bound / max(1, rows)) * COARSE
    return (int(share), FINE) if share >= 1 else (1, max(1, int(share * FINE)))


def sampled(key: Column, coarse: Column, fine: Column) -> Column:
    """Whether a row belongs to the sample, by hashes of its key."""
    return (F.pmod(F.xxhash64(key), F.lit(COARSE)) < coarse) & (F.pmod(F.xxhash64(F.lit("fine"), key), F.lit(FINE)) < fine)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``row_id``: doc_id where all are there and differ, else the rows' place in the order of doc_id (nulls first) and text."""
    n = docs.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("k")).first()
    if n["n"] == n["k"]:
        return docs.withColumn("row_id", F.col("doc_id").cast("long"))
    return materialise(docs.orderBy("doc_id", F.xxhash64("text")).withColumn("row_id", F.monotonically_increasing_id()), "keyed")


def nested(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns beside ``keep_``, a struct of all, so that no name of ours meets one of theirs."""
    return docs.select(*used, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("keep_"))


def unnested(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``keep_``, in order, some of them changed."""
    return rows.select(*((changed[c] if c in changed else F.col(f"keep_.`{c}`")).alias(c) for c in columns))
