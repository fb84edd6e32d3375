"""Streams over arriving files: windowed counts with late data, and snapshot changes per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.snapshots import diff_snapshots


def event_windows(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling counts and sums; events later than ``late`` behind the newest are dropped, and state with them."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return w.select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a restart from the same checkpoint goes on where it ended."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return q


def snapshot_changes(spark: SparkSession, state: str) -> Callable[[DataFrame, int], None]:
    """A sink for batches (path, content_hash): writes each batch's changes below ``state/changes`` and the new snapshot below ``state/snapshot``.

    Both are named by the batch, so a batch that is tried again writes the same folders.
    """

    def sink(batch: DataFrame, n: int) -> None:
        new = batch.groupBy("path").agg(F.max("content_hash").alias("content_hash"))
        old = spark.read.parquet(f"{state}/snapshot/{n - 1}") if n else new.limit(0)
        known = diff_snapshots(old.join(new.select("path"), "path", "left_semi"), new)
        known.where("status <> 'unchanged'").write.mode("overwrite").parquet(f"{state}/changes/{n}")
        old.join(new.select("path"), "path", "left_anti").unionByName(new).write.mode("overwrite").parquet(f"{state}/snapshot/{n}")

    return sink
