"""Bytes at spans of texts, with work in proportion to texts and spans: no text is encoded or carried for each of its spans."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.sizes import left_join_spread
from ledgerline.sources.shared import ensure_checkpoints

PIECE = 1 << 16


def text_pieces(texts: DataFrame, key: str, text: str, piece: int = PIECE) -> DataFrame:
    """(key, at_, bytes_): the UTF-8 bytes of each text from ``at_ * piece`` on, two pieces long, so that a span of at most one piece lies in one row. Null texts have none."""
    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("at_", T.LongType()), T.StructField("bytes_", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole in enumerate(batch.column(1)):
                data = whole.as_py()
                if data is None:
                    continue
                starts = range(0, max(len(data), 1), piece)
                for first in range(0, len(starts), 64):
                    some = starts[first : first + 64]
                    keys = batch.column(0).slice(i, 1).take(pa.array([0] * len(some)))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([s // piece for s in some], pa.int64()), pa.array([data[s : s + 2 * piece] for s in some], pa.binary())], [key, "at_", "bytes_"])

    return texts.select(key, F.encode(text, "UTF-8").alias("b")).mapInArrow(cut, schema)


def with_bytes(spans: DataFrame, texts: DataFrame, key: str, text: str, piece: int = PIECE) -> DataFrame:
    """Adds ``size_``, the bytes of the text of each row's key (null if there is none), and ``raw_``, what lies from its start_byte to its end_byte; null outside the text.

    ``texts`` has one row a key; a key, known or not, may have any number of spans. Spans longer than a piece are joined to the whole text: the text then is in proportion to the span.
    """
    ensure_checkpoints(spans.sparkSession)
    sized = left_join_spread(spans, texts.select(key, F.octet_length(text).cast("long").alias("size_")), key)
    start, length = F.col("start_byte").cast("long"), F.col("end_byte") - F.col("start_byte")
    inside = F.coalesce((start >= 0) & (length >= 0) & (F.col("end_byte") <= F.col("size_")), F.lit(False))
    last = F.greatest(F.floor((F.col("size_") - 1) / piece), F.lit(0)).cast("long")
    nowhere = -1 - F.pmod(F.xxhash64(key, "start_byte", "end_byte"), F.lit(1 << 16))  # no piece; spreads the rows of one unknown text
    rows = sized.withColumn("at_", F.when(inside & (length <= piece), F.least(F.floor(start / piece).cast("long"), last)).otherwise(nowhere))
    slice_ = lambda data, begin: F.decode(F.substring(data, begin.cast("int") + 1, length.cast("int")), "UTF-8")
    short = rows.where(~inside | (length <= piece)).join(text_pieces(texts, key, text, piece), [key, "at_"], "left").withColumn("raw_", slice_(F.col("bytes_"), start - F.col("at_") * piece)).drop("at_", "bytes_")
    wide = rows.where(inside & (length > piece)).drop("at_").join(texts.select(key, F.encode(text, "UTF-8").alias("bytes_")), key).withColumn("raw_", slice_(F.col("bytes_"), start)).drop("bytes_")
    return short.unionByName(wide)
