"""Queries that parse texts: Markdown segments, JSON leaves, atoms with heading paths; and a stream over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators.headings import heading_paths
from ledgerline.sources.markdown import heading_title, markdown_segments as segment_markdown
from ledgerline.sources.shared import shared_folder
from ledgerline.sources.structured import json_scalars
from ledgerline.streaming import incremental

from .corpus import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _markdown(spark, d):
    text = F.concat(F.lit("# Document "), "doc_id", F.lit("\n\n"), "text", F.lit("\n\n## Notes\n\n- "), "lang", F.lit("\n- "), "source", F.lit("\n\n```\ncode # no heading\n```\n> quoted\n"))
    return segment_markdown(table(spark, d, "documents").select(F.col("doc_id").alias("source"), text.alias("text")))


@query(None)
def markdown_segments(spark, d):
    return _markdown(spark, d).drop("text")


@query("SELECT CAST(doc_id AS VARCHAR) AS source, CAST(strlen(concat_ws(chr(10), '# Document ' || doc_id, '', text, '', '## Notes', '', '- ' || lang, '- ' || source, '', '```', 'code # no heading', '```', '> quoted', '')) AS BIGINT) AS bytes, true AS contiguous FROM documents")
def markdown_coverage(spark, d):
    """Segments cover every byte of their source once."""
    s = _markdown(spark, d)
    return s.groupBy("source").agg(F.max("end_byte").cast("long").alias("bytes"), (F.sum(F.col("end_byte") - F.col("start_byte")) == F.max("end_byte")).alias("contiguous"))


@query(None)
def markdown_atoms(spark, d):
    """Semantic segments below their headings; those before any heading are left out."""
    s = _markdown(spark, d).withColumn("title", heading_title(F.col("text"))).withColumn("level", F.when(F.col("kind") == "heading", F.col("level")))
    paths = heading_paths(s, "source", "seq")
    return paths.where("kind not in ('heading', 'blank', 'rule') and size(path) > 0").select("source", "seq", "kind", F.array_join("path", "/").alias("path"), "text_hash")


@query("""WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events)
SELECT CAST(event_id AS VARCHAR) AS source, path, CASE json_type(props, '$."' || path || '"') WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, json_extract_string(props, '$."' || path || '"') AS value FROM k""")
def structured_scalars(spark, d):
    return json_scalars(table(spark, d, "events").select(F.col("event_id").alias("source"), F.col("props").alias("text"))).select("source", "path", "kind", "value")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_event_windows(spark, d):
    """The events as a stream, to its end; every batch replaces the windows so far."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "*.parquet").load(f"{d}/events.parquet*")
    windows = incremental.event_windows(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", "1 day", ["event_type"], "value")
    incremental.run_available(windows, f"{at}/checkpoint", lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/windows"), "complete")
    return spark.read.parquet(f"{at}/windows")
