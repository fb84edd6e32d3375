"""Line segments with exact byte spans, coverage of sources, gaps, duplicates and length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.arrays import running_sums
from ledgerline.functions.text import is_blank, normalized_hash, raw_hash
from ledgerline.sources.shared import ensure_checkpoints

from .pieces import ranked, running_max
from .sizes import join_counted


def line_ledger(docs: DataFrame, source: str = "doc_id", text: str = "text") -> DataFrame:
    """(source, line_no, start_byte, end_byte, line, line_hash): lines of a text with half-open byte spans, the line feed not included.

    Spans come from running sums over the text's own lines, so nothing is shuffled. Null text has no lines.
    """
    starts = F.expr(running_sums(f"transform(split(`{text}`, '\\n', -1), x -> octet_length(x) + 1)"))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.arrays_zip(F.split(F.col(text), "\n", -1).alias("line"), starts.alias("start")).alias("z"))
    rows = rows.select("source", F.posexplode("z").alias("line_no", "z"))
    return rows.select("source", F.col("line_no").cast("long").alias("line_no"), F.col("z.start").alias("start_byte"), (F.col("z.start") + F.octet_length("z.line")).alias("end_byte"), F.col("z.line").alias("line"), raw_hash(F.col("z.line")).alias("line_hash"))


def disposition(line: Column) -> Column:
    """What a line is: blank, heading, rule, table, list_item, quote, code or paragraph."""
    return (
        F.when(is_blank(line), "blank").when(line.rlike(r"^#{1,6}\s"), "heading").when(line.rlike(r"^(\*{3,}|-{3,}|_{3,})\s*$"), "rule").when(line.rlike(r"^(```|~~~)"), "code")
        .when(line.contains("|"), "table").when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), "list_item").when(line.rlike(r"^\s*>"), "quote").otherwise("paragraph")
    )


def coverage(segments: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: bytes covered by semantic segments, excluded bytes, and the rest, which is never below 0.

    ``segments``: (source, start_byte, end_byte, semantic); ``sources``: (source, total_bytes, ...).
    """
    size = F.col("end_byte") - F.col("start_byte")
    per = segments.groupBy("source").agg(F.sum(F.when(F.col("semantic"), size).otherwise(0)).alias("covered_bytes"), F.sum(F.when(~F.col("semantic"), size).otherwise(0)).alias("excluded_bytes"))
    out = sources.join(per, "source", "left").na.fill(0, ["covered_bytes", "excluded_bytes"])
    return out.withColumn("uncovered_bytes", F.greatest(F.col("total_bytes") - F.col("covered_bytes") - F.col("excluded_bytes"), F.lit(0)))


def ledger_totals(ledger: DataFrame, groups: list[str]) -> DataFrame:
    """Sums over all sources and by each group: one pass with grouping sets."""
    sets = [[], *([g] for g in groups)]
    sums = [F.sum(c).alias(c) for c in ("total_bytes", "covered_bytes", "excluded_bytes", "uncovered_bytes")]
    keys = [F.col(g) for g in groups]
    return ledger.groupingSets([[F.col(g) for g in s] for s in sets], *keys).agg(*sums, F.count(F.lit(1)).alias("sources"))


def span_gaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, gap_start, gap_end): ranges between merged spans, by the running end of all earlier spans."""
    rows = running_max(spans.select(key, start, end), key, [start, end], end, "reach")
    return rows.where(F.col(start) > F.col("reach")).select(F.col(key), F.col("reach").alias("gap_start"), F.col(start).alias("gap_end"))


def duplicate_findings(units: DataFrame, key: str, order: list[str], blocking: int = 3, warning: int = 2) -> DataFrame:
    """All but the first of a group with equal ``key``, with the group's size and severity; ``units`` are read three times, so write them first if they are costly."""
    ensure_checkpoints(units.sparkSession)
    sizes = units.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*order)).alias("first")).where(F.col("group_size") >= warning).checkpoint()
    rows = join_counted(units, sizes, key, "group_size").where(F.struct(*order) != F.col("first"))
    return rows.drop("first").withColumn("severity", F.when(F.col("group_size") >= blocking, "blocking").otherwise("warning"))


def duplicate_groups(units: DataFrame, top: int, examples: int) -> DataFrame:
    """The largest groups of equal normalised text: (hash, units, examples)."""
    h = units.withColumn("hash", normalized_hash(F.col("text")))
    groups = h.groupBy("hash").agg(F.count(F.lit(1)).alias("units")).where("units > 1").orderBy(F.desc("units"), "hash").limit(top)
    ranked = h.join(F.broadcast(groups), "hash").withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("unit_id"))).where(F.col("nth") <= examples)
    return ranked.groupBy("hash").agg(F.first("units").alias("units"), F.array_join(F.array_sort(F.collect_list("unit_id")), ",").alias("examples"))


def length_buckets(units: DataFrame, key: str, tokens: Column, chars: Column) -> DataFrame:
    """Cumulative counts of short units, and of those above the last bound."""
    t = [F.count_if(tokens <= k).alias(f"tokens_le_{k}") for k in (2, 10, 25, 100)] + [F.count_if(tokens > 100).alias("tokens_gt_100")]
    c = [F.count_if(chars <= k).alias(f"chars_le_{k}") for k in (10, 50, 200, 1000)] + [F.count_if(chars > 1000).alias("chars_gt_1000")]
    return units.groupBy(key).agg(F.count(F.lit(1)).alias("units"), *t, *c)


def unique_ids(rows: DataFrame, base: str, order: list[str]) -> DataFrame:
    """Adds unit_id: the base, with -02, -03 … for later occurrences in order."""
    n = F.col("nth_")
    return ranked(rows, base, order, "nth_").withColumn("unit_id", F.when(n == 1, F.col(base)).otherwise(F.concat(F.col(base), F.format_string("-%02d", n)))).drop("nth_")


def priority_merge(rows: DataFrame, key: str, priority: str, order: list[str]) -> DataFrame:
    """One row per key: the lowest priority number, then the first in order, nulls last; ``layers`` counts the different priorities. Rows equal in both are told apart by their other columns, so the choice never depends on partitions."""
    cols = [c for c in rows.columns if c != key]
    first = [priority, *order, *(c for c in cols if c not in (priority, *order))]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct(*(x for c in first for x in (F.col(c).isNull(), F.col(c))))).alias("best"), F.countDistinct(priority).alias("layers"))
    return best.select(key, "best.*", "layers")
