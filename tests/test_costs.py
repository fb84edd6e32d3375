"""What findings on larger tables named: choices that depend on partitions, columns computed many times over, keys that fill one task."""

import contextlib

import pyarrow as pa
from pyspark.sql import functions as F

from ledgerline.functions.spans import with_bytes
from ledgerline.operators import citations, graphs, segments, trees
from ledgerline.plans import integrity, parsed, rules
from ledgerline.sources import markdown
from ledgerline.sources.shared import ensure_checkpoints
from tests.conftest import DATA


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@contextlib.contextmanager
def plain_shuffles(spark):
    """No broadcasts, and partitions as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_priority_merge_never_depends_on_partitions(spark):
    rows = [(1, 2, 5, 30), (1, 2, 5, 10), (1, 2, 5, 20), (1, 3, 1, 1), (2, None, 1, 7), (2, 4, None, 8), (2, 4, 9, 9)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, p int, o int, s int").coalesce(1)
        got = {tuple(r) for r in segments.priority_merge(df, "k", "p", ["o"]).select("k", "p", "o", "s", "layers").collect()}
        assert got == {(1, 2, 5, 10, 2), (2, 4, 9, 9, 1)}


def test_short_words_are_judged_once(spark):
    plan = plan_of(rules.short_critical_atoms(spark, DATA))
    assert plan.count("upper(w") == 2 and plan.count(r"(?U)^\s+|\s+$") == 1  # as many as are written


def test_atom_texts_folds_a_line_once(spark):
    assert plan_of(integrity.atom_texts(spark, DATA)).count("translate(") <= 2  # once for lines, once for samples


def test_segment_errors_cuts_and_classifies_lines_once(spark):
    plan = plan_of(integrity.segment_errors(spark, DATA))
    assert plan.count("Relation [") == 1 and plan.count("^#{1,6}") <= 2  # in the filter, and for the rows that it keeps


def test_merkle_proofs_are_joined_level_by_level(spark):
    ensure_checkpoints(spark)
    leaves = spark.range(11).select(F.col("id").alias("idx"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    levels = graphs.merkle_levels(leaves)
    proofs = graphs.merkle_proofs(levels)
    assert plan_of(proofs).count("Join") == 0  # all are in checkpoints, each moving one level
    root = levels[-1].first()["hash"]
    assert [r["r"] for r in proofs.select(graphs.fold_proof(F.col("leaf"), F.col("path")).alias("r")).collect()] == [root] * 11


def test_levels_send_nothing_to_the_driver(spark):
    ensure_checkpoints(spark)
    nodes, edges = spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame([(0, 1), (1, 2)], "source long, target long")
    assert "rightHint=(strategy=merge)" in plan_of(graphs.topological_levels(nodes, edges))


def test_ended_chains_fill_no_task(spark):
    ensure_checkpoints(spark)
    with plain_shuffles(spark):
        rows = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("envelope"), F.lit("c").alias("content"), F.lit(None).cast("string").alias("previous"), F.concat(F.lit("h"), "id").alias("hash"))
        joined = []
        real = trees.left_join_known
        trees.left_join_known = lambda *a: joined.append(real(*a)) or joined[-1]
        try:
            assert trees.chain_report(rows).count() == 4000
        finally:
            trees.left_join_known = real
        assert len(joined) == 2 and largest_share(joined[1]) < 0.5


def test_spans_of_an_unknown_text_fill_no_task(spark):
    texts = spark.createDataFrame([("a", "some text"), ("b", None)], "source string, text string")
    spans = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 < 3, "none").alias("source"), (F.col("id") % 5).alias("start_byte"), (F.col("id") % 5 + 4 + F.col("id")).alias("end_byte"))
    with plain_shuffles(spark):
        assert largest_share(with_bytes(spans.where("source = 'none' or source is null"), texts, "source", "text")) < 0.5
        assert {(r["source"], r["size_"]) for r in with_bytes(spans, texts, "source", "text").collect()} == {("a", 9), ("none", None), (None, None)}


def test_lines_are_dealt_out(spark):
    lines = spark.range(200).select(F.col("id").alias("document"), F.lit(1).alias("line_no"), F.lit("see Annex A and section 2").alias("text")).coalesce(1)
    found = citations.detected_references(lines)
    assert found.rdd.getNumPartitions() > 1 and found.count() == 600


def test_parsers_keep_few_rows(spark):
    """A batch of many texts goes out as many batches of few rows."""
    from ledgerline.sources import batches

    batch = pa.RecordBatch.from_arrays([pa.array(["s"] * 9000), pa.array(["a\n\nb"] * 9000)], ["source", "text"])
    out = list(batches.parsed(iter([batch]), lambda s, t: [(s, x) for x in t.split("\n")], ["s", "x"], [pa.string(), pa.string()]))
    assert max(b.num_rows for b in out) <= batches.ROWS and sum(b.num_rows for b in out) == 27_000
    long = pa.RecordBatch.from_arrays([pa.array(["s"] * 9), pa.array(["x" * batches.CHARS] * 9)], ["source", "text"])
    assert [b.num_rows for b in batches.parsed(iter([long]), lambda s, t: [(s, t)], ["s", "x"], [pa.string(), pa.string()])] == [1] * 9
    assert markdown.parsed is batches.parsed


def test_trees_are_parsed_once(spark):
    assert plan_of(parsed.markdown_tree_coverage(spark, DATA)).count("MapInArrow") == 0  # it is in a checkpoint
