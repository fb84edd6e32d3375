"""Extension points, inline Markdown and governance on small hand-made rows: nulls, blanks, empty tables, errors."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import audit, extensions, governance, inline, integrity, selection


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_a_scorer_has_to_give_scores_from_0_to_1(spark):
    pairs = spark.createDataFrame([(1, "a b", "a"), (2, "", None)], "id long, premise string, hypothesis string")
    assert rows(extensions.score_pairs(pairs, lambda p, h: [0.5] * len(p)), "id", "score") == [(1, 0.5), (2, 0.5)]
    for bad in (lambda p, h: [2.0] * len(p), lambda p, h: [0.5] * (len(p) + 1), lambda p, h: [None] * len(p)):
        with pytest.raises(Exception, match="one score"):
            extensions.score_pairs(pairs, bad).collect()


def test_adapters_account_for_every_file(spark):
    files = spark.createDataFrame([("a.md", "x"), ("b.zip", "é"), ("c", None)], "path string, text string")
    own = extensions.Adapters()
    assert {r["kind"] for r in own.parse(files).collect()} == {"unsupported_block"}
    own.register("md", lambda f: f.select("path", F.lit("paragraph").alias("kind"), "text", F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte")))
    assert rows(own.parse(files), "path", "kind", "end_byte") == [("a.md", "paragraph", 1), ("b.zip", "unsupported_block", 2), ("c", "unsupported_block", None)]
    with pytest.raises(ValueError):
        own.register("md", None)


def test_inline_spans(spark):
    text = "é [a](b) ![](c) [x] (y)"
    lines = spark.createDataFrame([("s", 0, 10, text), ("s", 1, 40, None), ("s", 2, 50, r"|a\|b|| c|")], "source string, line_no long, start_byte long, line string")
    got = rows(inline.inline_references(lines), "kind", "label", "target", "start_byte", "end_byte")
    raw = text.encode()
    assert got == [("image_ref", "", "c", 10 + raw.index(b"!"), 10 + raw.index(b"!") + 6), ("link", "a", "b", 13, 19)]
    assert rows(inline.table_cells(lines), "cell_no", "text", "start_byte", "end_byte") == [(1, r"a\|b", 51, 55), (2, "", 56, 56), (3, "c", 57, 59)]
    assert rows(inline.list_items(lines.withColumn("line", F.lit("    * é x"))), "marker", "depth", "text")[0] == ("*", 2, "é x")
    assert not inline.inline_references(lines.limit(0)).collect()


def test_integrity_of_an_empty_and_of_a_broken_ledger(spark):
    schema = "segment_id string, source_id string, source_path string, kind string, disposition string, text string, start_byte long, end_byte long, start_line int, end_line int, start_column int, end_column int, raw_text_hash string, normalized_text_hash string, unsupported_reason string"
    ok = ("a", "s", "p", "paragraph", "canonical_atom", "text", 2, 5, 1, 1, 0, 3, "h", "n", None)
    ledger = spark.createDataFrame([ok, ("b", *ok[1:]), ("c", "s", "p", None, "odd", " ", 9, 8, 1, 1, 5, 3, None, None, None)], schema)
    sources = spark.createDataFrame([("s", 7), ("empty", 0)], "source_id string, total_bytes long")
    assert rows(integrity.source_integrity(ledger, sources), "source_id", "code", "start_byte", "end_byte") == [("s", "SOURCE_DUPLICATE_SEMANTIC_SPAN", 2, 5), ("s", "SOURCE_SEGMENT_INVALID_RANGE", 9, 8), ("s", "SOURCE_UNCOVERED_RANGE", 0, 2), ("s", "SOURCE_UNCOVERED_RANGE", 5, 7)]
    assert {r[0] for r in ledger.select(integrity.segment_error()).collect()} == {None, "kind must be non-empty"}
    assert integrity.gate_status(integrity.source_integrity(ledger.limit(0), sources.limit(0))).first()["status"] == "pass"


def test_selections_of_nulls(spark):
    one = spark.createDataFrame([(None, None)], "a string, tags array<string>")
    got = one.select(selection.at_least(F.col("a"), "low"), selection.with_tag(F.col("tags"), ["X"]), selection.extractable(F.col("a"), F.col("a")), selection.non_semantic(F.col("a"), F.col("a"))).first()
    assert tuple(got) == (False, False, False, False)


def test_assessments_without_rows(spark):
    none = spark.createDataFrame([], "key string, compliance string")
    assert audit.overall_compliance(none, "key").count() == 0
    assert tuple(audit.kind_share(spark.createDataFrame([], "kind string"), "x").first()) == (0, 0, 0.0)
    gate = governance.checks_gate(spark.createDataFrame([], "category string, status string, score double, blocking boolean")).first()
    assert (gate["score"], gate["passes"], gate["failed"]) == (0.0, True, 0)
