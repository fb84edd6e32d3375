"""Bytes at spans against slices in Python, for pieces of any size, and a large text with many spans in time."""

import random
import time

import pytest

from ledgerline.functions.spans import with_bytes
from ledgerline.operators.audit import text_mismatches


@pytest.mark.parametrize("piece", [1, 3, 8, 1 << 16])
def test_spans(spark, piece):
    texts = {"a": "plain text of some length", "b": "", "c": "x" * 17, "d": None}
    rng = random.Random(3)
    rows = [(k, rng.randrange(-1, 28), rng.randrange(-1, 28)) for k in ("a", "b", "c", "d", "none") for _ in range(60)] + [("a", 0, 25), ("a", 25, 25), ("a", 7, None), ("b", 0, 0), ("c", 16, 17), ("c", 17, 17)]
    spans = spark.createDataFrame(rows, "source string, start_byte long, end_byte long")
    got = sorted((r["source"], r["start_byte"], r["end_byte"] is None, r["end_byte"] or 0, r["size_"], r["raw_"]) for r in with_bytes(spans, spark.createDataFrame(list(texts.items()), "source string, text string"), "source", "text", piece).collect())
    want = []
    for k, s, e in rows:
        t = texts.get(k)
        want.append((k, s, e is None, e or 0, None if t is None else len(t), t[s:e] if t is not None and e is not None and 0 <= s <= e <= len(t) else None))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_long_text(spark):
    n = 5_000_000
    texts = spark.range(1).selectExpr("'a' as source", f"repeat('é', {n}) as text")
    spans = spark.range(20_000).selectExpr("'a' as source", "id * 400 as start_byte", "id * 400 + 40 as end_byte")
    began = time.time()
    assert with_bytes(spans, texts, "source", "text").where("raw_ = repeat('é', 20)").count() == 20_000
    assert time.time() - began < 40


def test_mismatches(spark):
    """Other bytes and spans outside the text are mismatches; units without a span, a source or a text are not."""
    rows = [("same", "a", 0, 3, "été"[:2]), ("trim", "a", 0, 6, " été"), ("other", "a", 0, 3, "x"), ("beyond", "a", 2, 99, "té"), ("none", "a", None, None, "x"), ("lost", "z", 0, 1, "x"), ("null", "n", 0, 1, "x")]
    units = spark.createDataFrame(rows, "unit_id string, source string, start_byte long, end_byte long, text string")
    texts = spark.createDataFrame([("a", "été "), ("n", None)], "source string, source_text string")
    assert {r["unit_id"] for r in text_mismatches(units, texts).collect()} == {"other", "beyond"}
