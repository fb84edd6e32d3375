"""Running sums, and what they carry: line spans of long texts in time that follows their length."""

import itertools
import time

import pytest

from ledgerline.functions.arrays import running, running_sums
from ledgerline.operators.segments import line_ledger


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 4097])
def test_running_sums(spark, n):
    own = [(7 * k) % 11 for k in range(n)]
    rows = spark.createDataFrame([(own,)], "w array<int>")
    assert rows.selectExpr(f"{running_sums('w')} as r").first()["r"] == [0, *itertools.accumulate(own)][:n]
    assert rows.selectExpr(f"{running('w', '-1', 'greatest({0}, {1})')} as r").first()["r"] == [-1, *itertools.accumulate(own, max)][:n]


def test_line_spans_of_long_texts(spark):
    def took(n):
        text = "\n".join(["é" * (k % 5) for k in range(n)])
        began = time.time()
        rows = line_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string")).selectExpr("count(1) n", "max(end_byte) last").first()
        assert (rows["n"], rows["last"]) == (n, len(text.encode()))
        return time.time() - began

    took(10)
    assert took(200_000) < 8 * took(50_000) + 5
