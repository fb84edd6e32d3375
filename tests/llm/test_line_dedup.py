"""Short lines, hot shelves cut into parts, and texts beyond the broadcast bound."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import line_dedup
from tests.llm.test_operators import brute_lines


def lines(n, seed=6):
    r = random.Random(seed)
    own = ["Order number {} has been confirmed by the shop today", "{} yes", "All rights reserved.", "a b c d", "a b c d {}", "ok", "", "x y z w", "x y z w v"]
    return [(k, "\n".join(r.choice(own).format(r.randint(0, 40)) for _ in range(r.randint(1, 6)))) for k in range(n)]


@pytest.mark.parametrize("near", [16, 2])
@pytest.mark.parametrize("setting", [{}, {"HOT_BYTES": 2000, "SAMPLE": 1}, {"BROADCAST_BYTES": -1}, {"SHELVES": 1, "HOT_BYTES": 9000, "SAMPLE": 1, "BROADCAST_ROWS": 2}])
def test_lines_against_brute_force(spark, monkeypatch, near, setting):
    monkeypatch.setattr(line_dedup, "NEAR", near)
    for k, v in setting.items():
        monkeypatch.setattr(line_dedup, k, v)
    rows = lines(150)
    want = set(brute_lines(rows))
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "row_id long, text string").repartition(3)
    assert {(r["row_id"], r["line_no"]) for r in line_dedup.removed_lines(df).collect()} == want
    assert want


def cell(rows):
    """Entries of one shelf that is not cut."""
    return pa.RecordBatch.from_arrays([pa.array([7]), pa.array([0]), pa.array([0]), pa.array([3], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["shelf", "x", "y", "role", "entries"])


def test_lines_that_no_position_allows_are_not_looked_at():
    """Half a billion comparisons before, as each line of a word looked at all earlier ones."""
    rows = np.zeros(30_000, line_dedup.ENTRY)
    rows["word"], rows["row"], rows["size"], rows["at"] = 5, np.arange(30_000), 100, 15
    begun = time.process_time()
    assert sum(x.num_rows for x in line_dedup.meet((4, 5), line_dedup.NEAR)(iter([cell(rows)]))) == 0
    assert time.process_time() - begun < 1


def test_lines_of_a_large_group_have_different_partners():
    """No line is the partner of all others, so the join of pairs with their words has no key of very many rows."""
    r = np.random.default_rng(3)
    rows = np.zeros(2_000, line_dedup.ENTRY)
    rows["word"], rows["row"], rows["size"], rows["at"] = 5, r.permutation(2_000) * 10**15, r.integers(50, 53, 2_000), r.integers(0, 3, 2_000)
    for near in (line_dedup.NEAR, 1):
        pairs = pa.Table.from_batches(line_dedup.meet((4, 5), near)(iter([cell(rows)])))
        a, b = pairs["row_a"].to_numpy(), pairs["row_b"].to_numpy()
        assert (a < b).all()
        later = np.unique(b, return_counts=True)[1]
        assert len(later) == 1_999 and later.max() == near and np.sort(later)[near:].min() == near  # all but the first have partners, and as many as they may
        assert np.unique(a, return_counts=True)[1].max() <= 4 * near


def test_sets_that_repeat_words_differently(spark):
    texts = ["ha", "ha ha ha", "b a", "a b b a", "one two three four five six", "six five four three two one one", "ha ha", "c c c c", "a b c d", "d c b a a a"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(20, "x y\nno\ny x x\nno no")]
    got = {(r["row_id"], r["line_no"]) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert got == set(brute_lines(rows)) == {(1, 0), (3, 0), (5, 0), (6, 0), (9, 0), (20, 2), (20, 3)}
