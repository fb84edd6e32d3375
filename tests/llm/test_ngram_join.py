"""Bands and rows, recall on near pairs, and chains of groups."""

import random

from ledgerline.llm import ngram_join
from tests.llm.test_operators import shingles


def test_bands_and_rows():
    for similarity, recall in ((0.8, 0.99995), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = ngram_join.bands_and_rows(similarity, recall)
        assert 1 - (1 - similarity**rows) ** bands >= recall and bands * rows <= ngram_join.HASHES
    assert ngram_join.bands_and_rows(0.8, 0.99995) == (25, 5)


def test_a_long_chain_makes_few_tasks_and_loses_no_link(spark, monkeypatch):
    """Windows that move by one shingle along a long text: all classes form one group, but only neighbours are similar."""
    r = random.Random(3)
    words = [f"w{r.randint(0, 10**6)}" for _ in range(700)]
    rows = [(k, " ".join(words[k : k + 64])) for k in range(0, 620, 3)]
    sets = [shingles(t) for _, t in rows]
    want = {k: sum(o != i and 5 * len(s & x) >= 4 * len(s | x) for o, x in enumerate(sets)) for i, ((k, _), s) in enumerate(zip(rows, sets))}
    tasks = []
    plain = ngram_join.materialise

    def counted(df, label):
        out = plain(df, label)
        if label == "ngram-found":
            tasks.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    got = {x["row_id"]: (x["class_row"], x["n_links"]) for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "row_id long, text string"), block=8).collect()}
    assert got == {k: (0, n) for k, n in want.items()} and min(want.values()) > 0
    assert tasks[0] < len(rows) * 26  # all pairs of blocks would bring each class to 26 of them


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs of a similarity just above 0.8, found by brute force."""
    r = random.Random(9)
    rows = []
    for k in range(300):
        own = [f"w{r.randint(0, 10**6)}" for _ in range(200)]
        rows.append((2 * k, " ".join(own)))
        for at in r.sample(range(3, 197), 4):
            own[at] = "x"
        rows.append((2 * k + 1, " ".join(own)))
    near = [k for k in range(300) if 5 * len((a := shingles(rows[2 * k][1])) & (b := shingles(rows[2 * k + 1][1]))) >= 4 * len(a | b)]
    got = {x["row_id"]: x["class_row"] for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "row_id long, text string")).collect()}
    assert len(near) > 100 and sum(got[2 * k] == got[2 * k + 1] for k in near) == len(near)
    assert all(got[2 * k] != got[2 * k + 1] for k in range(300) if k not in set(near))
