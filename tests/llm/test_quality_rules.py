"""Window keys of long texts, the determinant's minimum, and documents that share or lack an id."""

import numpy as np

from ledgerline.llm import quality_rules as q
from tests.llm.conftest import prose


def test_windows_that_differ_only_in_high_bits_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(q, "WINDOW_HASH", "shiftleft(xxhash64(h[i], h[i + 1], h[i + 2]), 40)")
    words = [f"w{k}" for k in range(2000)]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words + words[:5]))], "id long, text string")
    got = {r["id"]: r["x"]["n_repeat_words"] for r in rows.select("id", q.repeat_statistics("split(text, ' ')").alias("x")).collect()}
    assert got == {1: 0, 2: 10}


def plain_steps(x, h, centre, scatter, blend):
    """Concentration steps of one group from one start, until the kept rows stay."""
    kept = None
    while True:
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        now = np.sort(np.argsort(d, kind="stable")[:h])
        if kept is not None and (now == kept).all():
            return np.linalg.slogdet(scatter)[1]
        kept = now
        centre, scatter = x[now].mean(0), np.cov(x[now].T, bias=True) + np.diag(np.square(q.FLOOR))


def test_least_determinant(spark):
    """No worse than many random starts of a plain version, and the far cluster gets no weight."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(0, 1, (700, q.P)) @ np.tril(r.normal(0, 0.6, (q.P, q.P))) + 2, r.normal(9, 0.3, (160, q.P))])
    df = spark.createDataFrame([("g", *map(float, row)) for row in x], "gkey string, " + ", ".join(f"{f} double" for f in q.FEATURES)).repartition(4)
    fit = q.fit_mcd(df, blend=0.0).first()
    h = int(0.75 * len(x))
    tried = []
    for _ in range(30):
        own = x[r.choice(len(x), q.P + 1, replace=False)]
        tried.append(plain_steps(x, h, own.mean(0), np.cov(own.T, bias=True) + np.diag(np.square(q.FLOOR)), 0))
    assert fit["logdet"] < min(tried) + 0.1
    assert np.abs([fit[f"m{i}"] for i in range(q.P)] - x[:700].mean(0)).max() < 0.3


def test_documents_without_or_with_one_id_are_judged_one_by_one(spark):
    good = [(k, prose(300, k)) for k in range(150)]
    bad = " ".join(w + "###" for w in prose(300, 7).split())
    rows = spark.createDataFrame([(i, t, "en", "s", "x") for i, t in [*good, (3, bad), (None, bad), (None, prose(300, 501))]], "doc_id long, text string, lang string, source string, row_id string")
    kept = q.reject_outliers(rows).collect()
    assert not any("###" in r["text"] for r in kept) and sum(r["doc_id"] == 3 for r in kept) == 1 and sum(r["doc_id"] is None for r in kept) == 1
    assert len(kept) >= 140 and {r["row_id"] for r in kept} == {"x"}
