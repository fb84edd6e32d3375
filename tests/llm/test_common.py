"""Scratch folders, and where tables may be written."""

import pytest

from ledgerline.llm import common


def test_scratch_tables_go_and_outer_ones_stay(spark):
    with common.scratch(spark, "stage"):
        inner = common.materialise(spark.range(5).toDF("a"), "inner")
        outer = common.materialise(inner.withColumn("b", inner.a + 1), "outer", outer=True)
        assert inner.count() == 5
    assert outer.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        spark.read.parquet(inner.inputFiles()[0]).count()


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_sample_shares_never_vanish():
    from ledgerline.llm.common import COARSE, FINE, sample_shares

    for bound in (2_000, 20_000):
        for rows in (0, 1, bound, 10 * bound, 2 * 10**9 + 1, 10**11, 10**15):
            coarse, fine = sample_shares(bound, rows)
            taken = rows * coarse / COARSE * fine / FINE
            least = rows if rows <= bound else 0.99 * bound if fine < FINE else bound - rows / COARSE  # the coarse share is rounded down
            assert coarse >= 1 and fine >= 1 and least <= taken <= max(bound, rows if rows <= bound else 0) * 1.01


def test_languages_of_very_many_documents_are_learnt(spark, monkeypatch):
    from ledgerline.llm import language_id
    from ledgerline.llm.common import sample_shares

    monkeypatch.setattr(language_id, "sample_shares", lambda bound, rows: sample_shares(bound * 10**7, rows * 10**7))  # as if each language had 10**9 documents and more
    docs = spark.createDataFrame([(i, f"wort{i % 7} noch eins" if i % 2 else "some other words", "de" if i % 2 else "en") for i in range(400)], "doc_id long, text string, lang string")
    assert {r["lang"] for r in language_id.word_counts(docs, 2_000).collect()} == {"de", "en"}


def test_sampled_is_about_its_share(spark):
    from pyspark.sql import functions as F

    from ledgerline.llm.common import COARSE, FINE, sampled

    n = spark.range(200_000).where(sampled(F.col("id"), F.lit(COARSE // 10), F.lit(FINE // 2))).count()
    assert 9_000 < n < 11_000


def workers_mb(spark) -> float:
    """Memory that the idle Python worker which holds most of its own has."""

    def own(batches):
        import re
        from pathlib import Path

        import pyarrow as pa

        for _ in batches:
            pass
        yield pa.RecordBatch.from_pydict({"kb": [int(re.search(r"\nPrivate_Dirty:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1])]})

    return max(r["kb"] for _ in range(3) for r in spark.range(0, 400, 1, 4).mapInArrow(own, "kb long").collect()) / 1024


def test_workers_give_memory_back(spark):
    from pyspark.sql import functions as F

    from ledgerline.llm.packing import cut_documents

    texts = spark.range(0, 32, 1, 4).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(0, 6000), k -> concat('Ab', hex(id * 6001 + k), ',')), ' ')").alias("text"))
    cut_documents(texts.where("doc_id % 8 = 0")).count()  # what is loaded once
    before = workers_mb(spark)
    assert cut_documents(texts).agg(F.sum("length")).first()[0] > 32 * 6001
    assert workers_mb(spark) - before < 10


def test_a_tidied_function_ends_before_memory_is_given_back(monkeypatch):
    seen = []

    class Held:
        def __del__(self):
            seen.append("gone")

    def run(batches):
        held = Held()
        yield from batches
        assert held

    monkeypatch.setattr(common, "give_back", lambda: seen.append("given back"))
    assert list(common.tidy(run)(iter("ab"))) == ["a", "b"] and seen == ["gone", "given back"]
    left = common.tidy(run)(iter("ab"))
    next(left)
    left.close()  # a task that is ended early
    assert seen == ["gone", "given back"] * 2
