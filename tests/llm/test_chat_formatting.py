"""A conversation of very many turns."""

import time

from pyspark.sql import functions as F

from ledgerline.llm.chat_formatting import format_paths


def test_loss_spans_of_many_turns(spark):
    def took(n):
        turns = spark.range(n).select(F.lit("p").alias("path"), F.lit(1).alias("tree_id"), F.lit(1).alias("path_rank"), (-F.col("id")).alias("depth"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
        began = time.time()
        row = format_paths(turns).first()
        assert len(row["loss"]) == n // 2
        for k in (0, n // 4, n // 2 - 1):
            assert row["formatted"][row["loss"][k]["start"] : row["loss"][k]["end"]] == f"é{2 * k + 1}"
        return time.time() - began

    took(10)
    assert took(80_000) < 8 * took(20_000) + 5
