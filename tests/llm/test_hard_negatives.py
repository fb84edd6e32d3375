"""Positives and windowed negatives against SQL and a plain version."""

import random

import duckdb
import pytest

from ledgerline.llm.hard_negatives import ORACLE_OP12, mine, op12_hard_negatives
from tests.conftest import DATA

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, label int, v array<long>"


def plain(rows, is_anchor):
    out = []
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        met = sorted((-sum(x * y for x, y in zip(v, w)), i, m) for i, m, w in rows if i != a and len(w) == len(v))
        for score, positive, _ in [x for x in met if x[2] == label][:5]:
            fit = [x for x in met if x[2] != label and -50 * score <= -100 * x[0] <= -95 * score]
            out += [(a, positive, n + 1, x[1], -score, -x[0]) for n, x in enumerate(fit[:3])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_data_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    found = got(op12_hard_negatives(spark, DATA))
    assert found == sorted(con.sql(ORACLE_OP12).fetchall()) and found


def test_odd_vectors(spark, odd_dir, tmp_path):
    rows = spark.read.parquet(f"{odd_dir}/embeddings.parquet").selectExpr("vec_id", "embedding", "cast(case when vec_id % 11 = 3 then null else vec_id % 4 end as int) label", "score as v")
    rows = rows.where("vec_id is null or vec_id <> 20")  # of rows with one id SQL takes each as an anchor
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got(op12_hard_negatives(spark, str(tmp_path))) == sorted(con.sql(ORACLE_OP12).fetchall())


@pytest.mark.parametrize("numbers", [100, 2_000_000])
def test_ties_blocks_and_unlike_lengths(spark, monkeypatch, numbers):
    monkeypatch.setattr("ledgerline.llm.hard_negatives.SCORES", 1000)
    r = random.Random(numbers)
    rows = [(i, r.randrange(3), [r.randint(-3, 6) for _ in range(4 if i % 5 else 6)]) for i in range(600)] + [(i, i % 3, [4, 4, 4, 4]) for i in range(600, 900)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(mine(df, df.where("vec_id % 50 = 0"), block_numbers=numbers)) == plain(rows, lambda i: i % 50 == 0)


def test_exact_beyond_doubles(spark):
    big = 2**27
    rows = [(0, 0, [big, big]), (1, 0, [big, big - 1]), (2, 0, [big, big]), (3, 1, [big - big // 4, big // 2 + 1]), (4, 1, [big - big // 4, big // 2]), (5, 1, [big // 2, big // 2]), (6, 1, [big // 2, big // 2 - 1])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(mine(df, df.where("vec_id = 0"))) == plain(rows, lambda i: i == 0)


def test_repeated_and_lone_rows(spark):
    rows = [(0, 1, [5, 5]), (0, 1, [9, 9]), (1, 1, [4, 4]), (2, 2, [3, 3]), (2, 2, [3, 3]), (50, 7, [1, 1])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(mine(df, df.where("vec_id % 50 = 0"))) == [(0, 1, 1, 2, 40, 30), (0, 1, 2, 2, 40, 30)]
