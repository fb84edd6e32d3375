"""Distances and ranks against SQL; the automaton in one block and in many."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.source_divergence import ORACLE_OP11, audit, op11_source_divergence, share
from tests.conftest import DATA

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def wanted(d, least=30, ranks=50):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{d}/documents.parquet{'' if d == DATA else '/*.parquet'}'")
    return sorted(con.sql(ORACLE_OP11.replace(">= 30", f">= {least}").replace("<= 50", f"<= {ranks}")).fetchall())


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_data_against_sql(spark):
    found = got(op11_source_divergence(spark, DATA))
    assert found == wanted(DATA) and {x[2] for x in found} == {"pair", "term"}


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_odd_tables_and_blocks(spark, odd_dir, block):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "fr").otherwise(F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 4 == 1, "é").when(F.col("doc_id") % 4 == 2, "z").otherwise(F.col("source")))
    out = odd_dir + f"-terms{block}"
    docs.write.parquet(f"{out}/documents.parquet")
    found = got(audit(docs, least=3, ranks=7, block_bytes=block))
    assert found == wanted(out, 3, 7) and len({x[:2] for x in found}) > 5


def test_terms_share_delimiters_and_fold_only_ascii(spark):
    rows = [(1, "a A-a1b É é\tÀ", "x", "s"), (2, "b" * 50_000 + " a a", "x", "t"), (3, None, "x", None), (4, "0 _ \x7f", "y", "s")]
    found = got(audit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), least=1))
    terms = {(x[1], x[3]) for x in found if x[2] == "term"}
    assert ("s", "É") in terms and ("s", "é") in terms and ("t", "b" * 50_000) in terms
    assert {x[1:2] + x[3:4] for x in found if x[2] == "pair"} == {(a, b) for a in ("s", "t", "") for b in ("s", "t", "") if a != b}


def test_share_is_exact_beyond_64_bits(spark):
    count, total, v = 9_000_000_000_000_123, 9_000_000_000_000_457, 1_000_003
    row = spark.createDataFrame([(count, total, v)], "c long, t long, v long").select(share(F.col("c"), F.col("t"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 5) // (total + 5 * v)
