"""Canonical forms of nested values: permuted lists agree, ordered ones do not."""

import random

from pyspark.sql import functions as F

from ledgerline.functions.canonical import canonical, digest

SCHEMA = "id int, r struct<name:string,checks:array<struct<id:int,found:array<string>>>,steps:array<string>,tags:map<string,array<int>>,grid:array<array<int>>>"


def report(r):
    mixed = lambda x: r.sample(x, len(x))
    return ("a", mixed([(1, mixed(["x", "y", None])), (1, mixed(["z"])), (2, None), (3, [])]), ["one", "two"], {k: mixed([3, 1, 2]) for k in mixed(["p", "q"])}, mixed([mixed([1, 2]), mixed([0, 9]), []]))


def test_permuted_reports_have_one_digest(spark):
    r = random.Random(7)
    rows = [(i, report(r)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    kind = df.schema["r"].dataType
    assert df.select(digest(F.col("r"), kind).alias("d")).distinct().count() == 1
    form = df.select(canonical(F.col("r"), kind).alias("r")).first()["r"]
    assert [(c["id"], c["found"]) for c in form["checks"]] == [(1, ["x", "y", None]), (1, ["z"]), (2, None), (3, None)]
    assert form["grid"] == [[0, 9], [1, 2], None] and form["tags"][0]["value"] == [1, 2, 3]


def test_other_reports_differ(spark):
    base = ("a", [(1, ["x"])], ["one", "two"], {"p": [1]}, [[1]])
    rows = [(0, base), (1, ("a", [(1, ["x", "x"])], *base[2:])), (2, (*base[:2], ["two", "one"], *base[3:])), (3, None), (4, (*base[:3], {"p": [2]}, [[1]]))]
    df = spark.createDataFrame(rows, SCHEMA)
    kind = df.schema["r"].dataType
    assert df.select(digest(F.col("r"), kind).alias("d")).distinct().count() == 4  # steps may be in any order
    assert df.select(digest(F.col("r"), kind, frozenset({"steps"})).alias("d")).distinct().count() == 5
