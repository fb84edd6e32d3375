"""Windows in pieces against brute force (a hot key over many pieces, rows without a key, ties, no rows); odd cases of certificates, reports and stated snapshots."""

import random

import pytest

from ledgerline.operators import governance as gv
from ledgerline.operators import identity as idt
from ledgerline.operators import quality as qu
from ledgerline.operators.pieces import ranked, running_max, with_neighbours
from ledgerline.sources.shared import ensure_checkpoints


def rows(n, seed):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "a", "b", None, f"k{r.randint(0, 40)}"]), r.randint(0, 10 * n) if n else 0, k, r.choice([None, r.randint(0, 10**6)])) for k in range(n)]


def by_key(made):
    out = {}
    for k, o, i, v in sorted(made, key=lambda x: x[1:3]):
        out.setdefault(k, []).append((o, i, v))
    return out


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 3), (400, 16), (900, 5)])
def test_windows_equal_brute_force(spark, n, parts):
    made = rows(n, n)
    df = spark.createDataFrame(made, "k string, o long, i long, v long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reach = {r["i"]: r["reach"] for r in running_max(df, "k", ["o", "i"], "v", "reach").collect()}
        nth = {r["i"]: r["nth"] for r in ranked(df, "k", ["o", "i"], "nth").collect()}
        near = {r["i"]: (r["p"], r["f"]) for r in with_neighbours(df, "k", ["o", "i"], "v", "p", "f").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(reach) == len(nth) == len(near) == n
    for group in by_key(made).values():
        for j, (_, i, _) in enumerate(group):
            assert reach[i] == max((v for _, _, v in group[:j] if v is not None), default=None)
            assert nth[i] == j + 1
            assert near[i] == (group[j - 1][2] if j else None, group[j + 1][2] if j + 1 < len(group) else None)


def test_certificates_of_odd_documents(spark):
    atoms = [("d", None, "x", 1, 1, "h2"), ("d", "b", " ", 2, 1, None), ("d", "b", "y", None, None, "h1"), ("e", "a", "t", 1, 2, "h"), ("f", "a", "", 1, 1, "h"), ("f", "b", "t", 1, 1, "g"), ("stray", "a", "t", 1, 1, "h")]
    sources = [("d", "s", 10, 10, 0, 1), ("e", None, 10, 9, 1, 1), ("f", "s", 0, 0, 0, 1), ("g", "s", 0, 0, 0, 0)]
    a = spark.createDataFrame(atoms, "document string, atom_id string, text string, start_line long, end_line long, content_hash string")
    s = spark.createDataFrame(sources, "document string, source_hash string, total_bytes long, covered_bytes long, lost_bytes long, blocks long")
    got = {r["document"]: r for r in gv.certificates(a, s, coverage=90.0, loss=0.1, lossless=True).collect()}
    codes = {k: r["codes"].split(",") for k, r in got.items()}
    assert codes["d"] == ["EMPTY_ATOM_ID", "DUPLICATE_ATOM_ID", "MISSING_SOURCE_SPAN", "INVALID_SOURCE_SPAN", "MISSING_CONTENT_HASH", "EMPTY_ATOMS"] and (got["d"]["findings"], got["d"]["blocking"]) == (6, 4)
    assert codes["e"] == ["NOT_LOSSLESS"] and codes["f"] == ["EMPTY_ATOMS"] and codes["g"] == ["LOW_COVERAGE", "NO_ATOMS"]
    assert [got[k]["level"] for k in "defg"] == ["failed", "failed", "provisional", "failed"] and got["g"]["chain_hash"] == ""
    loose = {r["document"]: r["level"] for r in gv.certificates(a, s, coverage=90.0, loss=0.1).collect()}
    assert loose["e"] == "certified"


def test_verdicts_of_reports(spark):
    say = lambda *severities: qu.report_verdict(spark.createDataFrame([(s,) for s in severities], "severity string")).first()["status"]
    assert say() == say("informational") == "pass" and say("informational", "warning") == "warn" and say("warning", "blocking") == "fail"


def test_snapshots_against_what_is_stated(spark):
    records = spark.createDataFrame([("s1", "v1", "l", "sha256:" + "0" * 64, "2026-01-01T00:00:00Z"), ("s1", "v2", "l", "sha256:" + "1" * 64, "2026-01-01T00:00:00Z"), ("s2", "v3", "l", "sha256:" + "2" * 64, "2026-01-01T00:00:00Z")], "source_id string, version_id string, locator string, content_hash string, captured_at string")
    ensure_checkpoints(spark)
    root = idt.snapshot_root(records).first()["hash"]
    stated = [(f" SHA256:{root} ", 2, 3), (root, 3, 3), (root, 2, None), (None, 2, 3), ("sha256:00", 2, 3), ("sha256:00", 9, 9)]
    got = [r["refusal"] for r in idt.verify_snapshot(records, spark.createDataFrame(stated, "root string, sources long, versions long").coalesce(1)).collect()]
    assert got == ["", "source_count", "version_count", "root_differs", "root_differs", "source_count"]
    faulty = records.unionByName(records.limit(1))
    assert {r["refusal"] for r in idt.verify_snapshot(faulty, spark.createDataFrame(stated, "root string, sources long, versions long")).collect()} == {"record_faults"}
