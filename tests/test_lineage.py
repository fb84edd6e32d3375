"""Outlines, tree digests, envelope chains and sealed snapshots against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import seals, trees
from ledgerline.operators.graphs import merkle_levels
from ledgerline.operators.outlines import longest_rising, outline_drifts, outline_scores
from ledgerline.sources.shared import ensure_checkpoints


@pytest.fixture(autouse=True)
def checkpoints(spark):
    ensure_checkpoints(spark)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_longest_rising_is_longest():
    r = random.Random(1)
    for _ in range(200):
        places = [r.randrange(8) for _ in range(r.randrange(12))]
        kept = [p for p, k in zip(places, longest_rising(places)) if k]
        best = [1] * len(places)
        for i in range(len(places)):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] <= places[i]), default=0)
        assert kept == sorted(kept) and len(kept) == max(best, default=0)
    assert longest_rising([0, 4, 1, 2, 3]) == [True, False, True, True, True]


def test_outline_drifts(spark):
    schema = "doc string, position int, title string, depth int"
    source = spark.createDataFrame([("a", 0, "Intro", 1), ("a", 1, "Late", 2), ("a", 2, "Scope", 1), ("a", 3, "Terms", 2), ("a", 4, "Lost", 2), ("b", 0, "Only", 1), ("c", 0, "Twice", 2), ("c", 1, "Twice", 1)], schema)
    other = spark.createDataFrame([("a", 0, " intro", 1), ("a", 1, "SCOPE", 1), ("a", 2, "Terms", 3), ("a", 3, "Late", 2), ("a", 4, "New", 1), ("c", 0, "twice", 1), ("c", 1, "twice", 2), ("d", 0, "Else", 1)], schema)
    got = {(r["doc"], r["kind"], r["position"]) for r in outline_drifts(source, other).collect()}
    assert got == {("a", "missing", 4), ("a", "depth", 3), ("a", "reordered", 2), ("a", "moved", 1), ("a", "extra", 4), ("b", "missing", 0), ("d", "extra", 0)}
    scores = {r["doc"]: (r["matched"], r["drifts"], r["score"], r["aligned"]) for r in outline_scores(source, other).collect()}
    assert scores == {"a": (3, 4, 0.6, False), "b": (0, 1, 0.0, False), "c": (2, 0, 1.0, True), "d": (0, 1, 0.0, False)}
    assert outline_drifts(source.limit(0), other.limit(0)).count() == 0


def plain_digest(node, kids, payload, block):
    items = [plain_digest(k, kids, payload, block) for k in kids.get(node, [])]
    if items:
        while True:
            items = [sha("".join(items[i : i + block])) for i in range(0, len(items), block)]
            if len(items) == 1:
                break
    return sha(f"{payload[node]}:{items[0] if items else ''}")


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_digests_of_wide_and_uneven_trees(spark, block):
    r = random.Random(block)
    parent, depth = {"n0": None}, {"n0": 0}
    for i in range(1, 120):
        up = "n0" if i < 60 else f"n{r.randrange(60)}"
        parent[f"n{i}"], depth[f"n{i}"] = up, depth[up] + r.choice([1, 2])
    kids, payload = {}, {n: f"p{n}é" for n in parent}
    for n, up in sorted(parent.items()):
        kids.setdefault(up, []).append(n)
    rows = spark.createDataFrame([(n, parent[n], depth[n], payload[n]) for n in parent], "node string, parent string, depth int, payload string")
    nodes = trees.placed(rows.where("parent is not null"), "parent", ["node"]).unionByName(rows.where("parent is null").selectExpr("*", "1L siblings", "0L place"))
    found = trees.tree_digests(nodes, block).checkpoint()
    assert {x["node"]: x["digest"] for x in found.collect()} == {n: plain_digest(n, kids, payload, block) for n in parent}
    assert trees.tampered_nodes(found, block).count() == 0
    changed = found.withColumn("payload", F.when(F.col("node") == "n70", "other").otherwise(F.col("payload"))).withColumn("digest", F.when(F.col("node") == "n5", F.lit("00")).otherwise(F.col("digest")))
    got = {x["node"]: x["path"] for x in trees.tampered_nodes(changed, block).collect()}
    assert got == {"n70": ["n0", parent["n70"], "n70"], "n5": ["n0", "n5"], "n0": ["n0"]}
    missing = found.where("node <> 'n80'")
    assert [x["node"] for x in trees.tampered_nodes(missing, block).collect()] == [parent["n80"]]


def test_envelope_chains(spark):
    h = lambda content, previous: sha(f"{content}\x00{previous or ''}")
    rows, before = [], None
    for i in range(150):
        own = h(f"c{i}", before)
        rows.append((f"e{i:03}", f"c{i}", before, own))
        before = own
    rows[40] = (*rows[40][:1], "forged", *rows[40][2:])
    rows.append(("fork", "x", rows[99][3], h("x", rows[99][3])))
    rows.append(("lost", "y", "nowhere", h("y", "nowhere")))
    rows.append(("after", "z", h("y", "nowhere"), h("z", h("y", "nowhere"))))
    rows += [("r1", "a", "h2", "h1"), ("r2", "b", "h1", "h2"), ("r3", "c", "h2", "h3")]
    rows += [("same1", "s", None, h("s", None)), ("same2", "s", None, h("s", None))]
    got = {r["envelope"]: (r["codes"], r["start"], r["length"], r["broken"]) for r in trees.chain_report(spark.createDataFrame(rows, "envelope string, content string, previous string, hash string")).collect()}
    assert got["e000"] == ("", "e000", 0, None) and got["e039"] == ("", "e000", 39, None) and got["e040"] == ("tampered", "e000", 40, "e040") and got["e149"] == ("", "e000", 149, "e040")
    assert got["fork"] == ("forked", "e000", 100, "e040") and got["e100"][0] == "forked"
    assert got["lost"] == ("missing", "lost", 0, "lost") and got["after"] == ("", "lost", 1, "lost")
    assert got["r1"] == ("tampered,forked,cycle", None, None, None) and got["r2"] == ("tampered,cycle", None, None, None) and got["r3"] == ("tampered,forked,cycle", None, None, None)
    assert got["same1"][0] == got["same2"][0] == "duplicate"


@pytest.mark.parametrize("n", [1, 2, 7, 64, 100])
def test_updated_roots(spark, n):
    leaves = spark.createDataFrame([(i, sha(str(i))) for i in range(n)], "idx long, hash string")
    for changed in ([], [0], [n - 1], list(range(0, n, 3))):
        new = spark.createDataFrame([(i, sha(f"new{i}")) for i in changed], "idx long, hash string")
        after = leaves.join(new.withColumnRenamed("hash", "fresh"), "idx", "left").selectExpr("idx", "coalesce(fresh, hash) as hash")
        levels = merkle_levels(leaves)
        found = seals.updated_levels(levels, new)
        want = merkle_levels(after)[-1].first()["hash"]
        assert [r["hash"] for r in found[-1].collect()] == ([want] if changed else [])
        assert all(level.count() <= len(changed) for level in found)


def test_seals_refuse(spark):
    schema = "source_id string, version_id string, locator string, content_hash string, captured_at string"
    good = spark.createDataFrame([("a", "1", "l", f"sha256:{sha('x')}", "2026-01-01T00:00:00Z"), ("a", "2", "l", f"sha256:{sha('y')}", "2026-01-01T00:00:00Z")], schema)
    sealed = seals.seal(good, "s", "p", "2026-01-01T00:00:00Z", "f/v1")
    row = sealed.first()
    assert (row["source_count"], row["version_count"], row["refusal"]) == (1, 2, "") and row["content_hash_root"].startswith("sha256:")
    assert seals.seal(good, "s", "p", "today", "f/v1").first()["refusal"] == "no_generated_at"
    twice = good.unionByName(good)
    assert seals.seal(twice, "s", "p", "2026-01-01T00:00:00Z", "f/v1").first()["refusal"] == "record_faults"
    empty = seals.seal(good.limit(0), "s", "p", "2026-01-01T00:00:00Z", "f/v1").first()
    assert empty["refusal"] == "empty" and empty["content_hash_root"] is None
    said = sealed.drop("refusal")
    verdict = lambda records: seals.verdicts(records, said, "f/v1").first()["refusal"]
    assert verdict(good) == "" and verdict(good.limit(0)) == "empty" and verdict(twice) == "record_faults" and verdict(good.where("version_id = '1'")) == "count_mismatch"
    assert verdict(good.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2("version_id", 256)))) == "root_mismatch"
