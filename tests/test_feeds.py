"""Feeds, ordinals, traces, conformance and the strict gate on small cases with known answers."""

import hashlib

import pytest

from ledgerline.operators import conformance as cf
from ledgerline.operators import feeds as fd
from ledgerline.sources.shared import ensure_checkpoints

UNIT = "source string, unit_id string, type string, text string, level int, parent_id string, line int"
NODE = "feed string, ord long, node_id string, parent_id string, ordinal_path string"
ATOM = "source string, atom_id string, parent_id string, canonical_ref string, text string, content_hash string, depth int, source_line int"
STRICT = "document string, node_id string, kind string, text string, col_count string, language string, alt_text string, start_line int, end_line int"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def test_profiles(spark):
    units = spark.createDataFrame([("s", "a", "heading", "  Été 1: Rules ", 1, None, 1), ("s", "b", "paragraph", "four", 1, "a", 2), ("s", "c", "list_item", "a provision", 7, "a", 3), ("s", "d", "list_item", "a provision", 6, "a", 4), ("s", "e", "table", "| long enough |", 1, "a", 5), ("s", "f", "paragraph", None, None, None, 6)], UNIT)
    got = {r["atom_id"]: (r["canonical_ref"], r["type"], r["text"], r["content_hash"]) for r in fd.portable_atoms(units, "rbok").collect()}
    assert got == {"RBOK.A": ("t-1-rules", "clause", "Été 1: Rules", f"sha256:{sha('Été 1: Rules')}"), "RBOK.D": ("d", "provision", "a provision", f"sha256:{sha('a provision')}")}
    assert {r["atom_id"]: r["type"] for r in fd.portable_atoms(units, "legal").collect()} == {"LEGAL.A": "section"}
    assert fd.portable_atoms(units.limit(0), "rbok").count() == 0


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_trace_matrices(spark, block):
    ensure_checkpoints(spark)
    rows = [("s", f"u{i:02}", "paragraph", f"text number {i}", 1, None if i % 3 == 0 else "u00", i) for i in range(11)] + [("none", "x", "table", "some table", 1, None, 1)]
    got = {r["source"]: (r["total_atoms"], r["total_source"], r["coverage"], r["matrix_hash"]) for r in fd.trace_matrices(spark.createDataFrame(rows, UNIT), "rbok", block).collect()}
    level = [sha(f"RBOK.U{i:02}|U{i:02}|{'' if i % 3 == 0 else 'u00'}") for i in range(11)]
    while True:
        level = [sha("".join(level[i : i + block])) for i in range(0, len(level), block)]
        if len(level) == 1:
            break
    assert got == {"s": (11, 11, 1.0, level[0]), "none": (0, 1, 0.0, None)}


def test_ordinals(spark):
    """Chains, stated paths, unknown and later parents, repeated ids, one family for two feeds."""
    ensure_checkpoints(spark)
    rows = [("f", 0, "a", None, None), ("f", 1, "b", "a", ""), ("f", 2, "c", "b", ""), ("f", 3, "d", "c", ""), ("f", 4, "e", "c", ""), ("f", 5, "x", "a", "7.7"), ("f", 6, "y", "x", ""), ("f", 7, "u", "nobody", ""), ("f", 8, "l", "later", ""), ("f", 9, "later", "", ""), ("f", 10, "a", "c", ""), ("f", 11, "z", "a", ""), ("f", 12, "s", "s", ""), ("g", 0, "b", "a", "")]
    got = {(r["feed"], r["ord"]): r["ordinal_path"] for r in fd.ordinal_paths(spark.createDataFrame(rows, NODE)).collect()}
    assert [got["f", i] for i in range(13)] == ["1", "1.1", "1.1.1", "1.1.1.1", "1.1.1.2", "7.7", "7.7.1", "1", "1", "2", "1.1.1.3", "1.3", "1"] and got["g", 0] == "1"
    deep = spark.createDataFrame([("f", i, f"n{i}", f"n{i - 1}" if i else None, "") for i in range(70)], NODE)
    assert {r["ord"]: r["ordinal_path"] for r in fd.ordinal_paths(deep).collect()} == {i: ".".join(["1"] * (i + 1)) for i in range(70)}
    assert fd.ordinal_paths(deep.limit(0)).count() == 0


def test_union_of_feeds(spark):
    ensure_checkpoints(spark)
    nodes = spark.createDataFrame([("f", 0, "a", "r1", "d1", "active"), ("f", 1, "b", "r2", "d2", "active"), ("g", 0, "a", "r1", "d1", "active"), ("g", 1, "c", "r2", "d3", "draft"), ("h", 0, "b", "r2", None, "repealed")], "feed string, ord long, node_id string, canonical_ref string, display_ref string, status string")
    assert {(r["kind"], r["ref"]): (r["node_id"], r["claims"], r["contested"]) for r in fd.citation_map(nodes).collect()} == {("canonical", "r1"): ("a", 2, False), ("canonical", "r2"): ("b", 3, True), ("display", "d1"): ("a", 2, False), ("display", "d2"): ("b", 1, False), ("display", "d3"): ("c", 1, False), ("display", ""): ("b", 1, False)}
    assert {r["node_id"]: (r["versions"], r["across_feeds"], r["kind"], r["winner"]) for r in fd.feed_conflicts(nodes, ["canonical_ref", "status"]).collect()} == {"a": (2, True, "identical", "g"), "b": (2, True, "conflict", "h")}
    assert {(r["node_id"], r["feed"], r["status"]) for r in fd.standing_nodes(nodes).collect()} == {("a", "g", "active"), ("b", "h", "repealed"), ("c", "g", "draft")}


def plain_conformance(text, atoms, max_depth, threshold):
    lines, ids = text.split("\n"), [a[1] for a in atoms]
    off = 0
    for a in atoms:
        probe, at = a[4].strip().lower()[:15], a[7]
        near = [x.lower() for x in lines[at - 1 : at + 1]] if 0 < at <= len(lines) else []
        off += not near or (not any(probe in x for x in near) and at < len(lines))
    size, covered = len(text.strip().encode()), sum(len(a[4].strip().encode()) for a in atoms)
    return {
        "losslessness": int(size > 0 and covered / size < threshold), "span_accuracy": off, "hash_integrity": sum(a[5] != "sha256:" + sha(a[4].strip()) for a in atoms), "id_uniqueness": len(ids) - len(set(ids)),
        "parent_validity": sum(bool(a[2]) and a[2] not in ids for a in atoms), "depth_bounds": sum(a[6] > max_depth for a in atoms) if max_depth else 0, "ref_presence": sum(not a[3] for a in atoms),
    }


def test_conformance(spark):
    """Each check has a source that fails it alone; against a plain version."""
    text = "# Title\nfirst paragraph of it\nsecond paragraph\nthe last line"
    good = [("", f"a{i}", "a0" if i else "", f"r{i}", x, "sha256:" + sha(x), 1, i + 1) for i, x in enumerate(text.split("\n"))]
    cases = {
        "fine": good, "loss": good[:1], "span": [*good[:1], (*good[1][:7], 3), *good[2:]], "beyond": [*good[:3], (*good[3][:7], 9)], "zero": [*good[:3], (*good[3][:7], 0)], "hash": [(*good[0][:5], "sha256:0", *good[0][6:]), *good[1:]],
        "twice": [*good, good[2], good[2]], "orphan": [*good[:3], (*good[3][:2], "b9", *good[3][3:])], "deep": [*good[:3], (*good[3][:6], 5, good[3][7])], "ref": [*good[:3], (*good[3][:3], "", *good[3][4:])], "last": [*good[:3], (*good[0][:7], 4), (*good[3][:1], "a3", *good[3][2:])], "empty": [], "bare": [],
    }
    texts = {name: text for name in cases} | {"empty": " \n"}
    sources = spark.createDataFrame([*texts.items(), ("null", None)], "source string, text string")
    atoms = spark.createDataFrame([(name, *a[1:]) for name, rows in cases.items() for a in rows] + [("elsewhere", *good[0][1:])], ATOM)
    got: dict = {}
    for r in cf.conformance(sources, atoms, None, 4, 0.8).collect():
        got.setdefault(r["source"], {})[r["check"]] = r["violations"]
    assert got.pop("null") == dict.fromkeys(cf.CHECKS[:7], 0)
    assert got == {name: plain_conformance(texts[name], rows, 4, 0.8) for name, rows in cases.items()}
    failing = {name: [c for c, n in checks.items() if n] for name, checks in got.items()}
    assert failing["fine"] == [] and failing["deep"] == ["depth_bounds"] and failing["loss"] == failing["bare"] == ["losslessness"] and failing["beyond"] == failing["zero"] == failing["span"] == ["span_accuracy"] and failing["twice"] == ["id_uniqueness"] and failing["orphan"] == ["parent_validity"]
    rebuilt = spark.createDataFrame([("fine", text.replace(" ", "  ")), ("loss", text[:-3]), ("span", text[:30])], "source string, text string")
    trips = {r["source"]: r["passed"] for r in cf.conformance(sources, atoms, rebuilt, 4).where("check = 'roundtrip'").collect()}
    assert trips["fine"] and trips["loss"] and not trips["span"] and not trips["bare"] and trips["empty"] and trips["null"]
    verdict = {r["source"]: (r["total_checks"], r["failed"], r["pass"]) for r in cf.conformance_verdicts(cf.conformance(sources, atoms, None, 4, 0.8)).collect()}
    assert verdict["fine"] == (7, 0, True) and verdict["ref"] == (7, 1, False)


def test_strict_gate(spark):
    node = lambda doc, n, kind, text="x", cols="2", lang="py", alt="a", at=(1, 1): (doc, n, kind, text, cols, lang, alt, *at)
    rows = [
        node("ok", "1", "document", at=(0, 0)), node("ok", "2", "table"), node("ok", "3", "code_block"), node("ok", "4", "image", text="", alt="an image"), node("ok", "5", "paragraph"),
        node("bad", "1", "table", cols=None), node("bad", "2", "code_block", lang=""), node("bad", "3", "paragraph", at=(None, None)), node("bad", "4", "paragraph", at=(5, 2)), node("bad", "5", "image", text=" ", alt=None),
        node("empty", "1", "paragraph", text=None), node("empty", "2", "paragraph", text=" \n"), node("empty", "3", "paragraph"), node("half", "1", "paragraph", text=""), node("half", "2", "paragraph"), node("warn", "1", "code_block", lang=None), node("notoc", "1", "paragraph"),
    ]
    nodes = spark.createDataFrame(rows, STRICT)
    toc = spark.createDataFrame([("ok", True, "h", "h"), ("bad", False, "h", "other"), ("empty", True, "h", "h"), ("half", True, None, "h"), ("warn", True, "h", "h")], "document string, certified boolean, stated_hash string, hash string")
    terms = spark.createDataFrame([("ok", "canonical"), ("ok", "synonym"), ("warn", "deprecated"), ("warn", None)], "document string, status string")
    found = cf.strict_findings(nodes, toc, terms)
    got: dict = {}
    for r in found.collect():
        got.setdefault(r["document"], set()).add((r["code"], r["node_id"]))
    assert got == {
        "bad": {("UNTYPED_TABLE", "1"), ("CODE_BLOCK_NO_LANG", "2"), ("MISSING_SPAN", "3"), ("INVERTED_SPAN", "4"), ("IMAGE_NO_ALT", "5"), ("TOC_NOT_CERTIFIED", None), ("TOC_HASH_INVALID", None)},
        "empty": {("EXCESSIVE_EMPTY_NODES", None)}, "half": {("TOC_HASH_INVALID", None)}, "warn": {("CODE_BLOCK_NO_LANG", "1"), ("LEXICON_UNGOVERNED", None)}, "notoc": {("TOC_MISSING", None)},
    }
    verdict = {r["document"]: (r["passed"], r["failed"], r["blocking"], r["pass"]) for r in cf.strict_verdicts(nodes, found).collect()}
    assert verdict == {"ok": (7, 0, 0, True), "bad": (2, 5, 5, False), "empty": (6, 1, 1, False), "half": (6, 1, 1, False), "warn": (5, 2, 0, True), "notoc": (6, 1, 1, False)}
