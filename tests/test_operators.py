"""Operators on small rows with known results: empty input, ties, accents, tampering, repartitioned input."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import globs
from ledgerline.functions import text as tx
from ledgerline.operators import answers, graphs, headings, lens, segments, snapshots, temporal
from ledgerline.sources.files import read_records, scan_folder
from ledgerline.sources.markdown import blocks, markdown_segments
from ledgerline.sources.shared import ensure_checkpoints
from ledgerline.sources.structured import leaves
from ledgerline.streaming import incremental


def test_globs():
    import re

    for pattern, yes, no in [("dir/**", ["dir/a", "dir/a/b", "dir"], ["dirx/a", "a/dir/b"]), ("**/x.md", ["x.md", "a/x.md", "a/b/x.md"], ["ax.md", "a/x.mdx"]), ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["a/bz", "b/z"]), ("*.md", ["a.md"], ["a/b.md", "a.mdx"]), ("a?c", ["abc"], ["a/c", "ac"])]:
        assert all(re.match(globs.glob_regex(pattern), p) for p in yes), pattern
        assert not any(re.match(globs.glob_regex(pattern), p) for p in no), pattern


def test_text_functions(spark):
    df = spark.createDataFrame([("  a \t b  \n\n",), ("été\n x",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(tx.normalized_text(F.col("t"))).collect()]
    assert got == [" a b", "été\n x", "", None]
    one = df.where("t like 'été%'").select(tx.content_tokens(F.lit("The Étape is NOT done")).alias("a"), tx.sentences(F.lit("One. Two!! ? three")).alias("b"), tx.slug(F.lit("Été: A b")).alias("c"), tx.fold_latin(F.lit("Été")).alias("d"), tx.plain_markdown(F.lit("![x](y) [a](b) `c` **d**")).alias("e"), tx.tokens_by_chars(F.lit(6)).alias("f")).first()
    assert tuple(one) == (["tape", "done"], ["One", "Two", "three"], "t-a-b", "ete", "x a c d", 2)


def test_greedy_window(spark):
    assert spark.range(1).select(tx.greedy_window(F.array(*(F.lit(n).cast("long") for n in (5, 8, 3, 2, 1))), 10)).first()[0] == [0, 2, 3]


def test_context_prefix(spark):
    n = F.lit(None).cast("string")
    got = spark.range(1).select(tx.context_prefix(F.lit(" s "), n, F.lit("d"), F.array(F.lit("A"), F.lit(" "), F.lit("B")), F.lit("t1"), F.lit(2), F.array(F.lit("x"), F.lit("y")), F.lit("k.v")), tx.context_prefix(n, n, n, F.lit(None).cast("array<string>"), n, F.lit(0), F.lit(None).cast("array<string>"), n)).first()
    assert tuple(got) == ("s · d · A › B · table t1 row 2 · columns x, y · yaml k.v", "")


def test_line_ledger_slices_bytes(spark):
    text = "été\n\nx y\n"
    rows = segments.line_ledger(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("line_no").collect()
    raw = text.encode()
    assert [(r["line_no"], raw[r["start_byte"] : r["end_byte"]].decode()) for r in rows] == [(0, "été"), (1, ""), (2, "x y"), (3, "")]


def test_gaps_and_duplicates(spark):
    s = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 7, 9), ("k", 9, 10), ("k", 12, 13)], "k string, a long, b long")
    want = {(5, 7), (10, 12)}
    for parts in (1, 5):
        assert {(r["gap_start"], r["gap_end"]) for r in segments.span_gaps(s.repartition(parts), "k", "a", "b").collect()} == want
    d = segments.duplicate_findings(spark.createDataFrame([("h", 1), ("h", 2), ("h", 3), ("g", 1), ("g", 5), ("f", 9)], "hash string, n int"), "hash", ["n"])
    assert {(r["hash"], r["n"], r["severity"]) for r in d.collect()} == {("h", 2, "blocking"), ("h", 3, "blocking"), ("g", 5, "warning")}


def test_headings(spark):
    rows = [(1, 1, "A"), (2, 2, "B"), (3, None, "t"), (4, 4, "D"), (5, 1, "C"), (6, None, "u"), (7, 3, "E")]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, ord long, level int, title string")
    paths = {r["ord"]: r["path"] for r in headings.heading_paths(df).collect()}
    assert paths[3] == ["A", "B"] and paths[4] == ["A", "B", "D"] and paths[6] == ["C"] and paths[7] == ["C", "E"]
    toc = {r["ord"]: (r["number"], r["children"]) for r in headings.numbered_toc(df.where("level is not null")).collect()}
    assert toc == {1: ("1", 1), 2: ("1.1", 1), 4: ("1.1.1", 0), 5: ("2", 1), 7: ("2.1", 0)}
    assert [r["ord"] for r in headings.depth_jumps(df.where("level is not null")).collect()] == [4, 7]
    moved = headings.reordered(spark.createDataFrame([("d", 1, 2), ("d", 2, None), ("d", 3, 1)], "doc string, position int, matched int"))
    assert [r["position"] for r in moved.collect()] == [3]


def test_markdown_golden():
    text = "# T\n\npara\nmore\n\n- a\n  cont\n- b\n| x | y |\n|---|---|\n```py\n# no\n```\n> q\n---\n<div>\nétude"
    got = [(k, n, "".join(x)) for k, n, x, _ in blocks(text)]
    assert [k for k, *_ in got] == ["heading", "blank", "paragraph", "blank", "list", "table", "code", "quote", "rule", "html", "paragraph"]
    assert "".join(x for *_, x in got) == text
    assert list(blocks("")) == [] and [k for k, *_ in blocks("```\nopen")] == ["code"]


def test_markdown_spans(spark):
    text = "é\n\n## b\nc"
    rows = markdown_segments(spark.createDataFrame([("s", text), ("n", None)], "source string, text string")).orderBy("seq").collect()
    raw = text.encode()
    assert [(r["kind"], raw[r["start_byte"] : r["end_byte"]].decode()) for r in rows] == [("paragraph", "é\n"), ("blank", "\n"), ("heading", "## b\n"), ("paragraph", "c")]
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["text_hash"] for r in rows)


def test_json_leaves():
    text = ' {"a": [1, {"b": "x\\u00e9"}, []], "c": {}, "d": null, "e": -1.5e3, "f": true} '
    got = leaves(text)
    assert [(p, k, v) for p, k, v, *_ in got] == [("a[0]", "number", "1"), ("a[1].b", "string", "xé"), ("d", "null", None), ("e", "number", "-1.5e3"), ("f", "boolean", "true")]
    assert all(json.loads(text[a:z]) == json.loads(json.dumps(v) if k == "string" else v or "null") for _, k, v, a, z in got)
    for bad in ("", "{", '{"a" 1}', "[1,]", "1 2", "tru", '{"a": 1,}'):
        with pytest.raises(ValueError):
            leaves(bad)
    assert len(leaves("[" * 5000 + "1" + "]" * 5000)) == 1


@pytest.mark.parametrize("n", range(1, 10))
def test_merkle(spark, n):
    ensure_checkpoints(spark)
    leaf = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = leaf
    while len(level) > 1:
        level = [hashlib.sha256(f"{level[i]}\n{level[min(i + 1, len(level) - 1)]}".encode()).hexdigest() for i in range(0, len(level), 2)]
    levels = graphs.merkle_levels(spark.createDataFrame(list(enumerate(leaf)), "idx long, hash string"))
    assert levels[-1].first()["hash"] == level[0]
    proofs = graphs.merkle_proofs(levels).withColumn("root", graphs.fold_proof(F.col("leaf"), F.col("path")))
    assert {r["root"] for r in proofs.collect()} == {level[0]} and proofs.count() == n
    tampered = graphs.merkle_proofs(levels).withColumn("root", graphs.fold_proof(F.sha2(F.col("leaf"), 256), F.col("path")))
    assert level[0] not in {r["root"] for r in tampered.collect()}


def test_graphs(spark):
    ensure_checkpoints(spark)
    nodes = spark.createDataFrame([(x,) for x in "abcdexy"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("d", "zz")], "source string, target string")
    assert [r["node"] for r in graphs.orphans(nodes, edges).collect()] == ["e"]
    assert [r["target"] for r in graphs.broken_references(edges, nodes).collect()] == ["zz"]
    assert {r["node"]: r["level"] for r in graphs.topological_levels(nodes, edges).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 0, "x": None, "y": None}
    tree = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "lost"), ("p", "q"), ("q", "p")], "node string, parent string")
    assert {r["node"]: r["chain"] for r in graphs.parent_chains(tree).collect()} == {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["lost"], "p": ["q"], "q": ["p"]}
    assert {r["node"]: r["chain"] for r in graphs.parent_chains(tree, keep_unknown=False).collect()}["d"] == []


def test_lens_corners(spark):
    f = {"nature": F.col("nature"), "activity": F.col("activity")}
    df = spark.createDataFrame([("rule", ["a"]), (None, None), ("other", [])], "nature string, activity array<string>")
    assert [r[0] for r in df.select(lens.lens_reason(f, {"exclude": {"any_of": [{}]}})).collect()] == [None] * 3
    assert [r[0] for r in df.select(lens.lens_reason(f, {"include": {"all_of": [{"nature": ["rule"], "activity": ["a", "b"]}]}})).collect()] == [None, "not_selected_by_lens", "not_selected_by_lens"]
    assert [r[0] for r in df.select(lens.facet_errors(f)).collect()] == [None, None, "nature"]


def test_answer_corners(spark):
    schema = "answer_id string, answer string, citation_status string, refusal_status string, policy_outcome string, confidence double, faithfulness_score double, spans array<struct<source_id:string,source_hash:string,span:string,chunk_id:string,text:string>>, chunks array<struct<source_id:string,source_hash:string,span:string,chunk_id:string,text:string>>"
    s, t = ("s", "h", "1", "c1", "the retention period is seven years"), ("s", "h", "1", "c1", "retention period: seven years")
    rows = [("refuse", "", "", "refused", "acceptable_refusal", 1.0, None, [], []), ("cite", "Retention period seven years.", "source_backed", "", "acceptable", 1.0, None, [s], [t]), ("invented", "Penguins govern retention quarterly.", "source_backed", "", "acceptable", 1.0, 1.0, [s], [t]), ("nothing", "", "", "", "", 0.5, None, [], []), ("uncited", "Seven years.", "", "", "acceptable", 1.0, None, [], [t])]
    got = {r["answer_id"]: r for r in answers.evaluate(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k]["decision"] for k in ("refuse", "cite", "invented", "nothing", "uncited")] == ["abstain", "cite", "abstain", "abstain", "abstain"]
    assert got["cite"]["trust_tier"] == "certified" and got["invented"]["faithfulness"] == 0.0
    assert (got["refuse"]["recall"], got["nothing"]["precision"], got["uncited"]["recall"], got["uncited"]["precision"]) == (1.0, 1.0, 0.0, 0.0)
    assert "ACCEPTABLE_WITHOUT_CITATION_OR_REFUSAL" in got["uncited"]["findings"]
    empty = answers.eval_summary(answers.evaluate(spark.createDataFrame([], schema)), {"recall": 0.9}).first()
    assert empty["status"] == "fail"


def test_as_of_bounds(spark):
    d = lambda x: f"2024-01-{x:02d}"
    atoms = spark.createDataFrame([("w", "a", d(1), d(5)), ("w", "b", d(5), None), ("w", "c", d(5), None)], "work_id string, atom_id string, f string, t string").select("work_id", "atom_id", F.to_date("f").alias("effective_from"), F.to_date("t").alias("effective_to"))
    asked = spark.createDataFrame([("w", d(1)), ("w", d(5)), ("v", d(9))], "work_id string, q string").select("work_id", F.to_date("q").alias("as_of"))
    assert {(r["work_id"], str(r["as_of"]), r["atom_id"], r["status"]) for r in temporal.resolve_as_of(atoms, asked).collect()} == {("w", d(1), "a", "in_force"), ("w", d(5), "c", "in_force"), ("v", d(9), None, "not_in_force")}


def test_full_reindex_gives_every_kept_chunk_one_reason(spark):
    cols = "chunk_id string, source_id string, source_hash string, body_hash string, embedding_hash string"
    old, new = spark.createDataFrame([("a", "s", "1", "1", "1"), ("b", "s", "1", "1", "1")], cols), spark.createDataFrame([("a", "s", "1", "1", "1"), ("c", "s", "1", "1", "1")], cols)
    assert {tuple(r)[0::2] for r in snapshots.chunk_delta(old, new, "schema_changed").select("chunk_id", "action", "reason").collect()} == {("a", "schema_changed"), ("b", "removed"), ("c", "schema_changed")}
    assert {(r["chunk_id"], r["reason"]) for r in snapshots.chunk_delta(old, new).collect()} == {("b", "removed"), ("c", "added")}


def test_scan_folder(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/.git").mkdir()
    for name, data in (("a/x.md", b"hi"), ("a/b/y.pdf", b"%PDF-1"), ("a/b/z", b"\x00\x01"), ("a/.git/c.md", b"no")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: (r["class"], r["content_hash"], r["size_bytes"]) for r in scan_folder(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a/x.md": "text", "a/b/y.pdf": "pdf", "a/b/z": "binary"}
    assert got["a/x.md"][1:] == (hashlib.sha256(b"hi").hexdigest(), 2)


def test_records_fail_closed(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"source_id": "a", "size_bytes": 3}\n\n{"source_id": "b"}\n')
    (tmp_path / "bad.jsonl").write_text('{"source_id": "a"\n')
    assert sorted(r["source_id"] for r in read_records(spark, str(tmp_path / "ok.jsonl")).collect()) == ["a", "b"]
    with pytest.raises(Exception):
        read_records(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stream_of_snapshots(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    write = lambda rows: spark.createDataFrame(rows, "path string, content_hash string").coalesce(1).write.mode("append").parquet(src)
    for rows in ([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]):
        write(rows)
        stream = spark.readStream.schema("path string, content_hash string").parquet(src)
        incremental.run_available(stream, f"{state}/checkpoint", incremental.snapshot_changes(spark, state))
    last = {(r["path"], r["status"]) for r in spark.read.parquet(f"{state}/changes/1").collect()}
    assert last == {("a", "changed"), ("c", "added")}
    assert {(r["path"], r["content_hash"]) for r in spark.read.parquet(f"{state}/snapshot/1").collect()} == {("a", "2"), ("b", "1"), ("c", "1")}


def test_plans_push_down(spark):
    """A filter and the columns of a query reach the scan; the export gate doesn't shuffle."""
    from ledgerline.plans import catalog
    from tests.conftest import DATA

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(catalog.QUERIES["rag_export"](spark, DATA)) and "Exchange" not in plan(catalog.QUERIES["line_ledger"](spark, DATA))
    p = plan(catalog.QUERIES["event_windows"](spark, DATA))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p or "user_id" not in p.split("ReadSchema")[1][:120]
