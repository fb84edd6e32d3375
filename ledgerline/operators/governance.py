"""Governance joins and certification gates: claims, registers, mappings, projections, bundles, plans of change, proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.spans import with_bytes
from ledgerline.functions.globs import glob_regex
from ledgerline.functions.text import is_blank, tokens_by_words, word_count
from ledgerline.sources.shared import ensure_checkpoints

from .pieces import ranked, with_neighbours
from .sizes import left_join_spread

#: What a qualified claim states, and the least share of typed blocks and of resolved references.
CLAIM_FIELDS = ("intended_use", "owner", "risk_classification", "external_ref", "control_requirement", "implementation_ref", "verification_ref", "evidence_artifact", "release_gate")
ROLE_RATIO, REFERENCE_RATIO = 0.8, 0.9
CONTENT_HASH = r"^sha256:[0-9a-f]{64}$"


def said(c: str) -> Column:
    return ~is_blank(F.col(c))


def govern_claims(claims: DataFrame, evidence: DataFrame, fields: tuple[str, ...] = CLAIM_FIELDS) -> DataFrame:
    """(path, line, qualified, missing): claims (path, line) with the evidence fields that are not stated for them."""
    out = claims.join(evidence, ["path", "line"], "left")
    missing = F.array_compact(F.array(*(F.when(~said(f), f) for f in fields)))
    return out.select("path", "line", (F.size(missing) == 0).alias("qualified"), F.array_join(missing, ",").alias("missing"))


def alignment_findings(cited: DataFrame, register: DataFrame, today: str, days: int = 365) -> DataFrame:
    """(ref, file, line, code, severity) of cited (ref, file, line) against a register (ref, evidence_status, checked_on); the first citation of a reference in a file speaks for it."""
    first = cited.withColumn("key_", F.lower(F.trim("ref"))).groupBy("key_", "file").agg(F.min_by(F.struct("ref", "line"), F.struct("line", "ref")).alias("c")).select("key_", "file", "c.*")
    known = register.select(F.lower(F.trim("ref")).alias("key_"), "evidence_status", "checked_on", F.lit(True).alias("known"))
    finding = lambda on, code, severity: F.when(on, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    governed = F.col("known").isNotNull()
    rules = F.array(
        finding(~governed, "ref_not_governed", "error"), finding(governed & ~said("evidence_status"), "ref_missing_evidence_status", "error"), finding(governed & F.col("checked_on").isNull(), "ref_missing_review_date", "warning"),
        finding(governed & (F.datediff(F.lit(today).cast("date"), F.col("checked_on").cast("date")) > days), "ref_review_stale", "warning"),
    )
    return first.join(known, "key_", "left").select("ref", "file", "line", F.explode(F.array_compact(rules)).alias("f")).select("ref", "file", "line", "f.code", "f.severity")


def mapping_refusals(mapping: DataFrame, atoms: DataFrame, fields: list[str]) -> DataFrame:
    """(atom_id, refusal): the first reason against each mapped atom (atom_id, state, content_hash, checks, fields); only approved, unchanged atoms cross."""
    own = atoms.select("atom_id", F.col("state").alias("a_state"), F.col("content_hash").alias("a_hash"), *(F.col(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("known"))
    times = mapping.groupBy("atom_id").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = mapping.join(own, "atom_id", "left").join(times, "atom_id", "left")
    drift = F.lit(False)
    for f in fields:
        drift = drift | ~F.col(f).eqNullSafe(F.col(f"a_{f}"))
    reason = (
        F.when(F.col("times").isNotNull(), "mapped_twice").when(F.col("state") != "approved", "unapproved").when(F.col("known").isNull(), "atom_absent").when(F.col("a_state") != "approved", "unapproved_in_set")
        .when(~F.col("content_hash").rlike(CONTENT_HASH) | (F.col("content_hash") != F.col("a_hash")), "hash_differs").when(drift, "field_drift").when(F.col("checks") == 0, "no_check")
    )
    return rows.select("atom_id", reason.alias("refusal")).where("refusal is not null")


def project_governed(atoms: DataFrame, tags: DataFrame, least: int = 10, most: int = 512, require_approved: bool = False) -> DataFrame:
    """Atoms (atom_id, text, content_hash, domain) with their governance (review_state, owner, version, confidentiality), defaults where none is given, and the safety gates that fail."""
    rows = atoms.join(tags, "atom_id", "left")
    given = lambda c, default: F.when(said(c), F.col(c)).otherwise(default)
    state, tokens = given("review_state", "draft"), tokens_by_words(F.col("text"))
    gates = F.array_compact(F.array(
        F.when(is_blank(F.col("content_hash")), "hash"), F.when(F.lit(require_approved) & (state != "approved"), "approval"), F.when(F.col("confidentiality").isin("confidential", "secret"), "confidentiality"),
        F.when(tokens < least, "too_short"), F.when(tokens > most, "too_long"),
    ))
    return rows.select("atom_id", F.concat(F.lit("rag-"), "atom_id").alias("chunk_id"), state.alias("review_state"), given("owner", "unassigned").alias("owner"), given("version", "0.0.0").alias("version"), given("domain", "unknown").alias("domain"), tokens.alias("tokens"), (F.size(gates) == 0).alias("embeddable"), F.array_join(gates, ",").alias("gates"))


def certification(atoms: DataFrame, sources: DataFrame, coverage: float = 95.0, loss: float = 0.05) -> DataFrame:
    """(document, level, findings) per document of atoms (document, atom_id, text, start_byte, end_byte) and sources (document, total_bytes, covered_bytes): certified without findings, provisional without blocking ones."""
    ids = atoms.groupBy("document", "atom_id").agg(F.count(F.lit(1)).alias("times"), F.count_if(is_blank(F.col("text"))).alias("empty"), F.count_if(~(F.col("end_byte") > F.col("start_byte"))).alias("spanless"))
    per = ids.groupBy("document").agg(F.sum("times").alias("atoms"), F.count_if(F.col("times") > 1).alias("twice"), F.sum("empty").alias("empty"), F.sum("spanless").alias("spanless"))
    rows = sources.join(per, "document", "left").na.fill(0, ["atoms", "twice", "empty", "spanless"])
    pct = F.when(F.col("total_bytes") > 0, F.col("covered_bytes") / F.col("total_bytes") * 100).when(F.col("atoms") > 0, 100.0).otherwise(0.0)
    lost = F.when(F.col("total_bytes") > 0, 1 - F.col("covered_bytes") / F.col("total_bytes")).otherwise(0.0)
    blocking = F.array_compact(F.array(F.when(pct < coverage, "LOW_COVERAGE"), F.when(lost > loss, "HIGH_LOSS"), F.when(F.col("twice") > 0, "DUPLICATE_ID"), F.when(F.col("atoms") == 0, "NO_ATOMS")))
    other = F.array_compact(F.array(F.when(F.col("spanless") > 0, "NO_SPAN"), F.when(F.col("empty") > 0, "EMPTY_ATOM")))
    level = F.when(F.size(blocking) > 0, "failed").when(F.size(other) > 0, "provisional").otherwise("certified")
    return rows.select("document", level.alias("level"), F.array_join(F.concat(blocking, other), ",").alias("findings"))


def certificates(atoms: DataFrame, sources: DataFrame, coverage: float = 95.0, loss: float = 0.05, lossless: bool = False) -> DataFrame:
    """(document, level, atoms, findings, blocking, codes, chain_hash): a certificate for each of ``sources(document, source_hash, total_bytes, covered_bytes, lost_bytes, blocks)``.

    ``atoms(document, atom_id, text, start_line, end_line, content_hash)``. The chain hash is that of the source's hash and then the atoms' in the order of
    their ids (of equal ids, by hash); atoms without a hash break it and are left out. It is read in one piece, so a document's hashes are in one task, its texts are not.
    An id that occurs twice is one finding, other faults of atoms one each, empty texts one in all. Nulls are empty; a document without atoms has no chain hash.
    """
    at = lambda c: F.coalesce(c, F.lit(0))
    hashed = F.coalesce("content_hash", F.lit(""))
    per = atoms.select("document", F.coalesce("atom_id", F.lit("")).alias("id"), is_blank(F.col("text")).alias("empty"), at("start_line").alias("a"), at("end_line").alias("z"), F.when(hashed != "", hashed).alias("hash"))
    per = per.groupBy("document", "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("empty").alias("empty"), F.count_if((F.col("a") == 0) & (F.col("z") == 0)).alias("spanless"), F.count_if((F.col("a") > F.col("z")) & (F.col("z") > 0)).alias("inverted"),
        F.count_if(F.col("hash").isNull()).alias("unhashed"), F.array_sort(F.collect_list("hash")).alias("hashes"),
    )
    links = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("id", "hashes"))), lambda x: x["hashes"])), "")
    per = per.groupBy("document").agg(
        *(F.sum(c).alias(c) for c in ("n", "empty", "spanless", "inverted", "unhashed")), F.sum(F.when(F.col("id") == "", F.col("n")).otherwise(0)).alias("nameless"), F.count_if((F.col("id") != "") & (F.col("n") > 1)).alias("twice"), links.alias("links")
    )
    rows = sources.join(per, "document", "left").na.fill(0, ["n", "empty", "spanless", "inverted", "unhashed", "nameless", "twice"])
    whole = F.col("total_bytes") > 0
    pct = F.when(whole, F.col("covered_bytes") / F.col("total_bytes") * 100).when(F.col("blocks") > 0, 100.0).otherwise(0.0)
    ratio, one = F.when(whole, F.col("lost_bytes") / F.col("total_bytes")).otherwise(0.0), lambda on: on.cast("long")
    mostly = F.col("empty") * 2 > F.col("n")
    rules = [
        ("LOW_COVERAGE", True, one(pct < coverage)), ("HIGH_LOSS", True, one(ratio > loss)), ("NOT_LOSSLESS", True, one(F.lit(lossless) & (F.col("lost_bytes") > 0))), ("EMPTY_ATOM_ID", True, F.col("nameless")), ("DUPLICATE_ATOM_ID", True, F.col("twice")),
        ("MISSING_SOURCE_SPAN", False, F.col("spanless")), ("INVALID_SOURCE_SPAN", True, F.col("inverted")), ("MISSING_CONTENT_HASH", True, F.col("unhashed")), ("EXCESSIVE_EMPTY_ATOMS", True, one(mostly)), ("EMPTY_ATOMS", False, one(~mostly & (F.col("empty") > 0))),
        ("NO_ATOMS", True, one(F.col("n") == 0)),
    ]
    found = F.filter(F.array(*(F.struct(F.lit(code).alias("code"), F.lit(blocks).alias("blocks"), n.alias("n")) for code, blocks, n in rules)), lambda x: x["n"] > 0)
    count = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    out = rows.withColumn("found", found).withColumn("blocking", count(F.filter("found", lambda x: x["blocks"])))
    level = F.when(F.col("blocking") > 0, "failed").when(F.size("found") > 0, "provisional").otherwise("certified")
    chain = F.when(F.col("n") > 0, F.concat(F.lit("sha256:"), F.sha2(F.concat(F.coalesce("source_hash", F.lit("")), "links"), 256))).otherwise("")
    return out.select("document", level.alias("level"), F.col("n").alias("atoms"), count(F.col("found")).alias("findings"), "blocking", F.array_join(F.transform("found", lambda x: x["code"]), ",").alias("codes"), chain.alias("chain_hash"))


def checks_gate(checks: DataFrame) -> DataFrame:
    """One row of checks (category, status, score, blocking): the mean score, and whether no blocking check failed."""
    return checks.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("score"), (~F.coalesce(F.bool_or(F.col("blocking") & (F.col("status") == "failed")), F.lit(False))).alias("passes"), F.count_if(F.col("status") == "failed").alias("failed"))


def level_gate(requirements: DataFrame, evidence: DataFrame, target: int) -> DataFrame:
    """One row: requirements (id, min_level, critical) up to the target level against evidence (id, satisfied); what lacks evidence is not satisfied."""
    met = F.coalesce("satisfied", F.lit(False))
    out = requirements.where(F.col("min_level") <= target).join(evidence, "id", "left").agg(F.count_if(met).alias("passed"), F.count_if(~met).alias("failed"), F.count_if(~met & F.col("critical")).alias("critical_failed"))
    return out.withColumn("verdict", F.when(F.col("critical_failed") > 0, "fail").when(F.col("failed") > 0, "pass_with_warnings").otherwise("pass"))


def ratio_proof(rows: DataFrame, key: str, ok: str, least: float) -> DataFrame:
    """(key, ratio, proved): the share of rows for which ``ok`` holds, against the least one."""
    return rows.groupBy(key).agg(F.avg(F.col(ok).cast("double")).alias("ratio")).withColumn("proved", F.col("ratio") >= least)


def definition_use(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(id, references, defined): every id that is defined or cited; orphans are cited only, the unreferenced are defined only."""
    d = definitions.select("id", F.lit(True).alias("defined")).distinct()
    r = references.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("references"))
    return d.join(r, "id", "full_outer").select("id", F.coalesce("references", F.lit(0)).alias("references"), F.coalesce("defined", F.lit(False)).alias("defined"))


def scoped_plan(paths: DataFrame, workflows: list[tuple[str, list[str], str]]) -> DataFrame:
    """(workflow, status, matched) of changed ``paths(path)`` under workflows (id, source globs, output folder); paths inside any output are generated and start nothing."""
    clean = paths.select(F.regexp_replace(F.trim("path"), r"^\./|/+$", "").alias("path")).where("path <> ''").distinct()
    generated = F.lit(False)
    for _, _, out in workflows:
        if out:
            generated = generated | (F.col("path") == out) | F.col("path").startswith(f"{out}/")
    hit = lambda globs: F.lit(False) if not globs else F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    live = clean.where(~generated)
    counts = live.agg(*(F.count_if(hit(globs)).alias(f"c{k}") for k, (_, globs, _) in enumerate(workflows)))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("workflow"), F.col(f"c{k}").alias("matched")) for k, (name, _, _) in enumerate(workflows)))).alias("w"))
    return rows.select("w.workflow", F.when(F.col("w.matched") > 0, "impacted").otherwise("skipped").alias("status"), "w.matched")


def compose_chunks(units: DataFrame, least_tokens: int, least_chars: int, stop_labels: tuple[str, ...], separator: str = "\n\n") -> DataFrame:
    """(unit_id, strategy, body_chars, chunk_hash, rejection) of units (unit_id, source_segment_id, text, heading, columns, row_values, key_path): body by strategy, judged before its heading is put in front."""
    linked = units.where(said("source_segment_id"))
    strategy = F.when(F.size("row_values") > 0, "table_row").when(said("key_path"), "yaml_scalar").otherwise("single_atom")
    row = F.array_join(F.transform(F.arrays_zip(F.col("columns").alias("c"), F.col("row_values").alias("v")), lambda z: F.concat_ws(": ", z["c"], z["v"])), "; ")
    body = F.trim(F.when(F.size("row_values") > 0, row).when(said("key_path"), F.concat_ws(": ", "key_path", "text")).otherwise(F.col("text")))
    out = linked.select("unit_id", strategy.alias("strategy"), body.alias("body"), "heading")
    rejection = F.when(F.lower("body").isin(*stop_labels), "RAG_CHUNK_STOP_LABEL").when(word_count(F.col("body")) < least_tokens, "RAG_CHUNK_BELOW_TOKEN_MIN").when(F.length("body") < least_chars, "RAG_CHUNK_BELOW_CHAR_MIN")
    text = F.when(said("heading"), F.concat_ws(separator, F.trim("heading"), "body")).otherwise(F.col("body"))
    return out.select("unit_id", "strategy", F.length("body").cast("long").alias("body_chars"), F.sha2(text, 256).alias("chunk_hash"), rejection.alias("rejection"))


def child_lists(segments: DataFrame) -> DataFrame:
    """(segment_id, position, child_id): children of each segment by start byte, then id, as rows."""
    kids = ranked(segments.where(said("parent_id")).select("parent_id", "start_byte", "segment_id"), "parent_id", ["start_byte", "segment_id"], "position")
    kids = kids.select("parent_id", F.col("segment_id").alias("child_id"), F.col("position").cast("int").alias("position"))
    return kids.join(segments.select(F.col("segment_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("parent_id").alias("segment_id"), "position", "child_id")


def crossref_faults(edges: DataFrame, atoms: DataFrame) -> DataFrame:
    """(source, target, fault) of edges (source, target, start_byte, end_byte, locator) whose ends are unknown or whose bytes in the source's text are not the locator; a span outside the text holds nothing."""
    dst = atoms.select(F.col("atom_id").alias("target"), F.lit(True).alias("there"))
    ensure_checkpoints(edges.sparkSession)
    known = left_join_spread(edges, dst, "target")
    rows = with_bytes(known, atoms.select(F.col("atom_id").alias("source"), F.col("text").alias("whole_")), "source", "whole_")
    fault = F.when(F.col("size_").isNull(), "unknown_source").when(F.col("there").isNull(), "unknown_target").when(F.coalesce("raw_", F.lit("")) != F.col("locator"), "bytes_differ")
    return rows.select("source", "target", fault.alias("fault")).where("fault is not null")


def bundle_findings(nodes: DataFrame, metadata: DataFrame) -> DataFrame:
    """(id, code): node ids used twice, malformed hashes, metadata of unknown nodes."""
    twice = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node_id").alias("id"), F.lit("duplicate_node_id").alias("code"))
    bad = nodes.where(~F.coalesce("content_hash", F.lit("")).rlike(CONTENT_HASH)).select(F.col("node_id").alias("id"), F.lit("bad_content_hash").alias("code"))
    lost = metadata.join(nodes.select("node_id"), "node_id", "left_anti").select(F.col("node_id").alias("id"), F.lit("unknown_node").alias("code"))
    return twice.unionByName(bad).unionByName(lost)


def file_differences(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code) of registered (path, sha256) against files (path, sha256): missing, changed, or not registered."""
    a, b = entries.select("path", F.col("sha256").alias("want")), files.select("path", F.col("sha256").alias("have"))
    code = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unregistered").when(F.col("want") != F.col("have"), "changed")
    return a.join(b, "path", "full_outer").select("path", code.alias("code")).where("code is not null")


def shared_terms(terms: DataFrame) -> DataFrame:
    """(term, axes): terms (axis, term) that stand on more than one axis."""
    return terms.select(F.lower(F.trim("term")).alias("term"), "axis").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("axes")).where("axes > 1")


def neighbours(blocks: DataFrame) -> DataFrame:
    """Adds the roles of the previous and the next sibling of blocks (parent, position, role)."""
    return with_neighbours(blocks, "parent", ["position"], "role", "previous_role", "next_role")


def typed_counts(blocks: DataFrame, key: str, kinds: tuple[str, ...]) -> DataFrame:
    """(key, a count of each kind)."""
    return blocks.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def references_in(text: Column, pattern: str) -> Column:
    """Matches of a pattern in order, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def review_verdicts(approvals: DataFrame, policy: dict[str, int]) -> DataFrame:
    """(item, kind, approvals, open): items (item, kind, reviewer, decision) against the approvals by different reviewers that their kind needs; one rejection keeps an item open."""
    need = F.create_map(*(F.lit(x) for kv in policy.items() for x in kv))[F.col("kind")]
    out = approvals.groupBy("item", "kind").agg(F.count_distinct(F.when(F.col("decision") == "approved", F.col("reviewer"))).alias("approvals"), F.count_if(F.col("decision") == "rejected").alias("rejections"))
    return out.select("item", "kind", "approvals", ((F.col("rejections") > 0) | (F.col("approvals") < F.coalesce(need, F.lit(1)))).alias("open"))
