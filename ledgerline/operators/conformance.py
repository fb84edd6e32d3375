"""Conformance of atoms to their sources, and the strict gate over the nodes of a document: one row a check, folded from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import SPACES, is_blank, raw_hash

from .feeds import trimmed
from .records import similarity

#: Checks of atoms, and checks of the strict gate (code, category, severity, whether it blocks).
CHECKS = ("losslessness", "span_accuracy", "hash_integrity", "id_uniqueness", "parent_validity", "depth_bounds", "ref_presence", "roundtrip")
STRICT = {
    "UNTYPED_TABLE": ("tables", "high", True), "CODE_BLOCK_NO_LANG": ("code_blocks", "medium", False), "MISSING_SPAN": ("spans", "high", True), "INVERTED_SPAN": ("spans", "critical", True), "IMAGE_NO_ALT": ("images", "medium", False),
    "EXCESSIVE_EMPTY_NODES": ("content", "high", True), "TOC_MISSING": ("toc", "high", True), "TOC_NOT_CERTIFIED": ("toc", "critical", True), "TOC_HASH_INVALID": ("toc", "critical", True), "LEXICON_UNGOVERNED": ("lexicon", "medium", False),
}
STRICT_CATEGORIES = 7


def _flag(on: Column) -> Column:
    return F.when(F.coalesce(on, F.lit(False)), 1).otherwise(0).cast("long")


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " "))


def conformance(sources: DataFrame, atoms: DataFrame, rebuilt: DataFrame | None = None, max_depth: int = 0, threshold: float = 0.8) -> DataFrame:
    """(source, check, violations, passed): ``atoms(source, atom_id, parent_id, canonical_ref, text, content_hash, depth, source_line)`` against ``sources(source, text)``.

    ``losslessness``: the atoms' trimmed bytes are at least ``threshold`` of the source's; the violation is a shortfall. ``span_accuracy``: an atom's first
    15 characters lie on its line or the next, in any case; on the last line only the line has to exist. ``depth_bounds``: no bound if ``max_depth`` is 0.
    ``roundtrip``: with ``rebuilt(source, text)``, white space aside, the texts share 0.9 of their characters. Null texts are empty; a source without atoms
    fails losslessness unless it is empty; atoms of a source that isn't there give no row.

    Atoms and the parents they name are one stream of ids, so uniqueness, parents and all rules of single atoms fold in the same two aggregations,
    and the larger of these is by (source, id): a source of any size is spread. Only the lines of sources are joined to atoms.
    """
    numbered = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = sources.select("source", F.posexplode(F.zip_with(numbered, F.slice(F.array_append(numbered, F.lit(None).cast("string")), F.lit(2), F.size(numbered)), lambda a, b: F.struct(F.lower(a).alias("here"), F.lower(b).alias("next")))).alias("n", "l"))
    lines = lines.select("source", (F.col("n") + 1).alias("source_line"), "l.here", "l.next")
    text = trimmed(F.col("text"))
    probe = F.lower(F.substring(text, 1, 15))
    off = F.col("here").isNull() | (~F.contains("here", probe) & F.col("next").isNotNull() & ~F.contains(F.coalesce("next", F.lit("")), probe))
    parent = F.coalesce("parent_id", F.lit(""))
    own = atoms.join(lines, ["source", "source_line"], "left").select(
        "source", F.col("atom_id").alias("id"), parent.alias("parent"), F.octet_length(text).cast("long").alias("bytes"), _flag(off).alias("span_accuracy"), _flag(~F.col("content_hash").eqNullSafe(F.concat(F.lit("sha256:"), raw_hash(text)))).alias("hash_integrity"),
        _flag((F.col("depth") > max_depth) & F.lit(max_depth > 0)).alias("depth_bounds"), _flag(F.coalesce("canonical_ref", F.lit("")) == "").alias("ref_presence"),
    )
    kept = ("bytes", "span_accuracy", "hash_integrity", "depth_bounds", "ref_presence")
    zero = F.lit(0).cast("long")
    stream = F.array(
        F.struct(F.col("id"), F.lit(1).cast("long").alias("atoms"), zero.alias("named"), *(F.col(c) for c in kept)),
        F.struct(F.when(F.col("parent") != "", F.col("parent")).alias("id"), zero.alias("atoms"), F.lit(1).cast("long").alias("named"), *(zero.alias(c) for c in kept)),
    )
    rows = own.select("source", "parent", F.explode(stream).alias("s")).where("s.atoms = 1 or s.id is not null")
    ids = rows.groupBy("source", F.col("s.id").alias("id")).agg(*(F.sum(f"s.{c}").alias(c) for c in ("atoms", "named", *kept)))
    per = ids.groupBy("source").agg(
        *(F.sum(c).alias(c) for c in kept), F.sum(F.greatest(F.col("atoms") - 1, zero)).alias("id_uniqueness"), F.sum(F.when(F.col("atoms") == 0, F.col("named")).otherwise(0)).cast("long").alias("parent_validity")
    )
    base = sources.select("source", F.octet_length(trimmed(F.col("text"))).cast("long").alias("size"), *([_spaced(F.col("text")).alias("spaced")] if rebuilt is not None else [])).join(per, "source", "left")
    if rebuilt is not None:
        base = base.join(rebuilt.select("source", _spaced(F.col("text")).alias("again")), "source", "left")
        base = base.withColumn("roundtrip", _flag(F.coalesce(similarity(F.col("spaced"), F.coalesce("again", F.lit(""))), F.lit(0.0)) < 0.9))
    base = base.withColumn("losslessness", _flag((F.col("size") > 0) & (F.coalesce("bytes", zero) / F.col("size") < threshold)))
    checks = [c for c in CHECKS if c != "roundtrip" or rebuilt is not None]
    found = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(c, zero).alias("violations")) for c in checks)))
    return base.select("source", found.alias("f")).select("source", "f.*", (F.col("f.violations") == 0).alias("passed"))


def conformance_verdicts(results: DataFrame) -> DataFrame:
    """(source, total_checks, passed, failed, pass)."""
    out = results.groupBy("source").agg(F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return out.withColumn("pass", F.col("failed") == 0)


def strict_findings(nodes: DataFrame, tocs: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(document, code, node_id, category, severity, blocking), whatever a strict gate finds in each document.

    ``nodes(document, node_id, kind, text, col_count, language, alt_text, start_line, end_line)``: rules of one node are found in one pass; more than half of a
    document's nodes empty is one finding, without a node. ``tocs(document, certified, stated_hash, hash)``: a document of ``nodes`` without a row has none.
    ``terms(document, status)``: terms that are neither canonical nor synonyms are ungoverned. Nulls count as empty or 0.
    """
    kind, start, end = F.col("kind"), F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0))
    body = ~kind.isin("document", "thematic_break")
    rules = {
        "UNTYPED_TABLE": (kind == "table") & (F.coalesce("col_count", F.lit("")) == ""), "CODE_BLOCK_NO_LANG": (kind == "code_block") & (F.coalesce("language", F.lit("")) == ""), "MISSING_SPAN": body & (start == 0) & (end == 0),
        "INVERTED_SPAN": body & (start > end) & (end > 0), "IMAGE_NO_ALT": (kind == "image") & is_blank(F.col("alt_text")) & is_blank(F.col("text")),
    }
    out = nodes.select("document", F.explode(F.array_compact(F.array(*(F.when(on, code) for code, on in rules.items())))).alias("code"), "node_id")
    per = nodes.groupBy("document").agg(F.count_if(body).alias("all"), F.count_if(body & is_blank(F.col("text"))).alias("empty"))
    whole = [F.when(F.col("empty") > F.col("all") * 0.5, "EXCESSIVE_EMPTY_NODES")]
    if tocs is not None:
        per = per.join(tocs.select("document", F.coalesce("certified", F.lit(False)).alias("certified"), F.col("stated_hash").eqNullSafe(F.col("hash")).alias("same")), "document", "left")
        whole += [F.when(F.col("certified").isNull(), "TOC_MISSING"), F.when(~F.col("certified"), "TOC_NOT_CERTIFIED"), F.when(~F.col("same"), "TOC_HASH_INVALID")]
    if terms is not None:
        loose = terms.where(~F.coalesce(F.col("status").isin("canonical", "synonym"), F.lit(False))).select("document").distinct().withColumn("loose", F.lit(True))
        per = per.join(loose, "document", "left")
        whole.append(F.when(F.col("loose"), "LEXICON_UNGOVERNED"))
    out = out.unionByName(per.select("document", F.explode(F.array_compact(F.array(*whole))).alias("code"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("node_id")))
    fixed = F.create_map(*(x for code, (category, severity, blocks) in STRICT.items() for x in (F.lit(code), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(blocks).alias("blocking")))))[F.col("code")]
    return out.withColumn("x_", fixed).select("document", "code", "node_id", "x_.*")


def strict_verdicts(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(document, passed, failed, blocking, pass) of each of ``documents``: categories without and with a finding, and blocking findings; one of these fails the gate."""
    per = findings.groupBy("document").agg(F.countDistinct("category").alias("failed"), F.count_if("blocking").alias("blocking"))
    rows = documents.select("document").distinct().join(per, "document", "left").select("document", F.coalesce("failed", F.lit(0)).cast("long").alias("failed"), F.coalesce("blocking", F.lit(0)).cast("long").alias("blocking"))
    return rows.select("document", (F.lit(STRICT_CATEGORIES) - F.col("failed")).cast("long").alias("passed"), "failed", "blocking", (F.col("blocking") == 0).alias("pass"))
