"""Semantic quality gate over feed units, and the export gate over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import BODY, is_blank, normalized_hash, raw_hash, word_count

from ledgerline.sources.shared import ensure_checkpoints

from .integrity import context_findings
from .lens import lens_reason
from .segments import duplicate_findings

#: Least tokens and characters by kind, and labels that are no text of their own.
MIN_TOKENS = {"paragraph": 3, "list_item": 2, "callout": 3, "table_row": 2, "default": 1}
MIN_CHARS = {"paragraph": 20, "list_item": 12, "callout": 20, "table_row": 12, "default": 4}
STOP_LABELS = ("champ", "valeur", "statut", "status", "version", "field", "value", "key", "name", "date", "id")
#: What a short fragment becomes where it is an artifact of its own.
GOVERNED = ("lexicon_atom", "identifier_atom", "normative_value_atom")


def by_kind(kind: Column, least: dict[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for k, v in least.items():
        if k != "default":
            out = out.when(kind == k, F.lit(v))
    return out.otherwise(F.lit(least["default"]))


def is_junk(text: Column) -> Column:
    """Without a letter or digit."""
    return ~text.rlike(r"[\p{L}\p{N}]")


def semantic_findings(units: DataFrame, order: list[str], min_tokens: dict = MIN_TOKENS, min_chars: dict = MIN_CHARS, stop_labels: tuple = STOP_LABELS) -> DataFrame:
    """(unit_id, code, severity) of units (unit_id, kind, text, and the order columns).

    Rules on one unit are found in one pass; only the duplicate rule shuffles, by the hash of the normalised text.
    """
    text = F.trim("text")
    label = F.regexp_replace(F.lower(text), r"[.:;,!?]+$", "")
    rules = F.array(
        F.when(word_count(F.col("text")) < by_kind(F.col("kind"), min_tokens), "FEED_UNIT_BELOW_TOKEN_MIN"),
        F.when(F.length(text) < by_kind(F.col("kind"), min_chars), "FEED_UNIT_BELOW_CHAR_MIN"),
        F.when(label.isin(*stop_labels), "FEED_STOP_LABEL"),
        F.when(is_junk(text), "FEED_JUNK_TEXT"),
    )
    ensure_checkpoints(units.sparkSession)
    # Texts are read once: codes and hash of each unit are written, and the rule across units joins what was written.
    seen = units.select("unit_id", *order, F.array_compact(rules).alias("codes"), F.unhex(normalized_hash(F.col("text"))).alias("hash")).checkpoint()
    own = seen.select("unit_id", F.explode("codes").alias("code")).withColumn("severity", F.lit("blocking"))
    dup = duplicate_findings(seen.select("unit_id", *order, "hash"), "hash", order)
    return own.unionByName(dup.select("unit_id", F.lit("FEED_DUPLICATE_NORMALIZED_TEXT").alias("code"), "severity"))


def report_status(findings: DataFrame) -> DataFrame:
    out = findings.agg(F.count_if(F.col("severity") == "blocking").alias("blocking"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count(F.lit(1)).alias("all_"))
    return out.select("blocking", "warnings", F.when(F.col("blocking") > 0, "fail").when(F.col("all_") > 0, "warn").otherwise("pass").alias("status"))


def zero_unit_findings(sources: DataFrame, units: DataFrame, fragments: DataFrame) -> DataFrame:
    """(id, code, severity): admitted and atomized ``sources(source_id, admission_status, atomization_status, exclusion_reason)`` without a reason, unit or governed fragment."""
    governed = fragments.where(F.col("disposition").isin(*GOVERNED) & ~is_blank(F.col("source_id")))
    used = units.select("source_id").distinct().unionByName(governed.select("source_id").distinct())
    open_ = sources.where((F.col("admission_status") == "admitted") & (F.col("atomization_status") == "atomized") & is_blank(F.col("exclusion_reason")))
    return open_.join(used, "source_id", "left_anti").select(F.col("source_id").alias("id"), F.lit("SOURCE_ZERO_UNIT_NO_REASON").alias("code"), F.lit("blocking").alias("severity"))


def short_fragment_findings(fragments: DataFrame) -> DataFrame:
    """(id, code, severity): ``fragments(fragment_id, disposition)`` that nobody has decided on."""
    undecided = is_blank(F.col("disposition")) | (F.col("disposition") == "requires_review")
    return fragments.where(undecided).select(F.col("fragment_id").alias("id"), F.lit("SHORT_CRITICAL_REQUIRES_REVIEW").alias("code"), F.lit("blocking").alias("severity"))


def semantic_report(units: DataFrame, order: list[str], sources: DataFrame, fragments: DataFrame) -> DataFrame:
    """(id, code, severity): the findings of all families on units, their context, their sources and short fragments; units have the columns of both rules on units, and ``source_id``."""
    own = semantic_findings(units, order).select(F.col("unit_id").alias("id"), "code", "severity")
    context = context_findings(units).select(F.col("unit_id").alias("id"), "code", "severity")
    return own.unionByName(context).unionByName(zero_unit_findings(sources, units, fragments)).unionByName(short_fragment_findings(fragments))


def report_verdict(findings: DataFrame) -> DataFrame:
    """One row: findings by severity; informational ones leave a report passing."""
    out = findings.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("blocking", "warning", "informational")))
    return out.withColumn("status", F.when(F.col("blocking") > 0, "fail").when(F.col("warning") > 0, "warn").otherwise("pass"))


def export_outcome(chunks: DataFrame) -> DataFrame:
    """Adds ``rejection``: the first required field that is missing of chunks (chunk_id, source_id, source_hash, body), else null."""
    missing = F.when(is_blank(F.col("chunk_id")), "missing_chunk_id").when(is_blank(F.col("source_id")), "missing_source_id").when(is_blank(F.col("source_hash")), "missing_source_hash").when(is_blank(F.col("body")), "empty_body")
    return chunks.withColumn("rejection", missing)


def export_records(outcome: DataFrame) -> DataFrame:
    """Accepted chunks with ``body_hash`` and ``embedding_hash``: the body behind its context prefix."""
    body = F.trim("body")
    text = F.when(F.col("context_prefix") != "", F.concat("context_prefix", F.lit(BODY), body)).otherwise(body)
    return outcome.where("rejection is null").withColumn("body_hash", raw_hash(body)).withColumn("embedding_hash", raw_hash(text)).drop("rejection")


def scoped_outcome(chunks: DataFrame, facets: dict[str, Column], has_facets: Column, lens: dict) -> DataFrame:
    """Adds ``outcome`` (record, rejected or excluded), ``code`` and ``reason``: what cannot be cited is rejected first, then a lens excludes what is outside it or bears no facets."""
    rows = export_outcome(chunks)
    rejected, outside = F.col("rejection").isNotNull(), lens_reason(facets, lens)
    code = F.when(rejected, F.col("rejection")).when(~has_facets, "lens_no_facets").when(outside.isNotNull(), "lens_excluded")
    rows = rows.withColumn("code", code).withColumn("reason", F.when(F.col("code") == "lens_excluded", outside))
    return rows.withColumn("outcome", F.when(rejected, "rejected").when(F.col("code").isNotNull(), "excluded").otherwise("record")).drop("rejection")
