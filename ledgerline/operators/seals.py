"""Sealed snapshots: envelopes over records, verified with every ground of refusal, roots updated from changed leaves, and import into a source manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank

from .identity import CAPTURED, leaf_hash, record_findings, snapshot_root
from .sizes import broadcast_if_small

#: Fixed values.
UNSAFE = "_./: "


def counted(records: DataFrame) -> DataFrame:
    """One row: sources, versions, faults and the recomputed root of ``records``; the root is null where there is none. Needs a checkpoint folder."""
    sizes = records.agg(F.countDistinct("source_id").cast("long").alias("sources"), F.count(F.lit(1)).alias("versions"))
    faults = record_findings(records).agg(F.count(F.lit(1)).alias("faults"))
    root = snapshot_root(records).agg(F.max("hash").alias("root"))  # one row, or none
    return sizes.crossJoin(faults).crossJoin(root)


def seal(records: DataFrame, snapshot_id: str, producer: str, generated_at: str, form: str) -> DataFrame:
    """One row: the envelope that a producer ships, or only its ``refusal``: no records, faulty ones, or a date that is none."""
    dated = F.lit(generated_at).rlike(CAPTURED)
    refusal = F.when(F.col("versions") == 0, "empty").when(F.col("faults") > 0, "record_faults").when(~dated, "no_generated_at")
    ok = refusal.isNull()
    said = {"format": form, "snapshot_id": snapshot_id, "generated_at": generated_at, "producer": producer}
    return counted(records).select(
        *(F.when(ok, F.lit(v)).alias(k) for k, v in said.items()), F.when(ok, F.lit(True)).alias("immutable"), F.when(ok, F.col("sources")).alias("source_count"), F.when(ok, F.col("versions")).alias("version_count"),
        F.when(ok, F.concat(F.lit("sha256:"), "root")).alias("content_hash_root"), F.coalesce(refusal, F.lit("")).alias("refusal"),
    )


def verdicts(records: DataFrame, envelopes: DataFrame, form: str) -> DataFrame:
    """Each of a few ``envelopes`` (columns of ``seal``) beside what ``records`` hold: (snapshot_id, sources, versions, faults, refusal), refusal empty if it is accepted, else its first ground.

    What is stated comes from the envelopes' own columns and what is found from the records, so no name can bind to the wrong side.
    """
    e = lambda c: F.col(f"e.{c}")
    stated = F.regexp_replace(F.lower(F.trim(F.coalesce(e("content_hash_root"), F.lit("")))), "^sha256:", "")
    refusal = (
        F.when(~e("format").eqNullSafe(form), "bad_format").when(is_blank(e("snapshot_id")), "no_id").when(~F.trim(F.coalesce(e("generated_at"), F.lit(""))).rlike(CAPTURED), "no_generated_at").when(is_blank(e("producer")), "no_producer")
        .when(~F.coalesce(e("immutable"), F.lit(False)), "not_immutable").when(stated == "", "no_root").when(F.col("f.versions") == 0, "empty").when(F.col("f.faults") > 0, "record_faults")
        .when(~e("source_count").eqNullSafe(F.col("f.sources")) | ~e("version_count").eqNullSafe(F.col("f.versions")), "count_mismatch").when(F.col("f.root") != stated, "root_mismatch")
    )
    both = envelopes.alias("e").crossJoin(F.broadcast(counted(records).checkpoint()).alias("f"))  # the latter is one row
    return both.select(e("snapshot_id").alias("snapshot_id"), F.col("f.sources").alias("sources"), F.col("f.versions").alias("versions"), F.col("f.faults").alias("faults"), F.coalesce(refusal, F.lit("")).alias("refusal"))


def updated_levels(levels: list[DataFrame], changed: DataFrame) -> list[DataFrame]:
    """Of Merkle ``levels`` (idx, hash), leaves first, the rows that differ once the leaves ``changed(idx, hash)`` have replaced theirs; the last is the root, if it changed.

    A level touches the pairs of changed nodes only: work is in proportion to the changes times the height, not to the snapshot. Leaves keep their places; a snapshot with records more or fewer is sealed anew.
    """
    out = [changed.select("idx", "hash").checkpoint()]
    for level in levels[:-1]:
        fresh = out[-1].select("idx", F.col("hash").alias("fresh"))
        pairs = broadcast_if_small(out[-1].select(F.floor(F.col("idx") / 2).cast("long").alias("up")).distinct())
        near = level.withColumn("up", F.floor(F.col("idx") / 2).cast("long")).join(pairs, "up", "left_semi").join(broadcast_if_small(fresh), "idx", "left")
        both = near.select("up", "idx", F.coalesce("fresh", "hash").alias("hash")).groupBy("up").agg(F.min_by("hash", "idx").alias("a"), F.max_by("hash", "idx").alias("b"))
        out.append(both.select(F.col("up").alias("idx"), F.sha2(F.concat_ws("\n", "a", "b"), 256).alias("hash")).checkpoint())
    return out


def leaves_of(records: DataFrame) -> DataFrame:
    return records.select("source_id", "version_id", leaf_hash().alias("hash"))


def imported(records: DataFrame, snapshot_id: str, domain: str, owner: str) -> DataFrame:
    """Manifest rows of verified ``records(source_id, version_id, locator, export_path, source_type, content_hash, captured_at, web, web_refusal)``; nothing is dropped.

    ``web`` says that a record is a web capture, ``web_refusal`` why its provenance can't be admitted (null: it can); such a row is excluded with the reason.
    """
    refused = F.col("web") & F.col("web_refusal").isNotNull()
    kind = F.when(~is_blank(F.col("source_type")), F.col("source_type")).when(F.col("web"), "html").otherwise("markdown")
    return records.select(
        F.upper(F.translate(F.concat_ws("-", "source_id", "version_id"), UNSAFE, "-" * len(UNSAFE))).alias("id"), F.when(~is_blank(F.col("export_path")), F.col("export_path")).otherwise(F.col("locator")).alias("path"), kind.alias("type"),
        F.lit(domain).alias("domain"), F.lit(owner).alias("owner"), F.lit("primary").alias("priority"), F.lit("active").alias("status"), F.lower("content_hash").alias("hash"),
        F.concat(F.lit(f"snapshot={snapshot_id} version_id="), "version_id", F.lit(" captured_at="), F.coalesce("captured_at", F.lit(""))).alias("notes"),
        F.when(refused, "excluded").otherwise("admitted").alias("admission_status"), F.when(refused, "").otherwise("not_atomized").alias("atomization_status"),
        F.when(refused, F.concat(F.lit("excluded_by_policy: "), "web_refusal")).otherwise(f"not_atomized: imported from snapshot {snapshot_id}, awaiting the pipeline").alias("exclusion_reason"),
        F.when(refused, "reference").otherwise("canonical").alias("source_role"), F.lit("supported").alias("format_support"),
    )
