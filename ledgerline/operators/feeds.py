"""Portable atoms with their trace matrices, and feeds of nodes: defaults and ordinals, indexes, citations, conflicts and projections.

Everything is rows: no index, map or matrix of a feed is gathered in one document. Nodes of all feeds are one table with ``feed`` and ``ord``, their
place in the feed; where several rows claim an id or a reference, the last one, by feed and place, has it. Needs a checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank, raw_hash, slug

from .audit import NODE_DEPTH, NODE_STATUS, PRIORITIES
from .graphs import sequenced
from .trees import BLOCK, folded_children, placed

#: Profiles of atoms (domain, least bytes, deepest level, name of the atoms of each kind of unit that makes one).
PROFILES = {
    "rbok": ("legal", 5, 6, {"heading": "clause", "paragraph": "rule", "list_item": "provision"}),
    "legal": ("legal", 10, 4, {"heading": "section", "paragraph": "article"}),
    "game-rules": ("gaming", 3, 6, {"heading": "category", "paragraph": "rule", "list_item": "condition"}),
}
#: Ranks of review states, and node type and priority of each type of atom (others: article, low, 20).
REVIEW_RANK = {"rejected": 0, "draft": 1, "pending": 2, "amended": 3, "approved": 4}
NODE_TYPES = {"definition": "definition", "meta": "definition", "table": "annex", "code_block": "annex"}
PRIORITY_OF = {"rule": ("high", 80), "clause": ("high", 80), "definition": ("medium", 60), "list_item": ("low", 40)}


def _last() -> Column:
    return F.struct("feed", "ord")


def _lookup(c: Column, values: dict, otherwise) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[c], F.lit(otherwise))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def emits(profile: str) -> Column:
    """Whether a unit (type, text, level) makes an atom: its kind is one of the profile's, it is long enough in bytes, and not too deep."""
    _, least, deepest, names = PROFILES[profile]
    return F.coalesce(F.col("type").isin(*names), F.lit(False)) & (F.octet_length(trimmed(F.col("text"))) >= least) & (F.coalesce("level", F.lit(0)) <= deepest)


def portable_atoms(units: DataFrame, profile: str) -> DataFrame:
    """Atoms of ``units(source, unit_id, type, text, level, parent_id, line)``, one for each unit that the profile takes; null text is empty and makes none."""
    domain, _, _, names = PROFILES[profile]
    text = trimmed(F.col("text"))
    return units.where(emits(profile)).select(
        "source", F.concat(F.lit(profile.upper() + "."), F.upper("unit_id")).alias("atom_id"), F.when(F.col("type") == "heading", slug(text)).otherwise(F.col("unit_id")).alias("canonical_ref"), _lookup(F.col("type"), names, "").alias("type"),
        text.alias("text"), F.concat(F.lit("sha256:"), raw_hash(text)).alias("content_hash"), F.col("level").alias("depth"), F.col("parent_id"), F.lit(domain).alias("domain"), F.lit(profile).alias("profile"), F.col("line").alias("source_line"),
    )


def trace_matrices(units: DataFrame, profile: str, block: int = BLOCK) -> DataFrame:
    """(source, total_atoms, total_source, coverage, matrix_hash): each source's units against the atoms they make.

    The hash covers ``atom|source unit|parent`` of all atoms by (line, unit), folded in blocks of ``block`` entries, so that no source is
    gathered in one task; it is null without an atom.
    """
    totals = units.groupBy("source").agg(F.count_if(emits(profile)).alias("total_atoms"), F.count(F.lit(1)).alias("total_source"))
    unit = F.upper("unit_id")
    entry = raw_hash(F.concat_ws("|", F.concat(F.lit(profile.upper() + "."), unit), unit, F.coalesce("parent_id", F.lit(""))))
    entries = placed(units.where(emits(profile)).select(F.col("source").alias("parent"), "line", "unit_id", entry.alias("digest")), "parent", ["line", "unit_id"])
    folds = folded_children(entries, block).withColumnRenamed("parent", "source")
    return totals.join(folds, "source", "left").select("source", "total_atoms", "total_source", (F.col("total_atoms") / F.col("total_source")).alias("coverage"), F.col("fold").alias("matrix_hash"))


def ordinal_paths(nodes: DataFrame) -> DataFrame:
    """(feed, ord, ordinal_path) of ``nodes(feed, ord, node_id, parent_id, ordinal_path)``: the stated path, else the parent's path and the place among siblings, from 1.

    The parent is the first node of the feed with that id, if it comes earlier; otherwise a path starts anew. Rounds of pointer doubling: log2 of the depth.
    """
    rows = nodes.select("feed", "ord", "node_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), F.coalesce("ordinal_path", F.lit("")).alias("stated"))
    rows = placed(rows.withColumn("family", F.struct("feed", "parent_id")), "family", ["ord"])
    firsts = rows.groupBy("feed", F.col("node_id").alias("parent_id")).agg(F.min("ord").alias("first"))
    stated = F.col("stated") != ""
    at = rows.join(firsts, ["feed", "parent_id"], "left").select(
        "feed", "ord", F.when(~stated & (F.col("parent_id") != "") & (F.col("first") < F.col("ord")), F.col("first")).alias("up"), F.when(stated, F.col("stated")).otherwise((F.col("place") + 1).cast("string")).alias("path")
    ).checkpoint()
    while at.where("up is not null").limit(1).count():
        far = at.select("feed", F.col("ord").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        at = at.join(far, ["feed", "up"], "left").select("feed", "ord", F.col("up2").alias("up"), F.concat_ws(".", "path2", "path").alias("path")).checkpoint()
    return at.select("feed", "ord", F.col("path").alias("ordinal_path"))


def normalised_nodes(nodes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Nodes with what they lack: ``defaults(feed, document_id, source_hash, domain, status, priority)``, depth by node type, ordinal paths; ``filled`` names what was changed.

    Status and priority that aren't known ones count as lacking. (feed, ord) is a node's key; a feed without defaults stays as it is, but for depths and ordinals.
    """
    names = ("document_id", "source_hash", "domain", "status", "priority")
    given = nodes.join(defaults.select("feed", *(F.col(c).alias(f"{c}_") for c in names)), "feed", "left")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    lacks = {c: empty(c) for c in names[:3]} | {c: ~F.coalesce(F.col(c).isin(*known), F.lit(False)) for c, known in (("status", NODE_STATUS), ("priority", PRIORITIES))}
    depth = _lookup(F.col("node_type"), NODE_DEPTH, None)
    right = F.coalesce(depth, F.col("depth"))
    changed = [F.when(on & F.col(f"{c}_").isNotNull(), c) for c, on in lacks.items()] + [F.when(~right.eqNullSafe(F.col("depth")), "depth"), F.when(empty("ordinal_path"), "ordinal_path")]
    fixed = {c: F.when(on, F.coalesce(f"{c}_", c)).otherwise(F.col(c)) for c, on in lacks.items()} | {"depth": right}
    keep = [F.col(c) if c not in fixed else fixed[c].alias(c) for c in nodes.columns if c != "ordinal_path"]
    return given.select(*keep, F.array_compact(F.array(*changed)).alias("filled")).join(ordinal_paths(nodes), ["feed", "ord"])


def feed_index(nodes: DataFrame) -> DataFrame:
    """(node_id, node_type, position, depth, root): each id at its last place, from 0 over all feeds; positions come from range partitions."""
    rows = sequenced(nodes.select("feed", "ord", "node_id", "node_type", "depth", is_blank(F.col("parent_id")).alias("root")), ["feed", "ord"])
    return rows.groupBy("node_id").agg(*(F.max_by(c, "idx").alias(c) for c in ("node_type", "depth", "root")), F.max("idx").alias("position"))


def citation_map(nodes: DataFrame) -> DataFrame:
    """(kind, ref, node_id, claims, contested): canonical and display references, each to the last node that claims it; contested if nodes with other ids claim it too."""
    refs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(f"{k}_ref", F.lit("")).alias("ref")) for k in ("canonical", "display"))))
    rows = nodes.select("feed", "ord", "node_id", refs.alias("r")).groupBy("r.kind", "r.ref")
    return rows.agg(F.max_by("node_id", _last()).alias("node_id"), F.count(F.lit(1)).alias("claims"), (F.min("node_id") != F.max("node_id")).alias("contested"))


def feed_conflicts(nodes: DataFrame, content: list[str]) -> DataFrame:
    """(node_id, versions, across_feeds, kind, winner): ids that come more than once, ``identical`` or ``conflict`` by the content columns, and the feed whose row stands."""
    digest = F.xxhash64(*content)  # compares rows of one id only
    rows = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("versions"), (F.min("feed") != F.max("feed")).alias("across_feeds"), F.when(F.min(digest) == F.max(digest), "identical").otherwise("conflict").alias("kind"), F.max_by("feed", _last()).alias("winner"))
    return rows.where("versions > 1")


def standing_nodes(nodes: DataFrame) -> DataFrame:
    """The union of all feeds with one row an id: the last."""
    whole = F.struct(*nodes.columns)
    return nodes.groupBy(F.col("node_id").alias("key_")).agg(F.max_by(whole, _last()).alias("n_")).select("n_.*")


def feed_documents(feeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row a feed, with its number of nodes, 0 for an empty one."""
    return feeds.join(nodes.groupBy("feed").agg(F.count(F.lit(1)).alias("node_count")), "feed", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))


def certified_entries(atoms: DataFrame, source_path: Column, least: str = "approved") -> DataFrame:
    """Feed entries of atoms (ord, atom_id, canonical_ref, type, title, span, content_hash, review_state) at or above a review state; ordinals from 1 over those taken."""
    rank = lambda c: _lookup(c, REVIEW_RANK, -1)
    taken = sequenced(atoms.where(rank(F.col("review_state")) >= rank(F.lit(least))), ["ord"])
    title = F.when(F.coalesce("title", F.lit("")) != "", F.concat("type", F.lit(": "), "title")).otherwise(F.concat("type", F.lit("@"), "span"))
    short = lambda *parts: F.substring(raw_hash(F.concat_ws(":", *parts)), 1, 16)
    return taken.select(
        F.concat(F.lit("N-"), F.upper(short("atom_id", "canonical_ref"))).alias("node_id"), F.concat(F.lit("feed-doc-"), short(source_path)).alias("document_id"), _lookup(F.col("type"), NODE_TYPES, "article").alias("node_type"), "canonical_ref",
        title.alias("display_ref"), (F.col("idx") + 1).cast("string").alias("ordinal_path"), F.col("content_hash").alias("source_hash"), _lookup(F.col("type"), {k: v[0] for k, v in PRIORITY_OF.items()}, "low").alias("priority"),
        _lookup(F.col("type"), {k: v[1] for k, v in PRIORITY_OF.items()}, 20).alias("rank"), "review_state", "atom_id",
    )
