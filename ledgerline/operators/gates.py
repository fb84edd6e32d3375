"""Gates and governance rules that turn rows into findings, scores and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions.globs import glob_regex

from .pieces import with_neighbours
from .sizes import broadcast_if_small

#: Allowed review transitions and their actions.
TRANSITIONS = (
    ("draft", "pending_review", "submit_for_review"), ("draft", "archived", "archive"),
    ("pending_review", "approved", "approve"), ("pending_review", "rejected", "reject"), ("pending_review", "draft", "return_to_draft"),
    ("approved", "archived", "archive"), ("approved", "pending_review", "request_re_review"),
    ("rejected", "draft", "revise"), ("rejected", "archived", "archive"), ("archived", "draft", "unarchive"),
)
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def review_actions(rows: DataFrame) -> DataFrame:
    """Adds ``action`` and ``allowed`` to rows (from_state, to_state)."""
    table = F.broadcast(rows.sparkSession.createDataFrame(list(TRANSITIONS), "from_state string, to_state string, action string"))
    return rows.join(table, ["from_state", "to_state"], "left").withColumn("allowed", F.col("action").isNotNull()).withColumn("action", F.coalesce("action", F.lit("")))


def chain_status(signed: DataFrame, key: str, order: str) -> DataFrame:
    """(key, signatures, chain_ok): each signature names the hash of the one before it, the first an empty one."""
    rows = with_neighbours(signed.select(key, order, "record_hash", "previous_hash"), key, [order], "record_hash", "before_")
    return rows.withColumn("ok_", F.col("previous_hash") == F.coalesce("before_", F.lit(""))).groupBy(key).agg(F.count(F.lit(1)).alias("signatures"), F.bool_and("ok_").alias("chain_ok"))


def matrix_coverage(rows: DataFrame, key: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("units"), n("covered"), n("partial"), n("missing"), F.round(F.count_if(F.col("status") == "covered") / F.count(F.lit(1)), 4).alias("score"))


def exception_findings(rows: DataFrame, today: str) -> DataFrame:
    """First finding of each waiver (id, owner, status, expires_at): expired while active, or without an owner."""
    code = F.when((F.col("expires_at") < F.lit(today).cast("date")) & (F.col("status") == "active"), "EXCEPTION_EXPIRED_ACTIVE").when(F.coalesce("owner", F.lit("")) == "", "EXCEPTION_MISSING_OWNER")
    return rows.withColumn("code", code).where("code is not null")


def claims(docs: DataFrame, patterns: dict[str, str], exclude: str) -> DataFrame:
    """(doc_id, line_no from 1, id) of lines that match a forbidden pattern and not the exclusion; one pass over each line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line")).where(~F.col("line").rlike(exclude))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), k) for k, p in patterns.items())))
    return lines.select("doc_id", (F.col("n") + 1).cast("long").alias("line_no"), F.explode(hits).alias("id"))


def prefix_impact(changes: DataFrame, path: str, refs: DataFrame, ref: str) -> DataFrame:
    """Changes whose path is a ref or lies below it: an equi-join on all of a path's ancestors, not a comparison of all pairs."""
    parts = F.split(path, "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return changes.withColumn(ref, F.explode(F.array_distinct(ancestors))).join(refs, ref)


def glob_impact(changes: DataFrame, mappings: list[tuple[str, list[str], str]]) -> DataFrame:
    """(test, severity, triggers, first_trigger): tests hit by changed paths; the mappings are configuration, so they become one expression."""
    hits = F.array_compact(F.array(*(F.when(F.col("path").rlike(glob_regex(p)), F.struct(F.lit(t).alias("test"), F.lit(RANK[s]).alias("rank"))) for p, tests, s in mappings for t in tests)))
    rows = changes.select("path", F.explode(hits).alias("h")).select("path", "h.test", "h.rank")
    names = F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (v, k)))
    return rows.groupBy("test").agg(F.max("rank").alias("rank"), F.countDistinct("path").alias("triggers"), F.min("path").alias("first_trigger")).select("test", names[F.col("rank")].alias("severity"), "triggers", "first_trigger")


def lexicon_usage(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(token, status, canonical, uses): tokens are counted before they meet the terms (alias, canonical, status)."""
    used = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    out = used.join(terms.withColumnRenamed("alias", "token"), "token", "left")
    return out.select("token", F.coalesce("status", F.lit("ungoverned")).alias("status"), F.coalesce("canonical", F.lit("")).alias("canonical"), "uses")


def posture(rules: list[tuple[int, str, str]], fallback: str = "disclaim") -> Column:
    """Action of the first rule (priority, SQL condition, action), by priority, that holds."""
    out = F.when(F.lit(False), F.lit(""))
    for _, condition, action in sorted(rules):
        out = out.when(F.expr(condition), F.lit(action))
    return out.otherwise(F.lit(fallback))


def weighted(parts: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for c, w in parts.items():
        out = out + F.lit(w) * F.col(c)
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 0.9, "A").when(score >= 0.75, "B").when(score >= 0.6, "C").when(score >= 0.4, "D").otherwise("F")


def dimension_scores(checks: DataFrame, key: str) -> DataFrame:
    """Weighted mean of checks (status, score, weight) per dimension; skipped ones don't count, a weight of 0 or less is 1, no check scores 1."""
    w = F.when(F.col("weight") <= 0, 1).otherwise(F.col("weight"))
    ran = F.col("status") != "skipped"
    return checks.groupBy(key).agg(F.round(F.coalesce(F.sum(F.when(ran, F.col("score") * w)) / F.sum(F.when(ran, w)), F.lit(1.0)), 4).alias("score"), F.count_if(ran).alias("checks"))


def regression(gold: DataFrame, produced: DataFrame) -> DataFrame:
    """(key, outcome) of (key, expected) and (key, actual): matched, partial, missing or extra."""
    g, p = gold.withColumn("g_", F.lit(True)), produced.withColumn("p_", F.lit(True))
    out = F.when(F.col("p_").isNull(), "missing").when(F.col("g_").isNull(), "extra").when(F.col("expected") == F.col("actual"), "matched").otherwise("partial")
    return g.join(p, "key", "full_outer").select("key", out.alias("outcome"))


def evidence_status(required: DataFrame, collected: DataFrame) -> DataFrame:
    r, c = required.select("id", F.lit(True).alias("r_")), collected.select("id", F.lit(True).alias("c_"))
    return r.join(c, "id", "full_outer").select("id", F.when(F.col("c_").isNull(), "missing").when(F.col("r_").isNull(), "unrequested").otherwise("present").alias("status"))


def lexical_rank(queries: DataFrame, nodes: DataFrame, query: str, node: str, document: str, top: int) -> DataFrame:
    """(query, rank, document, score): tokens shared with a query, best node of each document, ties by name; no match, no row.

    Queries are the small side: while they are, no token of a node is shuffled, and a node's matches are added up where it is read.
    """
    score = nodes.join(broadcast_if_small(queries), "t").groupBy(query, document, node).agg(F.count(F.lit(1)).alias("score"))
    best = score.groupBy(query, document).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), document))
    return best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(query, "rank", document, "score")
