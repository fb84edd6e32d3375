"""The cite-or-abstain gate: citation recall and precision, lexical groundedness, trust and decision per answer.

Answers carry ``spans`` and ``chunks``: arrays of structs (key, text). Everything is one projection; sums over answers
are ordinary aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import content_tokens, is_blank, sentences

#: Gates, and the outcomes that make a refusal explicit.
CITATION_GATE, FAITHFULNESS_GATE, CERTIFIED, INDICATIVE, SENTENCE = 0.95, 0.95, 0.95, 0.80, 0.6
REFUSALS, OUTCOMES = ("refused", "unsupported"), ("acceptable_refusal", "unsupported", "blocked_prompt_injection")


def coverage(tokens: Column, words: Column) -> Column:
    """Share of tokens, repeats kept, that are among the words; 0 without tokens."""
    return F.when(F.size(tokens) == 0, F.lit(0.0)).otherwise(F.size(F.filter(tokens, lambda t: F.array_contains(words, t))) / F.size(tokens))


def tokens_of(texts: Column) -> Column:
    return F.array_distinct(content_tokens(F.array_join(texts, "\n")))


def evaluate(answers: DataFrame, gate: float = CITATION_GATE, faithful: float = FAITHFULNESS_GATE, sentence: float = SENTENCE) -> DataFrame:
    """Adds recall, precision, method, faithfulness, trust_score, findings, trust_tier and decision.

    ``answers``: answer_id, answer, citation_status, refusal_status, policy_outcome, confidence, faithfulness_score
    (nullable), spans array<struct<source_id,source_hash,span,chunk_id,text>>, chunks array<struct<chunk_id,text>>.
    """
    key = lambda x: F.when(F.coalesce(x["chunk_id"], F.lit("")) != "", F.concat(F.lit("c\x00"), x["chunk_id"])).otherwise(F.concat_ws("\x00", F.lit("s"), x["source_id"], x["source_hash"], x["span"]))
    full = lambda s: (F.coalesce(s["source_id"], F.lit("")) != "") & (F.coalesce(s["source_hash"], F.lit("")) != "") & (F.coalesce(s["span"], F.lit("")) != "")
    a = answers.withColumns({
        "refusal": F.trim("refusal_status").isin(*REFUSALS) & F.trim("policy_outcome").isin(*OUTCOMES),
        "cited": F.array_distinct(F.transform("spans", key)),
        "retrieved": F.array_distinct(F.transform("chunks", key)),
        "backed": (F.trim("citation_status") == "source_backed") & (F.size("spans") > 0) & F.forall("spans", full),
        "support": F.concat(F.filter(F.transform("spans", lambda s: s["text"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.filter(F.transform("chunks", lambda c: c["text"]), lambda t: ~is_blank(t))),
        "parts": F.transform(sentences(F.col("answer")), content_tokens),
    })
    shared = F.size(F.array_intersect("cited", "retrieved"))
    n_cited, n_retrieved = F.size("cited"), F.size("retrieved")
    free = (n_retrieved == 0) & F.col("refusal")
    a = a.withColumns({
        "recall": F.round(F.when(free, 1.0).when(n_retrieved == 0, F.when(n_cited == 0, 1.0).otherwise(0.0)).otherwise(shared / n_retrieved), 4),
        "precision": F.round(F.when(free, 1.0).when(n_cited == 0, F.when(n_retrieved == 0, 1.0).otherwise(0.0)).otherwise(shared / n_cited), 4),
        "words": tokens_of(F.col("support")),
        "needs_grounding": ~F.col("refusal") & ~is_blank(F.col("answer")),
    })
    held = F.size(F.filter("parts", lambda t: (F.size(t) == 0) | (coverage(t, F.col("words")) >= sentence)))
    applies = (F.size("support") > 0) & ~is_blank(F.col("answer")) & (F.size("parts") > 0)
    a = a.withColumn("method", F.when(applies, "lexical").when((F.size("support") == 0) & F.col("needs_grounding"), "no_support_text").when(F.col("refusal"), "refusal").otherwise("structural"))
    base = F.when(F.col("refusal"), 1.0).when(F.col("method") == "lexical", F.round(held / F.size("parts"), 4)).when((F.col("method") == "no_support_text") | F.col("needs_grounding"), 0.0).otherwise(F.least("recall", "precision"))
    declared = F.col("faithfulness_score")
    a = a.withColumn("faithfulness", F.round(F.when(declared.between(0, 1), F.least(base, declared)).otherwise(base), 4))
    a = a.withColumn("trust_score", F.round((F.col("recall") + F.col("precision") + F.col("faithfulness") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))) / 4, 4))
    acceptable = F.trim("policy_outcome") == "acceptable"
    codes = F.array(
        F.when((F.trim("citation_status") == "source_backed") & ~F.col("backed"), "SOURCE_BACKED_CITATION_WITHOUT_SOURCE_SPANS"),
        F.when(acceptable & ~F.col("backed") & ~F.col("refusal"), "ACCEPTABLE_WITHOUT_CITATION_OR_REFUSAL"),
        F.when(acceptable & (F.col("recall") < gate), "ALCE_CITATION_RECALL_BELOW_GATE"),
        F.when(acceptable & (F.col("precision") < gate), "ALCE_CITATION_PRECISION_BELOW_GATE"),
        F.when(acceptable & (F.col("faithfulness") < faithful), "DEEPEVAL_FAITHFULNESS_BELOW_GATE"),
    )
    a = a.withColumn("findings", F.array_compact(codes))
    clean = F.size("findings") == 0
    tier = F.when(~clean, "unverified").when((F.col("recall") >= gate) & (F.col("precision") >= gate) & (F.col("faithfulness") >= faithful) & (F.col("trust_score") >= CERTIFIED), "certified").when(F.col("trust_score") >= INDICATIVE, "indicative").otherwise("unverified")
    decision = F.when(~F.col("refusal") & acceptable & clean, "cite").otherwise("abstain")
    return a.withColumn("trust_tier", tier).withColumn("decision", decision)


def gate_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.col("decision") == "cite").alias("cited"), F.count_if(F.col("decision") != "cite").alias("abstained"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings")).withColumn("status", F.when(F.col("findings") > 0, "fail").otherwise("pass"))


def eval_summary(verdicts: DataFrame, floors: dict[str, float], max_failed: int = 0) -> DataFrame:
    """Mean metrics and the regressions against their floors; an empty batch fails."""
    out = verdicts.agg(F.count(F.lit(1)).alias("checked"), F.count_if(F.size("findings") > 0).alias("failed_answers"), *(F.round(F.avg(c), 4).alias(f"mean_{c}") for c in ("recall", "precision", "faithfulness")))
    low = [F.when(F.col(f"mean_{c}") < v, f"mean_{c} below the versioned floor") for c, v in floors.items()]
    issues = F.array_sort(F.array_compact(F.array(F.when(F.col("checked") == 0, "empty eval corpus: nothing to evaluate"), F.when(F.col("failed_answers") > max_failed, "failed_answers above the versioned maximum"), *low)))
    return out.withColumn("regressions", F.array_join(issues, "; ")).withColumn("status", F.when(F.col("regressions") == "", "pass").otherwise("fail"))


def bench(verdicts: DataFrame) -> DataFrame:
    """Confusion counts and rates over all items (category null) and per category; items without a usable expectation are left out."""
    blocked = (F.size("findings") > 0) | (F.col("decision") != "cite")
    v = verdicts.where(F.col("expected_decision").isin("cite", "abstain")).select(F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("unlabelled")).alias("category"), F.col("expected_decision").alias("e"), blocked.alias("blocked"))
    is_a, is_c = F.col("e") == "abstain", F.col("e") == "cite"
    out = v.rollup("category").agg(F.count(F.lit(1)).alias("items"), F.count_if(is_a).alias("must_abstain"), F.count_if(is_a & F.col("blocked")).alias("blocked_as_expected"), F.count_if(is_a & ~F.col("blocked")).alias("false_cites"), F.count_if(is_c).alias("must_cite"), F.count_if(is_c & F.col("blocked")).alias("missed_cites"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return out.withColumn("must_abstain_recall", rate("blocked_as_expected", "must_abstain")).withColumn("false_cite_rate", rate("false_cites", "must_abstain")).withColumn("agreement", F.round((F.col("items") - F.col("false_cites") - F.col("missed_cites")) / F.col("items"), 4))


def context_metrics(answers: DataFrame) -> DataFrame:
    """(answer_id, context_recall, context_precision, relevant, retrieved) of answers with ``expected`` chunk keys and ``ranked`` ones in order."""
    hit = lambda k: F.array_contains(F.col("expected"), k)
    state = F.aggregate("ranked", F.struct(F.lit(0).alias("at"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum")), lambda s, k: F.struct((s["at"] + 1).alias("at"), (s["hits"] + hit(k).cast("int")).alias("hits"), (s["sum"] + F.when(hit(k), (s["hits"] + 1) / (s["at"] + 1)).otherwise(0.0)).alias("sum")))
    rows = answers.where(F.size("expected") > 0).withColumn("s", state)
    found = F.size(F.array_intersect(F.array_distinct("expected"), "ranked"))
    return rows.select("answer_id", F.round(found / F.size(F.array_distinct("expected")), 4).alias("context_recall"), F.when(F.col("s.hits") > 0, F.round(F.col("s.sum") / F.col("s.hits"), 4)).otherwise(0.0).alias("context_precision"), found.cast("long").alias("relevant"), F.size("ranked").cast("long").alias("retrieved"))
