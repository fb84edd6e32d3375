"""Queries over conversations, orders, lineitem, events, pages and dimension tables: answers, validity, merges, graphs, gates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.functions import text as tx
from ledgerline.operators import answers as an
from ledgerline.operators import gates as gt
from ledgerline.operators import graphs as gr
from ledgerline.operators import segments as sg
from ledgerline.operators import temporal as tm

from ledgerline.sources.shared import ensure_checkpoints

from .corpus import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- answers: an assistant turn, supported by the user turn before it -------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
TOKENS = f"list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains([{STOP}], t))"
ANSWERS = f"""turns AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
a AS (SELECT conv_id || ':' || turn AS answer_id, conv_id, turn, CASE WHEN (conv_id + turn) % 13 = 0 THEN '' ELSE text END AS answer, CASE WHEN conv_id % 7 = 3 THEN 'unsupported' ELSE '' END AS refusal_status,
  CASE WHEN conv_id % 7 = 3 THEN 'acceptable_refusal' WHEN conv_id % 7 = 4 THEN 'rejected' ELSE 'acceptable' END AS policy_outcome, CASE WHEN conv_id % 5 = 2 THEN 'none' ELSE 'source_backed' END AS citation_status,
  CASE WHEN conv_id % 4 = 1 THEN 1.7 ELSE 0.9 END AS confidence, CASE WHEN conv_id % 6 = 1 THEN 0.5 WHEN conv_id % 6 = 2 THEN 3.0 END AS declared,
  CASE WHEN conv_id % 5 = 2 THEN [] WHEN conv_id % 9 = 4 THEN [conv_id || '/a', conv_id || '/z'] ELSE [conv_id || '/a'] END AS cited, CASE WHEN conv_id % 11 = 5 THEN [] WHEN conv_id % 8 = 6 THEN [conv_id || '/a', conv_id || '/b'] ELSE [conv_id || '/a'] END AS retrieved,
  CASE WHEN conv_id % 3 = 0 THEN coalesce(prev, '') || ' ' || text ELSE coalesce(prev, '') END AS support_text FROM turns WHERE role = 'assistant'),
b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[.!?]+'), lambda s: trim(regexp_replace(s, '^\\s+|\\s+$', '', 'g'))), lambda s: s <> '') AS sents, len(list_intersect(cited, retrieved)) AS shared,
  refusal_status = 'unsupported' AND policy_outcome = 'acceptable_refusal' AS refusal, len(cited) > 0 AND citation_status = 'source_backed' AS backed, CASE WHEN len(retrieved) > 0 THEN support_text ELSE '' END AS support FROM a),
c AS (SELECT *, round(CASE WHEN len(retrieved) = 0 AND refusal THEN 1.0 WHEN len(retrieved) = 0 THEN CASE WHEN len(cited) = 0 THEN 1.0 ELSE 0.0 END ELSE shared / len(retrieved)::DOUBLE END, 4)::DOUBLE AS recall, round(CASE WHEN len(retrieved) = 0 AND refusal THEN 1.0 WHEN len(cited) = 0 THEN CASE WHEN len(retrieved) = 0 THEN 1.0 ELSE 0.0 END ELSE shared / len(cited)::DOUBLE END, 4)::DOUBLE AS precision,
  list_distinct({TOKENS.format('support')}) AS words, trim(support) <> '' AS has_support FROM b),
e AS (SELECT *, len(list_filter(sents, lambda s: len({TOKENS.format('s')}) = 0 OR len(list_filter({TOKENS.format('s')}, lambda t: list_contains(words, t))) / len({TOKENS.format('s')})::DOUBLE >= 0.6)) AS held, has_support AND len(sents) > 0 AS applies, NOT refusal AND trim(answer) <> '' AS needs FROM c),
g AS (SELECT *, CASE WHEN applies THEN 'lexical' WHEN NOT has_support AND needs THEN 'no_support_text' WHEN refusal THEN 'refusal' ELSE 'structural' END AS method FROM e),
h AS (SELECT *, CASE WHEN refusal THEN 1.0 WHEN method = 'lexical' THEN round(held / len(sents)::DOUBLE, 4) WHEN method = 'no_support_text' OR needs THEN 0.0 ELSE least(recall, precision) END::DOUBLE AS base FROM g),
i AS (SELECT *, round(CASE WHEN declared BETWEEN 0 AND 1 THEN least(base, declared) ELSE base END, 4)::DOUBLE AS faithfulness FROM h),
j AS (SELECT *, round((recall + precision + faithfulness + greatest(0, least(1, confidence)))::DOUBLE / 4, 4) AS trust_score, policy_outcome = 'acceptable' AS ok FROM i),
k AS (SELECT *, list_filter([CASE WHEN citation_status = 'source_backed' AND NOT backed THEN 'SOURCE_BACKED_CITATION_WITHOUT_SOURCE_SPANS' END, CASE WHEN ok AND NOT backed AND NOT refusal THEN 'ACCEPTABLE_WITHOUT_CITATION_OR_REFUSAL' END, CASE WHEN ok AND recall < 0.95 THEN 'ALCE_CITATION_RECALL_BELOW_GATE' END, CASE WHEN ok AND precision < 0.95 THEN 'ALCE_CITATION_PRECISION_BELOW_GATE' END, CASE WHEN ok AND faithfulness < 0.95 THEN 'DEEPEVAL_FAITHFULNESS_BELOW_GATE' END], lambda x: x IS NOT NULL) AS findings FROM j),
v AS (SELECT *, CASE WHEN len(findings) > 0 THEN 'unverified' WHEN recall >= 0.95 AND precision >= 0.95 AND faithfulness >= 0.95 AND trust_score >= 0.95 THEN 'certified' WHEN trust_score >= 0.8 THEN 'indicative' ELSE 'unverified' END AS trust_tier, CASE WHEN NOT refusal AND ok AND len(findings) = 0 THEN 'cite' ELSE 'abstain' END AS decision FROM k)"""


def _verdicts(spark, d):
    c = table(spark, d, "conversations").withColumn("prev", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    n = F.col("conv_id")
    support = F.when(n % 3 == 0, F.concat(F.coalesce("prev", F.lit("")), F.lit(" "), F.col("text"))).otherwise(F.coalesce("prev", F.lit("")))
    key = lambda s: F.concat(n.cast("string"), F.lit(s))
    span = lambda s: F.struct(F.lit("s").alias("source_id"), F.lit("h").alias("source_hash"), F.lit("1-2").alias("span"), key(s).alias("chunk_id"), F.lit("").alias("text"))
    chunk = lambda s, t: F.struct(F.lit("s").alias("source_id"), F.lit("h").alias("source_hash"), F.lit("1-2").alias("span"), key(s).alias("chunk_id"), t.alias("text"))
    none = F.array().cast("array<struct<source_id:string,source_hash:string,span:string,chunk_id:string,text:string>>")
    rows = c.select(
        F.concat_ws(":", "conv_id", "turn").alias("answer_id"), "conv_id", "turn", F.when((n + F.col("turn")) % 13 == 0, "").otherwise(F.col("text")).alias("answer"), F.when(n % 7 == 3, "unsupported").otherwise("").alias("refusal_status"),
        F.when(n % 7 == 3, "acceptable_refusal").when(n % 7 == 4, "rejected").otherwise("acceptable").alias("policy_outcome"), F.when(n % 5 == 2, "none").otherwise("source_backed").alias("citation_status"),
        F.when(n % 4 == 1, 1.7).otherwise(0.9).alias("confidence"), F.when(n % 6 == 1, 0.5).when(n % 6 == 2, 3.0).alias("faithfulness_score"),
        F.when(n % 5 == 2, none).when(n % 9 == 4, F.array(span("/a"), span("/z"))).otherwise(F.array(span("/a"))).alias("spans"), F.when(n % 11 == 5, none).when(n % 8 == 6, F.array(chunk("/a", support), chunk("/b", F.lit("")))).otherwise(F.array(chunk("/a", support))).alias("chunks"),
        F.element_at(F.array(*map(F.lit, ("direct", "negation", "stale", "numeric"))), (n % 4 + 1).cast("int")).alias("category"), F.when(n % 10 == 9, "maybe").when(n % 2 == 0, "cite").otherwise("abstain").alias("expected_decision"),
    )
    return an.evaluate(rows)


@query(f"WITH {ANSWERS} SELECT answer_id, recall, precision, method, faithfulness, trust_score, trust_tier, decision, array_to_string(findings, ',') AS findings FROM v")
def answer_gate(spark, d):
    return _verdicts(spark, d).select("answer_id", "recall", "precision", "method", "faithfulness", "trust_score", "trust_tier", "decision", F.array_join("findings", ",").alias("findings"))


@query(f"WITH {ANSWERS} SELECT count(*) AS checked, count_if(decision = 'cite') AS cited, count_if(decision <> 'cite') AS abstained, CAST(sum(len(findings)) AS BIGINT) AS findings, CASE WHEN sum(len(findings)) > 0 THEN 'fail' ELSE 'pass' END AS status FROM v")
def answer_gate_summary(spark, d):
    return an.gate_summary(_verdicts(spark, d))


@query(f"""WITH {ANSWERS}, m AS (SELECT count(*) AS checked, count_if(len(findings) > 0) AS failed_answers, round(avg(recall), 4) AS mean_recall, round(avg(precision), 4) AS mean_precision, round(avg(faithfulness), 4) AS mean_faithfulness FROM v),
r AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN failed_answers > 0 THEN 'failed_answers above the versioned maximum' END, CASE WHEN mean_recall < 0.95 THEN 'mean_recall below the versioned floor' END, CASE WHEN mean_faithfulness < 0.1 THEN 'mean_faithfulness below the versioned floor' END], lambda x: x IS NOT NULL)), '; ') AS regressions FROM m)
SELECT *, CASE WHEN regressions = '' THEN 'pass' ELSE 'fail' END AS status FROM r""")
def answer_eval(spark, d):
    return an.eval_summary(_verdicts(spark, d), {"recall": 0.95, "faithfulness": 0.1})


@query(f"""WITH {ANSWERS}, w AS (SELECT (['direct','negation','stale','numeric'])[conv_id % 4 + 1] AS category, CASE WHEN conv_id % 10 = 9 THEN 'maybe' WHEN conv_id % 2 = 0 THEN 'cite' ELSE 'abstain' END AS e, len(findings) > 0 OR decision <> 'cite' AS blocked FROM v),
s AS (SELECT category, count(*) AS items, count_if(e = 'abstain') AS must_abstain, count_if(e = 'abstain' AND blocked) AS blocked_as_expected, count_if(e = 'abstain' AND NOT blocked) AS false_cites, count_if(e = 'cite') AS must_cite, count_if(e = 'cite' AND blocked) AS missed_cites FROM w WHERE e IN ('cite', 'abstain') GROUP BY ROLLUP (category))
SELECT *, CASE WHEN must_abstain > 0 THEN round(blocked_as_expected / must_abstain::DOUBLE, 4) ELSE 0 END AS must_abstain_recall, CASE WHEN must_abstain > 0 THEN round(false_cites / must_abstain::DOUBLE, 4) ELSE 0 END AS false_cite_rate, round((items - false_cites - missed_cites) / items::DOUBLE, 4) AS agreement FROM s""")
def answer_bench(spark, d):
    return an.bench(_verdicts(spark, d))


@query("""WITH r AS (SELECT conv_id, list(conv_id || '/' || turn ORDER BY turn DESC) AS ranked, list(conv_id || '/' || turn) FILTER (role = 'user') AS expected FROM conversations GROUP BY conv_id),
u AS (SELECT conv_id, expected, unnest(ranked) AS k, generate_subscripts(ranked, 1) AS n_ FROM r WHERE len(expected) > 0),
h AS (SELECT *, list_contains(expected, k) AS hit, sum(list_contains(expected, k)::INT) OVER (PARTITION BY conv_id ORDER BY n_) AS hits FROM u)
SELECT conv_id::VARCHAR AS answer_id, round(count(DISTINCT k) FILTER (hit) / any_value(len(expected))::DOUBLE, 4) AS context_recall, coalesce(round(sum(hits / n_::DOUBLE) FILTER (hit) / count(*) FILTER (hit), 4), 0) AS context_precision, count(DISTINCT k) FILTER (hit) AS relevant, count(*) AS retrieved FROM h GROUP BY conv_id""")
def context_metrics(spark, d):
    c = table(spark, d, "conversations").withColumn("key", F.concat_ws("/", "conv_id", "turn"))
    rows = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key")), asc=False).alias("r"), F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.col("key")))).alias("expected"))
    return an.context_metrics(rows.select(F.col("conv_id").cast("string").alias("answer_id"), F.col("r.key").alias("ranked"), "expected"))


@query(f"""WITH q AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS t FROM benchmark), n AS (SELECT doc_id, source, unnest(list_distinct({TOKENS.format('text')})) AS t FROM documents),
s AS (SELECT item_id, source, doc_id, count(*) AS score FROM q JOIN n USING (t) GROUP BY ALL), m AS (SELECT item_id, source, max(score) AS score FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, source) AS rank FROM m) SELECT item_id, rank, source, score FROM r WHERE rank <= 3""")
def lexical_rank(spark, d):
    tokens = lambda df, *k: df.select(*k, F.explode(F.array_distinct(tx.content_tokens(F.col("text")))).alias("t"))
    return gt.lexical_rank(tokens(table(spark, d, "benchmark"), "item_id"), tokens(table(spark, d, "documents"), "doc_id", "source"), "item_id", "doc_id", "source", 3)


@query("""SELECT conv_id, sum(length(text)) AS chars FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING max(length(text)) <= 0""")
def context_window_empty(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).alias("m")).where("m <= 0").drop("m")


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, list(n ORDER BY turn, n) AS n FROM (SELECT conv_id, turn, greatest(CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.33) AS BIGINT), 1) AS n FROM conversations) GROUP BY conv_id),
r(conv_id, nth, room, taken) AS (SELECT conv_id, 0, CAST(200 AS BIGINT), '' FROM c UNION ALL SELECT r.conv_id, nth + 1, CASE WHEN n[nth + 1] <= room THEN room - n[nth + 1] ELSE room END, CASE WHEN room > 0 AND n[nth + 1] <= room THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || nth ELSE taken END FROM r JOIN c ON r.conv_id = c.conv_id WHERE nth < len(n))
SELECT r.conv_id, taken FROM r JOIN c ON r.conv_id = c.conv_id WHERE nth = len(n)""")
def context_window(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", tx.tokens_by_words(F.col("text")).alias("n")))).alias("t"))
    return c.select("conv_id", F.array_join(tx.greedy_window(F.col("t.n"), 200), ",").alias("taken"))


# -- validity, merges, identifiers ------------------------------------------------------------------------------------

VALID = """valid AS (SELECT o_custkey AS work_id, o_orderkey AS atom_id, CAST(o_orderdate AS DATE) AS effective_from, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS effective_to FROM orders)"""
ASKED = "asked AS (SELECT c_custkey AS work_id, DATE '1995-06-30' + CAST(c_custkey % 400 AS INTEGER) AS as_of FROM customer)"


def _validity(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    atoms = table(spark, d, "orders").select(F.col("o_custkey").alias("work_id"), F.col("o_orderkey").alias("atom_id"), F.col("o_orderdate").cast("date").alias("effective_from"), F.lead("o_orderdate").over(w).cast("date").alias("effective_to"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("work_id"), F.expr("date_add(DATE '1995-06-30', cast(c_custkey % 400 as int))").alias("as_of"))
    return atoms, asked


@query(f"""WITH {VALID}, {ASKED}, m AS (SELECT a.work_id, a.as_of, v.atom_id, row_number() OVER (PARTITION BY a.work_id ORDER BY v.effective_from DESC, v.atom_id DESC) AS n FROM asked a JOIN valid v ON a.work_id = v.work_id AND v.effective_from <= a.as_of AND (v.effective_to IS NULL OR a.as_of <= v.effective_to))
SELECT a.work_id, a.as_of, m.atom_id, CASE WHEN m.atom_id IS NULL THEN 'not_in_force' ELSE 'in_force' END AS status FROM asked a LEFT JOIN m ON m.work_id = a.work_id AND m.n = 1""")
def point_in_time(spark, d):
    return tm.resolve_as_of(*_validity(spark, d))


@query(f"""WITH {VALID}, {ASKED} SELECT a.work_id FROM asked a ANTI JOIN (SELECT DISTINCT a.work_id FROM asked a JOIN valid v ON a.work_id = v.work_id AND v.effective_from <= a.as_of AND (v.effective_to IS NULL OR a.as_of <= v.effective_to)) f USING (work_id)""")
def not_in_force(spark, d):
    return tm.resolve_as_of(*_validity(spark, d)).where("status = 'not_in_force'").select("work_id")


@query("""WITH r AS (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS n FROM lineitem)
SELECT l_partkey, l_linenumber, l_orderkey, l_suppkey, (SELECT count(DISTINCT l_linenumber) FROM lineitem x WHERE x.l_partkey = r.l_partkey) AS layers FROM r WHERE n = 1""")
def priority_merge(spark, d):
    return sg.priority_merge(table(spark, d, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey", "l_suppkey"), "l_partkey", "l_linenumber", ["l_orderkey"])


@query("SELECT l_partkey, count(DISTINCT l_linenumber) AS layers, count(*) AS entries FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber) > 1")
def merge_conflicts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_linenumber").alias("layers"), F.count(F.lit(1)).alias("entries")).where("layers > 1")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_returnflag || '-' || l_partkey AS base FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY l_orderkey, l_linenumber) AS n FROM b)
SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN base ELSE base || '-' || CASE WHEN n < 10 THEN '0' ELSE '' END || n END AS unit_id FROM n""")
def unique_unit_ids(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_returnflag", "l_partkey").alias("base"))
    return sg.unique_ids(rows, "base", ["l_orderkey", "l_linenumber"]).drop("base")


# -- pages: references and impact -------------------------------------------------------------------------------------

HREFS = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1)) AS target FROM pages)"""
KIND = "CASE WHEN regexp_matches(target, '^(https?:)?//') THEN 'url' WHEN starts_with(target, '#') THEN 'anchor' WHEN starts_with(target, 'mailto:') THEN 'mail' ELSE 'path' END"


def _hrefs(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1))).alias("target"))


@query(f"WITH {HREFS} SELECT page_id, target, {KIND} AS kind, count(*) AS uses FROM hrefs GROUP BY ALL")
def html_external_refs(spark, d):
    return _hrefs(spark, d).groupBy("page_id", "target", gr.link_kind(F.col("target")).alias("kind")).agg(F.count(F.lit(1)).alias("uses"))


@query(f"WITH {HREFS} SELECT {KIND} AS kind, count(*) AS links, count(DISTINCT page_id) AS pages FROM hrefs GROUP BY ALL")
def citation_kinds(spark, d):
    return _hrefs(spark, d).groupBy(gr.link_kind(F.col("target")).alias("kind")).agg(F.count(F.lit(1)).alias("links"), F.countDistinct("page_id").alias("pages"))


@query(f"""WITH {HREFS} SELECT h.page_id, h.target FROM hrefs h WHERE starts_with(target, '#') AND NOT EXISTS (SELECT 1 FROM pages p WHERE p.page_id = h.page_id AND list_contains(regexp_extract_all(p.html, 'id="([^"]*)"', 1), substr(h.target, 2)))""")
def broken_anchors(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]*)"'), F.lit(1)).alias("t"), F.regexp_extract_all("html", F.lit('id="([^"]*)"'), F.lit(1)).alias("ids"))
    return p.select("page_id", "ids", F.explode("t").alias("target")).where(F.col("target").startswith("#") & ~F.array_contains("ids", F.substring("target", 2, 1 << 30))).select("page_id", "target")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>[^<]*</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages""")
def html_text(spark, d):
    t = F.regexp_replace("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " ")
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[ \t\n\r]+", " ")).alias("text"))


PATHS = "paths AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"


@query(f"WITH {PATHS}, refs AS (SELECT DISTINCT regexp_extract(path, '^([^/]*)', 1) AS ref FROM paths) SELECT r.ref, p.page_id FROM refs r JOIN paths p ON p.path = r.ref OR starts_with(p.path, r.ref || '/')")
def impact_prefix_join(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1).alias("path"))
    refs = p.select(F.regexp_extract("path", "^([^/]*)", 1).alias("ref")).distinct()
    return gt.prefix_impact(p, "path", refs, "ref").select("ref", "page_id")


@query("""WITH changes AS (SELECT lang || '/' || source || '/d' || doc_id AS path FROM documents), m(pattern, test, sev, rank) AS (VALUES ('^en/.*$', 'contracts', 'critical', 4), ('^[^/]*/src1/.*$', 'contracts', 'low', 1), ('^[^/]*/src1/.*$', 'fidelity', 'medium', 2), ('^de/src3/.*$', 'export', 'high', 3)),
h AS (SELECT test, path, rank FROM changes JOIN m ON regexp_matches(path, pattern)) SELECT test, CASE max(rank) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(DISTINCT path) AS triggers, min(path) AS first_trigger FROM h GROUP BY test""")
def glob_impact(spark, d):
    changes = table(spark, d, "documents").select(F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), "doc_id")).alias("path"))
    return gt.glob_impact(changes, [("en/**", ["contracts"], "critical"), ("*/src1/**", ["contracts"], "low"), ("*/src1/**", ["fidelity"], "medium"), ("de/src3/**", ["export"], "high")])


# -- graphs -----------------------------------------------------------------------------------------------------------

GRAPH = "edges AS (SELECT 'n' || n_nationkey AS source, 'r' || (n_regionkey + CASE WHEN n_nationkey % 6 = 0 THEN 50 ELSE 0 END) AS target, CASE WHEN n_nationkey % 2 = 0 THEN 'part_of' ELSE 'cites' END AS kind FROM nation), nodes AS (SELECT 'n' || n_nationkey AS node FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 's' || s_suppkey FROM supplier)"


def _graph(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), F.col("n_regionkey") + F.when(F.col("n_nationkey") % 6 == 0, 50).otherwise(0)).alias("target"), F.when(F.col("n_nationkey") % 2 == 0, "part_of").otherwise("cites").alias("kind"))
    node = lambda t, p, k: table(spark, d, t).select(F.concat(F.lit(p), k).alias("node"), k)
    nodes = node("nation", "n", "n_nationkey").select("node").unionByName(node("region", "r", "r_regionkey").select("node")).unionByName(node("supplier", "s", "s_suppkey").select("node"))
    return nodes, edges


@query(f"WITH {GRAPH} SELECT node FROM nodes ANTI JOIN (SELECT source AS node FROM edges UNION SELECT target FROM edges) e USING (node)")
def ref_orphans(spark, d):
    return gr.orphans(*_graph(spark, d))


@query(f"WITH {GRAPH} SELECT source, target, kind FROM edges ANTI JOIN nodes ON edges.target = nodes.node")
def ref_broken(spark, d):
    nodes, edges = _graph(spark, d)
    return gr.broken_references(edges, nodes).select("source", "target", "kind")


@query(f"WITH {GRAPH} SELECT kind, count(*) AS edges, count_if(node IS NULL) AS broken FROM edges LEFT JOIN nodes ON target = node GROUP BY kind")
def edge_stats(spark, d):
    nodes, edges = _graph(spark, d)
    return gr.edge_statistics(edges, nodes)


@query("""WITH RECURSIVE n AS (SELECT CAST(p_partkey AS VARCHAR) AS node, CASE WHEN p_partkey >= 4 THEN CAST(p_partkey // 4 AS VARCHAR) END AS parent FROM part),
c AS (SELECT node, parent AS at, CAST([] AS VARCHAR[]) AS chain FROM n UNION ALL SELECT c.node, n.parent, list_prepend(c.at, c.chain) FROM c JOIN n ON n.node = c.at)
SELECT node, array_to_string(arg_max(chain, len(chain)), '/') AS chain FROM c GROUP BY node""")
def parent_chain(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("node"), F.when(F.col("p_partkey") >= 4, F.floor(F.col("p_partkey") / 4).cast("string")).alias("parent"))
    ensure_checkpoints(spark)
    return gr.parent_chains(n, keep_unknown=False).select("node", F.array_join("chain", "/").alias("chain"))


MERKLE = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents),
l(lvl, idx, hash) AS (SELECT 0, row_number() OVER (ORDER BY doc_id) - 1, sha256(text) FROM documents UNION ALL
 SELECT lvl + 1, idx // 2, sha256(min_by(hash, idx) || chr(10) || max_by(hash, idx)) FROM l WHERE (1 << lvl) < (SELECT n FROM n) GROUP BY lvl, idx // 2)"""


def _merkle_levels(spark, d):
    ensure_checkpoints(spark)
    return gr.merkle_levels(gr.sequenced(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), ["doc_id"]))


@query(f"{MERKLE} SELECT hash FROM l WHERE lvl = (SELECT max(lvl) FROM l)")
def merkle_root(spark, d):
    return _merkle_levels(spark, d)[-1].select("hash")


@query(f"{MERKLE} SELECT CAST(idx AS BIGINT) AS idx, hash AS leaf, (SELECT hash FROM l WHERE lvl = (SELECT max(lvl) FROM l)) AS root, true AS verified FROM l WHERE lvl = 0")
def merkle_verify(spark, d):
    """What each leaf's proof leads to, and whether that is the root."""
    levels = _merkle_levels(spark, d)
    root = F.broadcast(levels[-1].select(F.col("hash").alias("known")))  # one row
    folded = gr.merkle_proofs(levels).select("idx", "leaf", gr.fold_proof(F.col("leaf"), F.col("path")).alias("root"))
    return folded.crossJoin(root).select("idx", "leaf", "root", (F.col("root") == F.col("known")).alias("verified"))


# -- gates and governance ---------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'approved' ELSE 'pending_review' END AS state, o_orderdate FROM orders), t AS (SELECT *, lag(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM s),
a(prev, state, action) AS (VALUES ('draft','pending_review','submit_for_review'),('draft','archived','archive'),('pending_review','approved','approve'),('pending_review','rejected','reject'),('pending_review','draft','return_to_draft'),('approved','archived','archive'),('approved','pending_review','request_re_review'),('rejected','draft','revise'),('rejected','archived','archive'),('archived','draft','unarchive'))
SELECT t.prev AS from_state, t.state AS to_state, coalesce(a.action, '') AS action, a.action IS NOT NULL AS allowed, count(*) AS transitions FROM t LEFT JOIN a USING (prev, state) WHERE t.prev IS NOT NULL GROUP BY ALL""")
def review_transitions(spark, d):
    state = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "approved").otherwise("pending_review")
    o = table(spark, d, "orders").withColumn("to_state", state).withColumn("from_state", F.lag(state).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("from_state is not null")
    return gt.review_actions(o).groupBy("from_state", "to_state", "action", "allowed").agg(F.count(F.lit(1)).alias("transitions"))


@query("""WITH s AS (SELECT user_id, event_id, sha256(event_type || event_id) AS record_hash, lag(sha256(event_type || event_id)) OVER (PARTITION BY user_id ORDER BY event_id) AS before, CASE WHEN event_id % 97 = 0 THEN 'broken' END AS tamper FROM events)
SELECT user_id, count(*) AS signatures, bool_and(tamper IS NULL) AS chain_ok FROM s GROUP BY user_id""")
def approval_chain(spark, d):
    own = F.sha2(F.concat("event_type", "event_id"), 256)
    e = table(spark, d, "events").select("user_id", "event_id", own.alias("record_hash"))
    prev = F.lag("record_hash").over(Window.partitionBy("user_id").orderBy("event_id"))
    signed = e.withColumn("previous_hash", F.when(F.col("event_id") % 97 == 0, "broken").otherwise(F.coalesce(prev, F.lit(""))))
    return gt.chain_status(signed, "user_id", "event_id")


@query("""WITH r AS (SELECT doc_id, lang, quality, text, CASE WHEN quality IS NULL THEN 'missing' WHEN quality = 1 THEN 'covered' ELSE 'partial' END AS status FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS units, count_if(status = 'covered') AS covered, count_if(status = 'partial') AS partial, count_if(status = 'missing') AS missing, round(count_if(status = 'covered') / count(*)::DOUBLE, 4) AS score FROM r GROUP BY lang""")
def matrix_coverage(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return gt.matrix_coverage(rows.withColumn("status", F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 1, "covered").otherwise("partial")), "lang")


@query("""SELECT o_orderkey AS id, CASE WHEN expires < DATE '1998-01-01' AND o_orderstatus <> 'F' THEN 'EXCEPTION_EXPIRED_ACTIVE' WHEN o_orderpriority = '' THEN 'EXCEPTION_MISSING_OWNER' END AS code FROM (SELECT *, CAST(o_orderdate AS DATE) + 180 AS expires FROM orders) WHERE (expires < DATE '1998-01-01' AND o_orderstatus <> 'F') OR o_orderpriority = ''""")
def exceptions_expired(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("active").alias("status"), F.date_add(F.col("o_orderdate").cast("date"), 180).alias("expires_at"))
    return gt.exception_findings(rows, "1998-01-01").select("id", "code")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), p(id, pattern) AS (VALUES ('license', '(?i)licen[sc]e'), ('secret', '(?i)(password|token)\s*='), ('card', '[0-9]{16}'))
SELECT doc_id, n AS line_no, id FROM l JOIN p ON regexp_matches(line, pattern) WHERE NOT regexp_matches(line, '(?i)example')""")
def claims_scan(spark, d):
    return gt.claims(table(spark, d, "documents"), {"license": "(?i)licen[sc]e", "secret": r"(?i)(password|token)\s*=", "card": "[0-9]{16}"}, exclude="(?i)example")


@query("""WITH t AS (SELECT lower(unnest(regexp_extract_all(p_name, '[A-Za-z]+'))) AS token, p_partkey FROM part), x(alias, canonical, status) AS (SELECT DISTINCT lower(split_part(p_type, ' ', 1)), lower(split_part(p_type, ' ', 1)), 'canonical' FROM part)
SELECT token, coalesce(status, 'ungoverned') AS status, coalesce(canonical, '') AS canonical, count(*) AS uses FROM t LEFT JOIN x ON token = alias GROUP BY ALL""")
def lexicon_check(spark, d):
    p = table(spark, d, "part")
    words = p.select(F.explode(F.transform(F.regexp_extract_all("p_name", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("token"))
    terms = p.select(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("alias")).distinct().select("alias", F.col("alias").alias("canonical"), F.lit("canonical").alias("status"))
    return gt.lexicon_usage(words, terms)


@query("""WITH c AS (SELECT doc_id, lang <> 'de' AS in_scope, doc_id % 17 = 0 AS repealed, doc_id % 7 = 0 AS stale, CASE WHEN doc_id % 3 = 0 THEN 'low' WHEN doc_id % 3 = 1 THEN 'medium' ELSE 'high' END AS confidence FROM documents)
SELECT doc_id, CASE WHEN NOT in_scope THEN 'refuse' WHEN repealed THEN 'refuse' WHEN stale THEN 'disclaim' WHEN confidence = 'low' THEN 'escalate' WHEN confidence = 'high' THEN 'assert' WHEN confidence = 'medium' THEN 'cite' ELSE 'disclaim' END AS action FROM c""")
def posture_decision(spark, d):
    c = table(spark, d, "documents").select("doc_id", (F.col("lang") != "de").alias("in_scope"), (F.col("doc_id") % 17 == 0).alias("repealed"), (F.col("doc_id") % 7 == 0).alias("stale"), F.when(F.col("doc_id") % 3 == 0, "low").when(F.col("doc_id") % 3 == 1, "medium").otherwise("high").alias("confidence"))
    rules = [(30, "stale", "disclaim"), (10, "not in_scope", "refuse"), (20, "repealed", "refuse"), (40, "confidence = 'low'", "escalate"), (50, "confidence = 'high'", "assert"), (60, "confidence = 'medium'", "cite")]
    return c.select("doc_id", gt.posture(rules).alias("action"))


@query("""WITH s AS (SELECT doc_id, (text <> '')::INT * 0.5 + (lang IS NOT NULL)::INT * 0.25 + (source IS NOT NULL)::INT * 0.25 AS completeness, CASE WHEN length(text) >= 200 THEN 1.0 ELSE 0.5 END AS coherence, CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS source_coverage, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS role_coverage FROM documents),
o AS (SELECT doc_id, round((0.30 * completeness + 0.25 * coherence + 0.25 * source_coverage + 0.20 * role_coverage)::DOUBLE, 4) AS score FROM s) SELECT CASE WHEN score >= 0.9 THEN 'A' WHEN score >= 0.75 THEN 'B' WHEN score >= 0.6 THEN 'C' WHEN score >= 0.4 THEN 'D' ELSE 'F' END AS grade, count(*) AS atoms, round(avg(score), 4) AS mean_score FROM o GROUP BY ALL""")
def atom_scores(spark, d):
    n = lambda c: c.cast("int")
    s = table(spark, d, "documents").select("doc_id", (n(F.col("text") != "") * 0.5 + n(F.col("lang").isNotNull()) * 0.25 + n(F.col("source").isNotNull()) * 0.25).alias("completeness"), F.when(F.length("text") >= 200, 1.0).otherwise(0.5).alias("coherence"), F.when(F.col("doc_id") % 5 == 0, 0.0).otherwise(1.0).alias("source_coverage"), F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.0).alias("role_coverage"))
    s = s.withColumn("score", F.round(gt.weighted({"completeness": 0.30, "coherence": 0.25, "source_coverage": 0.25, "role_coverage": 0.20}), 4))
    return s.groupBy(gt.grade(F.col("score")).alias("grade")).agg(F.count(F.lit(1)).alias("atoms"), F.round(F.avg("score"), 4).alias("mean_score"))


@query("""WITH c AS (SELECT event_type, CASE WHEN event_id % 11 = 0 THEN 'skipped' ELSE 'run' END AS status, least(1.0, greatest(0.0, value / 100)) AS score, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 3 END AS weight FROM events)
SELECT event_type, round(coalesce(sum(score * CASE WHEN weight <= 0 THEN 1 ELSE weight END) FILTER (status <> 'skipped') / sum(CASE WHEN weight <= 0 THEN 1 ELSE weight END) FILTER (status <> 'skipped'), 1.0), 4) AS score, count_if(status <> 'skipped') AS checks FROM c GROUP BY event_type""")
def integrated_gate(spark, d):
    c = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 11 == 0, "skipped").otherwise("run").alias("status"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("score"), (F.col("event_id") % 3).alias("weight"))
    return gt.dimension_scores(c, "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return tm.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")


@query("""WITH l AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) < 43200 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def event_sessions(spark, d):
    return tm.sessions(table(spark, d, "events"), "user_id", "ts", "12 hours")


@query("""WITH g AS (SELECT doc_id, quality FROM labels), p AS (SELECT doc_id, length(text) >= 500 AS produced FROM documents WHERE doc_id % 6 <> 0)
SELECT CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN g.doc_id IS NULL THEN 'extra' WHEN (g.quality = 1) = p.produced THEN 'matched' ELSE 'partial' END AS outcome, count(*) AS atoms FROM g FULL JOIN p ON g.doc_id = p.doc_id GROUP BY ALL""")
def gold_regression(spark, d):
    gold = table(spark, d, "labels").select(F.col("doc_id").alias("key"), (F.col("quality") == 1).alias("expected"))
    made = table(spark, d, "documents").where("doc_id % 6 <> 0").select(F.col("doc_id").alias("key"), (F.length("text") >= 500).alias("actual"))
    return gt.regression(gold, made).groupBy("outcome").agg(F.count(F.lit(1)).alias("atoms"))


@query("""WITH r AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0), c AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_quantity > 45) SELECT coalesce(r.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'missing' WHEN r.id IS NULL THEN 'unrequested' ELSE 'present' END AS status FROM r FULL JOIN c ON r.id = c.id""")
def evidence_manifest(spark, d):
    required = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"))
    collected = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("id")).distinct()
    return gt.evidence_status(required, collected)
