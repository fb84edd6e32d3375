"""Queries on governance joins and certification gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import governance as gv
from ledgerline.operators.quality import STOP_LABELS

from .corpus import LINES, _kinds, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH e AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0) SELECT CAST(doc_id AS VARCHAR) AS path, 1 AS line, coalesce(quality = 1, false) AS qualified,
 CASE WHEN quality = 1 THEN '' WHEN quality = 0 THEN 'owner' ELSE 'intended_use,owner' END AS missing FROM documents LEFT JOIN e USING (doc_id)""")
def governed_claims(spark, d):
    claims = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line"))
    evidence = table(spark, d, "labels").where("doc_id % 3 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("line"), F.lit("use").alias("intended_use"), F.when(F.col("quality") == 1, "x").otherwise(" ").alias("owner"))
    return gv.govern_claims(claims, evidence, ("intended_use", "owner"))


@query("""WITH c AS (SELECT url AS ref, 'f' || page_id % 7 AS file, page_id AS line FROM pages), k AS (SELECT lower(trim(ref)) AS key_, file, min((line, ref)) AS m FROM c GROUP BY ALL),
r AS (SELECT DISTINCT lower(url) AS key_, CASE WHEN length(url) % 3 = 0 THEN '' ELSE 'ok' END AS status, CASE WHEN length(url) % 4 = 0 THEN NULL WHEN length(url) % 4 = 1 THEN DATE '2024-01-01' ELSE DATE '2026-01-01' END AS checked FROM pages WHERE length(url) % 5 <> 0),
j AS (SELECT m[2] AS ref, file, m[1] AS line, r.key_ IS NOT NULL AS known, status, checked FROM k LEFT JOIN r USING (key_))
SELECT ref, file, line, 'ref_not_governed' AS code, 'error' AS severity FROM j WHERE NOT known UNION ALL SELECT ref, file, line, 'ref_missing_evidence_status', 'error' FROM j WHERE known AND status = '' UNION ALL SELECT ref, file, line, 'ref_missing_review_date', 'warning' FROM j WHERE known AND checked IS NULL
UNION ALL SELECT ref, file, line, 'ref_review_stale', 'warning' FROM j WHERE known AND date_diff('day', checked, DATE '2026-06-01') > 365""")
def reference_alignment(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.length("url").alias("n"))
    register = p.where("n % 5 <> 0").select(F.col("url").alias("ref"), F.when(F.col("n") % 3 == 0, "").otherwise("ok").alias("evidence_status"), F.when(F.col("n") % 4 == 1, F.lit("2024-01-01")).when(F.col("n") % 4 > 1, F.lit("2026-01-01")).cast("date").alias("checked_on"))
    register = register.select(F.lower("ref").alias("ref"), "evidence_status", "checked_on").distinct()
    return gv.alignment_findings(p.select(F.col("url").alias("ref"), F.concat(F.lit("f"), F.col("page_id") % 7).alias("file"), F.col("page_id").alias("line")), register, "2026-06-01")


@query("""WITH m AS (SELECT p_partkey, p_partkey - p_partkey % 50 // 49 AS atom_id, p_size FROM part), t AS (SELECT atom_id FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT m.atom_id, CASE WHEN t.atom_id IS NOT NULL THEN 'mapped_twice' WHEN p_partkey % 7 = 0 THEN 'unapproved' WHEN m.atom_id % 11 = 0 THEN 'atom_absent' WHEN m.atom_id % 13 = 0 THEN 'unapproved_in_set' WHEN p_partkey % 17 = 0 THEN 'hash_differs' WHEN p_partkey % 19 = 0 THEN 'field_drift' WHEN p_partkey % 23 = 0 THEN 'no_check' END AS refusal
FROM m LEFT JOIN t USING (atom_id) WHERE refusal IS NOT NULL""")
def mapping_refusals(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part")
    mapping = p.select((k - F.when(k % 50 == 49, 1).otherwise(0)).alias("atom_id"), F.when(k % 7 == 0, "draft").otherwise("approved").alias("state"), F.when(k % 17 == 0, "sha256:0").otherwise(F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256))).alias("content_hash"), F.when(k % 19 == 0, "other").otherwise("x").alias("domain"), F.when(k % 23 == 0, 0).otherwise(1).alias("checks"))
    atoms = p.where("p_partkey % 11 <> 0").select(k.alias("atom_id"), F.when(k % 13 == 0, "draft").otherwise("approved").alias("state"), F.concat(F.lit("sha256:"), F.sha2(F.lit("x"), 256)).alias("content_hash"), F.lit("x").alias("domain"))
    return gv.mapping_refusals(mapping, atoms, ["domain"])


@query(r"""WITH r AS (SELECT doc_id, text, quality, toxic, greatest(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) * 1.33), 1)::BIGINT AS tokens FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id AS atom_id, 'rag-' || doc_id AS chunk_id, CASE quality WHEN 1 THEN 'approved' ELSE 'draft' END AS review_state, CASE WHEN quality IS NULL THEN 'unassigned' ELSE 'team' END AS owner, CASE WHEN quality = 0 THEN '1.1.0' ELSE '0.0.0' END AS version, CASE WHEN doc_id % 4 = 0 THEN 'unknown' ELSE 'law' END AS domain, tokens,
 doc_id % 9 <> 0 AND coalesce(toxic, 0) <> 1 AND tokens BETWEEN 10 AND 512 AS embeddable, array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'hash' END, CASE WHEN toxic = 1 THEN 'confidentiality' END, CASE WHEN tokens < 10 THEN 'too_short' END, CASE WHEN tokens > 512 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS gates FROM r""")
def governed_projection(spark, d):
    k = F.col("doc_id")
    atoms = table(spark, d, "documents").select(k.alias("atom_id"), "text", F.when(k % 9 == 0, "").otherwise(F.sha2("text", 256)).alias("content_hash"), F.when(k % 4 == 0, " ").otherwise("law").alias("domain"))
    tags = table(spark, d, "labels").select(k.alias("atom_id"), F.when(F.col("quality") == 1, "approved").alias("review_state"), F.lit("team").alias("owner"), F.when(F.col("quality") == 0, "1.1.0").alias("version"), F.when(F.col("toxic") == 1, "secret").otherwise("public").alias("confidentiality"))
    return gv.project_governed(atoms, tags)


@query(f"""WITH {LINES}, a AS (SELECT doc_id, count(*) AS atoms, count_if(trim(line) = '') AS empty, count_if(strlen(line) = 0) AS spanless, bool_or(doc_id % 8 = 0 AND line_no = 1) AS twice FROM kinds GROUP BY doc_id), s AS (SELECT doc_id, strlen(text) AS total, CASE WHEN doc_id % 6 = 0 THEN strlen(text) * 9 // 10 ELSE strlen(text) END AS covered FROM documents),
f AS (SELECT *, list_filter([CASE WHEN covered / total::DOUBLE * 100 < 95 THEN 'LOW_COVERAGE' END, CASE WHEN 1 - covered / total::DOUBLE > 0.05 THEN 'HIGH_LOSS' END, CASE WHEN twice THEN 'DUPLICATE_ID' END], lambda x: x IS NOT NULL) AS b, list_filter([CASE WHEN spanless > 0 THEN 'NO_SPAN' END, CASE WHEN empty > 0 THEN 'EMPTY_ATOM' END], lambda x: x IS NOT NULL) AS o FROM s JOIN a USING (doc_id) WHERE total > 0)
SELECT doc_id AS document, CASE WHEN len(b) > 0 THEN 'failed' WHEN len(o) > 0 THEN 'provisional' ELSE 'certified' END AS level, array_to_string(list_concat(b, o), ',') AS findings FROM f""")
def certification(spark, d):
    n = F.col("line_no")
    atoms = _kinds(spark, d).select(F.col("source").alias("document"), F.when((F.col("source") % 8 == 0) & (n == 1), 0).otherwise(n).alias("atom_id"), F.col("line").alias("text"), "start_byte", "end_byte")
    size = F.octet_length("text").cast("long")
    sources = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("document"), size.alias("total_bytes"), F.when(F.col("doc_id") % 6 == 0, F.floor(size * 9 / 10).cast("long")).otherwise(size).alias("covered_bytes"))
    return gv.certification(atoms, sources)


@query("SELECT avg(value) AS score, NOT bool_or(event_type = (SELECT min(event_type) FROM events) AND value < 1) AS passes, count_if(value < 1) AS failed FROM events")
def checks_gate(spark, d):
    e = table(spark, d, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("first_")))
    return gv.checks_gate(e.crossJoin(first).select(F.col("event_type").alias("category"), F.when(F.col("value") < 1, "failed").otherwise("passed").alias("status"), F.col("value").alias("score"), (F.col("event_type") == F.col("first_")).alias("blocking")))


@query("""WITH r AS (SELECT p_partkey AS id, p_size % 5 AS min_level, p_partkey % 40 = 0 AS critical FROM part), e AS (SELECT p_partkey AS id, p_retailprice > 1000 AS ok FROM part WHERE p_partkey % 3 <> 0), j AS (SELECT r.*, coalesce(ok, false) AS met FROM r LEFT JOIN e USING (id) WHERE min_level <= 3)
SELECT count_if(met) AS passed, count_if(NOT met) AS failed, count_if(NOT met AND critical) AS critical_failed, CASE WHEN count_if(NOT met AND critical) > 0 THEN 'fail' WHEN count_if(NOT met) > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS verdict FROM j""")
def level_gate(spark, d):
    p = table(spark, d, "part")
    need = p.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).alias("min_level"), (F.col("p_partkey") % 40 == 0).alias("critical"))
    return gv.level_gate(need, p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") > 1000).alias("satisfied")), 3)


@query(f"WITH {LINES} SELECT doc_id AS source, avg((kind = 'paragraph')::INT) AS ratio, avg((kind = 'paragraph')::INT) >= 0.8 AS proved FROM kinds GROUP BY doc_id")
def role_ratio_proof(spark, d):
    return gv.ratio_proof(_kinds(spark, d).select("source", (F.col("kind") == "paragraph").alias("typed")), "source", "typed", gv.ROLE_RATIO)


@query("""WITH d AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey % 5 <> 0), r AS (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(d.id, r.id) AS id, coalesce(n, 0) AS "references", d.id IS NOT NULL AS defined FROM d FULL JOIN r ON d.id = r.id""")
def definition_use(spark, d):
    return gv.definition_use(table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("id")), table(spark, d, "orders").select(F.col("o_custkey").alias("target")))


@query("""WITH p AS (SELECT DISTINCT lang || '/' || source || '/d' || doc_id AS path FROM documents), l AS (SELECT path FROM p WHERE NOT starts_with(path, 'fr/src2/'))
SELECT w AS workflow, CASE WHEN n > 0 THEN 'impacted' ELSE 'skipped' END AS status, n AS matched FROM (SELECT 'en' AS w, (SELECT count(*) FROM l WHERE starts_with(path, 'en/')) AS n UNION ALL SELECT 'two', (SELECT count(*) FROM l WHERE regexp_matches(path, '^(de/src1/|[^/]*/src4/)')) UNION ALL SELECT 'own', (SELECT count(*) FROM l WHERE starts_with(path, 'fr/src2/')))""")
def scoped_plan(spark, d):
    paths = table(spark, d, "documents").select(F.concat(F.lit("./"), F.concat_ws("/", "lang", "source", F.concat(F.lit("d"), "doc_id"))).alias("path"))
    return gv.scoped_plan(paths, [("en", ["en/**"], ""), ("two", ["de/src1/**", "*/src4/**"], ""), ("own", ["fr/src2/**"], "fr/src2")])


@query(rf"""WITH {LINES}, u AS (SELECT doc_id || ':' || line_no AS unit_id, CASE line_no % 4 WHEN 1 THEN 'table_row' WHEN 2 THEN 'yaml_scalar' ELSE 'single_atom' END AS strategy, trim(CASE line_no % 4 WHEN 1 THEN 'a: ' || line || '; b: ' || kind WHEN 2 THEN 'x.y: ' || line ELSE line END) AS body, CASE WHEN line_no % 2 = 0 THEN 'h' END AS heading FROM kinds WHERE line_no % 9 <> 8)
SELECT unit_id, strategy, CAST(length(body) AS BIGINT) AS body_chars, sha256(CASE WHEN heading IS NULL THEN body ELSE heading || chr(10) || chr(10) || body END) AS chunk_hash,
 CASE WHEN lower(body) IN ('champ','valeur','statut','status','version','field','value','key','name','date','id') THEN 'RAG_CHUNK_STOP_LABEL' WHEN len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) < 3 THEN 'RAG_CHUNK_BELOW_TOKEN_MIN' WHEN length(body) < 20 THEN 'RAG_CHUNK_BELOW_CHAR_MIN' END AS rejection FROM u""")
def composed_chunks(spark, d):
    n = F.col("line_no") % 4
    none = F.array().cast("array<string>")
    units = _kinds(spark, d).select(
        F.concat_ws(":", "source", "line_no").alias("unit_id"), F.when(F.col("line_no") % 9 == 8, "").otherwise("s").alias("source_segment_id"), F.col("line").alias("text"), F.when(F.col("line_no") % 2 == 0, "h").alias("heading"),
        F.array(F.lit("a"), F.lit("b")).alias("columns"), F.when(n == 1, F.array("line", "kind")).otherwise(none).alias("row_values"), F.when(n == 2, "x.y").alias("key_path"),
    )
    return gv.compose_chunks(units, 3, 20, STOP_LABELS)


@query("SELECT 'o' || l_orderkey AS segment_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_orderkey || '/' || l_linenumber) AS INTEGER) AS position, l_orderkey || '/' || l_linenumber AS child_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def segment_children(spark, d):
    kids = table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("segment_id"), F.concat(F.lit("o"), "l_orderkey").alias("parent_id"), F.col("l_partkey").alias("start_byte"))
    roots = table(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("segment_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("start_byte"))
    return gv.child_lists(kids.unionByName(roots))


@query(f"""WITH {LINES}, e AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 5 THEN -1 ELSE doc_id END AS source, CASE WHEN line_no % 5 = 4 THEN -2 ELSE doc_id END AS target, CASE WHEN line_no % 7 = 6 THEN line || '?' ELSE line END <> line AS differs FROM kinds)
SELECT source, target, CASE WHEN source = -1 THEN 'unknown_source' WHEN target = -2 THEN 'unknown_target' ELSE 'bytes_differ' END AS fault FROM e WHERE source = -1 OR target = -2 OR differs""")
def crossref_faults(spark, d):
    n = F.col("line_no")
    edges = _kinds(spark, d).select(F.when(n % 6 == 5, F.lit(-1)).otherwise(F.col("source")).cast("long").alias("from_"), F.when(n % 5 == 4, F.lit(-2)).otherwise(F.col("source")).cast("long").alias("target"), "start_byte", "end_byte", F.when(n % 7 == 6, F.concat("line", F.lit("?"))).otherwise(F.col("line")).alias("locator"))
    return gv.crossref_faults(edges.withColumnRenamed("from_", "source"), table(spark, d, "documents").select(F.col("doc_id").alias("atom_id"), "text"))


@query("""WITH n AS (SELECT CASE WHEN c_custkey % 60 = 0 THEN 0 ELSE c_custkey END AS node_id, c_custkey % 21 = 0 AS bad FROM customer)
SELECT node_id AS id, 'duplicate_node_id' AS code FROM n GROUP BY node_id HAVING count(*) > 1 UNION ALL SELECT node_id, 'bad_content_hash' FROM n WHERE bad UNION ALL SELECT o_custkey, 'unknown_node' FROM orders WHERE o_custkey NOT IN (SELECT node_id FROM n)""")
def bundle_findings(spark, d):
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(F.when(k % 60 == 0, F.lit(0)).otherwise(k).cast("long").alias("node_id"), F.when(k % 21 == 0, "md5:1").otherwise(F.concat(F.lit("sha256:"), F.sha2("c_name", 256))).alias("content_hash"))
    return gv.bundle_findings(nodes, table(spark, d, "orders").select(F.col("o_custkey").alias("node_id")))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 10 = 1 THEN 'unregistered' ELSE 'changed' END AS code FROM documents WHERE doc_id % 10 IN (0, 1) OR doc_id % 10 = 2""")
def ledger_differences(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    return gv.file_differences(docs.where("doc_id % 10 <> 1"), docs.where("doc_id % 10 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 2, "other").otherwise(F.col("sha256"))))


@query("WITH t AS (SELECT DISTINCT lower(trim(p_brand)) AS term, p_size % 3 AS axis FROM part) SELECT term, count(*) AS axes FROM t GROUP BY term HAVING count(*) > 1")
def shared_terms(spark, d):
    return gv.shared_terms(table(spark, d, "part").select((F.col("p_size") % 3).alias("axis"), F.concat(F.lit(" "), "p_brand").alias("term")))


@query(f"WITH {LINES} SELECT doc_id AS parent, CAST(line_no AS BIGINT) AS position, kind AS role, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS previous_role, lead(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS next_role FROM kinds")
def sibling_roles(spark, d):
    return gv.neighbours(_kinds(spark, d).select(F.col("source").alias("parent"), F.col("line_no").alias("position"), F.col("kind").alias("role")))


@query(f"""WITH {LINES} SELECT doc_id AS source, count_if(kind = 'table') AS "table", count_if(kind = 'code') AS code, count_if(kind = 'list_item') AS list_item, count_if(kind = 'quote') AS quote FROM kinds GROUP BY doc_id""")
def typed_block_counts(spark, d):
    return gv.typed_counts(_kinds(spark, d), "source", ("table", "code", "list_item", "quote"))


@query("""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(html, 'href="[^"]*"'), lambda x, i: CASE WHEN list_position(regexp_extract_all(html, 'href="[^"]*"'), x) = i THEN x END), lambda x: x IS NOT NULL), ' ') AS refs FROM pages""")
def extracted_references(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(gv.references_in(F.col("html"), 'href="[^"]*"'), " ").alias("refs"))


@query("""WITH a AS (SELECT o_custkey AS item, o_orderpriority AS kind, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 END) AS approvals, count_if(o_orderstatus = 'P') AS rejections FROM orders GROUP BY ALL)
SELECT item, kind, approvals, rejections > 0 OR approvals < CASE kind WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 2 ELSE 1 END AS open FROM a""")
def review_verdicts(spark, d):
    decision = F.when(F.col("o_orderstatus") == "F", "approved").when(F.col("o_orderstatus") == "P", "rejected").otherwise("pending")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 3).alias("reviewer"), decision.alias("decision"))
    return gv.review_verdicts(rows, {"1-URGENT": 2, "2-HIGH": 2})
