"""Queries on encoded records, referential checks, admission, cross references, tables, envelopes and bills of materials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import records as rc
from ledgerline.operators.gates import RANK

from .corpus import _kinds, _records, LINES, RECORDS, qu, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _encoded(spark, d, shape):
    rec = qu.export_records(_records(spark, d)).withColumn("tag", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source_id")))
    return rc.encode(rec, shape, "body_hash", "chunk_id", ["lang", "tag"])


TAGGED = RECORDS + ", t AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '\"tag\":\"' || source_id || '\"' END AS tag FROM records)"


@query(f"""WITH {TAGGED} SELECT '{{"chunk_id":"' || chunk_id || '","body_hash":"' || body_hash || '","lang":"' || lang || '"' || coalesce(',' || tag, '') || '}}' AS value FROM t""")
def rag_encode_neutral(spark, d):
    return _encoded(spark, d, "neutral")


@query(f"""WITH {TAGGED} SELECT '{{"page_content":"' || body_hash || '","metadata":{{"chunk_id":"' || chunk_id || '","lang":"' || lang || '"' || coalesce(',' || tag, '') || '}}}}' AS value FROM t""")
def rag_encode_document(spark, d):
    return _encoded(spark, d, "document")


@query(f"""WITH {TAGGED} SELECT '{{"id_":"' || chunk_id || '","text":"' || body_hash || '","metadata":{{"lang":"' || lang || '"' || coalesce(',' || tag, '') || '}}}}' AS value FROM t""")
def rag_encode_node(spark, d):
    return _encoded(spark, d, "node")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), p AS (SELECT p_partkey FROM part WHERE p_size <> 7), o AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
SELECT l_orderkey || '/' || l_linenumber AS id, 'DANGLING_PART' AS code FROM l ANTI JOIN p ON l_partkey = p_partkey UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'DANGLING_ORDER' FROM l ANTI JOIN o ON l_orderkey = o_orderkey
UNION ALL SELECT l_orderkey || '/' || l_linenumber, 'DUPLICATE_ID' FROM l GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def strict_references(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts, orders = table(spark, d, "part").where("p_size <> 7").select("p_partkey"), table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey")
    return rc.referential_findings(rows, ["l_orderkey", "l_linenumber"], [("DANGLING_PART", ["l_partkey"], parts), ("DANGLING_ORDER", ["l_orderkey"], orders)])


@query(r"""WITH a AS (SELECT p_partkey AS atom_id, 'Article ' || (p_partkey % 60) AS locator, p_name || ' see article  ' || (p_size + 30) || ', Section ' || p_size AS text FROM part), h AS (SELECT DISTINCT atom_id AS source, regexp_replace(lower(unnest(regexp_extract_all(text, '(?i)((?:article|section|annex)\s+[0-9]+)', 1))), '\s+', '-', 'g') AS locator FROM a),
f AS (SELECT regexp_replace(lower(locator), '\s+', '-', 'g') AS locator, min(atom_id) AS target FROM a GROUP BY 1) SELECT h.locator, h.source, f.target FROM h LEFT JOIN f USING (locator) WHERE f.target IS NULL OR f.target <> h.source""")
def crossref_edges(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("atom_id"), F.concat(F.lit("Article "), F.col("p_partkey") % 60).alias("locator"), F.concat("p_name", F.lit(" see article  "), F.col("p_size") + 30, F.lit(", Section "), "p_size").alias("text"))
    return rc.cross_references(a, "text")


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line_no, list_transform(string_split(regexp_replace(trim(line), '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)) AS cells FROM kinds WHERE kind = 'table')
SELECT doc_id AS source, CAST(line_no AS BIGINT) AS line_no, len(cells) AS cells, array_to_string(list_filter([CASE WHEN cells[1] <> '' THEN 'a=' || cells[1] END, CASE WHEN cells[2] <> '' THEN 'b=' || cells[2] END], lambda x: x IS NOT NULL), '; ') AS row_text FROM c""")
def table_rows(spark, d):
    c = _kinds(spark, d).where("kind = 'table'").withColumn("cells", rc.row_cells(F.col("line")))
    return c.select("source", "line_no", F.size("cells").cast("long").alias("cells"), rc.row_text(F.array(F.lit("a"), F.lit("b")), F.slice("cells", 1, 2)).alias("row_text"))


@query("SELECT source, count(*) AS members, sha256(string_agg(doc_id || ':' || sha256(text), ';' ORDER BY doc_id)) AS envelope_hash FROM documents GROUP BY source")
def evidence_envelopes(spark, d):
    return rc.envelope(table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("content_hash")), "source", "doc_id")


@query("""SELECT p_brand, '{"specVersion":"1.5","components":[' || string_agg('{"name":"' || p_partkey || '","version":"' || p_size || '","hash":"' || sha256(p_name) || '"}', ',' ORDER BY CAST(p_partkey AS VARCHAR)) || ']}' AS bom FROM part GROUP BY p_brand""")
def evidence_bom(spark, d):
    return rc.bill_of_materials(table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("string").alias("version"), F.sha2("p_name", 256).alias("hash")), "p_brand")


@query("""WITH c AS (SELECT item_id, text AS a, substr(text, 20) AS b FROM benchmark), k AS (SELECT item_id, any_value(strlen(a)) AS la, any_value(strlen(b)) AS lb, sum(least(length(a) - length(replace(a, ch, '')), length(b) - length(replace(b, ch, '')))) AS shared FROM (SELECT *, unnest(list_distinct(string_split(a, ''))) AS ch FROM c) WHERE ch <> '' GROUP BY item_id)
SELECT item_id, round(shared / greatest(la, lb)::DOUBLE, 4) AS similarity FROM k""")
def round_trip_similarity(spark, d):
    return table(spark, d, "benchmark").select("item_id", rc.similarity(F.col("text"), F.expr("substr(text, 20)")).alias("similarity"))


@query("""WITH f AS (SELECT event_id, event_type AS code, CASE WHEN value > 75 THEN 'critical' WHEN value > 50 THEN 'high' WHEN value > 25 THEN 'medium' ELSE 'low' END AS severity FROM events) SELECT code, severity, count(*) AS findings FROM f WHERE severity IN ('critical', 'high') AND code IN (SELECT min(event_type) FROM events UNION SELECT max(event_type) FROM events) GROUP BY ALL""")
def findings_filter(spark, d):
    e = table(spark, d, "events")
    ends = e.agg(F.array(F.min("event_type"), F.max("event_type")).alias("t")).select(F.explode("t").alias("code")).distinct()  # two rows
    severity = F.when(F.col("value") > 75, "critical").when(F.col("value") > 50, "high").when(F.col("value") > 25, "medium").otherwise("low")
    return e.select(F.col("event_type").alias("code"), severity.alias("severity")).where(F.col("severity").isin(*[k for k, v in RANK.items() if v >= 3])).join(F.broadcast(ends), "code", "left_semi").groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 3 WHEN c_acctbal > 0 THEN 2 ELSE 1 END AS level, c_mktsegment AS source FROM customer) SELECT source, min(level) AS achieved, count_if(level = 3) AS verified, bool_and(level >= 2) AS meets_minimum FROM s GROUP BY source""")
def provenance_gate(spark, d):
    level = F.when(F.col("c_acctbal") > 5000, 3).when(F.col("c_acctbal") > 0, 2).otherwise(1)
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), level.alias("level")).groupBy("source").agg(F.min("level").alias("achieved"), F.count_if(F.col("level") == 3).alias("verified"), F.bool_and(F.col("level") >= 2).alias("meets_minimum"))


@query("""WITH d AS (SELECT DISTINCT lower(p_type) AS term FROM part WHERE p_size > 25), u AS (SELECT DISTINCT lower(p_type) AS term FROM part) SELECT u.term, d.term IS NULL AS undefined FROM u LEFT JOIN d USING (term)""")
def governed_terms(spark, d):
    p = table(spark, d, "part")
    defined = p.where("p_size > 25").select(F.lower("p_type").alias("term")).distinct().withColumn("known", F.lit(True))
    return p.select(F.lower("p_type").alias("term")).distinct().join(defined, "term", "left").select("term", F.col("known").isNull().alias("undefined"))


@query("""WITH u AS (SELECT path FROM (SELECT lang || '/' || doc_id AS path FROM documents WHERE doc_id % 4 = 0) UNION SELECT lang || '/' || doc_id FROM documents WHERE doc_id % 6 = 0 UNION SELECT source || '/' || doc_id FROM documents WHERE doc_id % 10 = 0) SELECT path FROM u""")
def changed_paths(spark, d):
    p = table(spark, d, "documents")
    at = lambda c, n: p.where(f"doc_id % {n} = 0").select(F.concat_ws("/", c, "doc_id").alias("path"))
    return at("lang", 4).unionByName(at("lang", 6)).unionByName(at("source", 10)).distinct()
