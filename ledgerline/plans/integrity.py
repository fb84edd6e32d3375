"""Queries on the integrity of segment ledgers and feeds, on selections of chunks and texts, and on audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.text import once
from ledgerline.operators import audit as au
from ledgerline.operators import integrity as ig
from ledgerline.operators import selection as sl

from .corpus import _kinds, files, FILES, LINES, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- ledgers with faults ------------------------------------------------------------------------------------------------

SEGMENTS = f"""{LINES}, all_ AS (SELECT doc_id || ':' || line_no AS segment_id, CAST(doc_id AS VARCHAR) AS source_id, line_no, kind, line AS text, start_byte, start_byte + strlen(line) + 1 AS end_byte,
  CASE WHEN line_no % 50 = 49 THEN 'unsupported_blocking' WHEN kind = 'blank' THEN 'coverage_only' WHEN kind = 'heading' THEN 'structure_only' ELSE 'canonical_atom' END AS disposition,
  line_no + 1 AS start_line, CASE WHEN line_no % 47 = 46 THEN line_no ELSE line_no + 1 END AS end_line, CASE WHEN line_no % 43 = 42 THEN '' ELSE sha256(line) END AS raw_text_hash FROM kinds),
seg AS (SELECT * FROM all_ WHERE line_no % 37 <> 36 UNION ALL SELECT * REPLACE (segment_id || 'd' AS segment_id) FROM all_ WHERE line_no % 41 = 40),
src AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, strlen(text) + 1 AS total FROM documents)"""
JUNK = r"regexp_full_match({}, '[-_*~|.,;:!?()\[\]{{}}<>+=`\s]*')"


def _segments(spark, d):
    n = F.col("line_no")
    disposition = F.when(n % 50 == 49, "unsupported_blocking").otherwise(once(F.col("kind"), lambda k: F.when(k == "blank", "coverage_only").when(k == "heading", "structure_only").otherwise("canonical_atom")))
    rows = _kinds(spark, d).select(
        F.concat_ws(":", "source", "line_no").alias("segment_id"), F.col("source").cast("string").alias("source_id"), F.lit("p").alias("source_path"), "line_no", "kind", F.col("line").alias("text"), "start_byte", (F.col("end_byte") + 1).alias("end_byte"), disposition.alias("disposition"),
        (n + 1).alias("start_line"), F.when(n % 47 == 46, n).otherwise(n + 1).alias("end_line"), F.lit(0).alias("start_column"), F.lit(0).alias("end_column"), F.when(n % 43 == 42, "").otherwise(F.col("line_hash")).alias("raw_text_hash"), F.col("line_hash").alias("normalized_text_hash"), F.lit("").alias("unsupported_reason"),
    )
    copies = F.array_compact(F.array(F.when(n % 37 != 36, ""), F.when(n % 41 == 40, "d")))  # lines are cut once for both
    return rows.withColumn("copy_", F.explode(copies)).withColumn("segment_id", F.concat("segment_id", "copy_")).drop("copy_")


def _sources(spark, d):
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("source_id"), (F.octet_length("text") + 1).cast("long").alias("total_bytes"))


INTEGRITY = f"""{SEGMENTS}, spans AS (SELECT source_id, start_byte, end_byte FROM seg UNION ALL SELECT source_id, 0, 0 FROM src UNION ALL SELECT source_id, total, total FROM src),
reach AS (SELECT *, max(end_byte) OVER (PARTITION BY source_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
first_ AS (SELECT source_id, start_byte, end_byte, min(segment_id) AS f FROM seg WHERE disposition = 'canonical_atom' GROUP BY ALL HAVING count(*) > 1),
found AS (SELECT source_id, segment_id, 'SOURCE_SEGMENT_INVALID_RANGE' AS code, start_byte, end_byte FROM seg WHERE start_line > end_line
 UNION ALL SELECT source_id, segment_id, 'SOURCE_SEGMENT_MISSING_HASH', start_byte, end_byte FROM seg WHERE disposition = 'canonical_atom' AND raw_text_hash = ''
 UNION ALL SELECT source_id, segment_id, 'SOURCE_UNSUPPORTED_BLOCKING', start_byte, end_byte FROM seg WHERE disposition = 'unsupported_blocking'
 UNION ALL SELECT source_id, segment_id, 'SOURCE_JUNK_SEMANTIC_ATOM', start_byte, end_byte FROM seg WHERE disposition = 'canonical_atom' AND {JUNK.format('text')}
 UNION ALL SELECT source_id, segment_id, 'SOURCE_DUPLICATE_SEMANTIC_SPAN', start_byte, end_byte FROM seg JOIN first_ USING (source_id, start_byte, end_byte) WHERE disposition = 'canonical_atom' AND segment_id <> f
 UNION ALL SELECT source_id, '', 'SOURCE_UNCOVERED_RANGE', reach, start_byte FROM reach WHERE start_byte > reach)"""


@query(f"WITH {INTEGRITY} SELECT source_id, segment_id, code, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte FROM found")
def source_integrity(spark, d):
    return ig.source_integrity(_segments(spark, d), _sources(spark, d))


@query(f"WITH {INTEGRITY} SELECT count(*) AS findings, CASE WHEN count(*) = 0 THEN 'pass' ELSE 'fail' END AS status FROM found")
def source_integrity_status(spark, d):
    return ig.gate_status(ig.source_integrity(_segments(spark, d), _sources(spark, d)))


@query(f"""WITH {SEGMENTS} SELECT segment_id, CASE WHEN start_line > end_line THEN 'start_line must be <= end_line' WHEN disposition = 'unsupported_blocking' THEN 'unsupported_reason must be non-empty' ELSE 'raw_text_hash must be non-empty' END AS error
FROM seg WHERE start_line > end_line OR disposition = 'unsupported_blocking' OR (disposition = 'canonical_atom' AND raw_text_hash = '')""")
def segment_errors(spark, d):
    return _segments(spark, d).select("segment_id", ig.segment_error().alias("error")).where("error is not null")


UNITS = f"""{SEGMENTS}, one AS (SELECT segment_id AS unit_id, CASE WHEN line_no % 11 = 10 THEN '' ELSE segment_id END AS source_segment_id, CASE WHEN line_no % 13 = 12 THEN '' ELSE source_id END AS source_id, CASE WHEN line_no % 17 = 16 THEN 0 ELSE start_byte END AS start_byte,
 CASE WHEN line_no % 17 = 16 THEN 0 ELSE end_byte END AS end_byte, CASE WHEN line_no % 19 = 18 THEN '  ' WHEN line_no % 23 = 22 THEN '|---|' ELSE text END AS text, line_no FROM all_ WHERE kind <> 'blank'),
units AS (SELECT * FROM one UNION ALL SELECT * REPLACE (unit_id || 'd' AS unit_id) FROM one WHERE line_no % 41 = 40)"""


def _units(spark, d):
    n = F.col("line_no")
    bare = n % 17 == 16
    rows = _kinds(spark, d).where("kind <> 'blank'").select(
        F.concat_ws(":", "source", "line_no").alias("unit_id"), F.when(n % 11 == 10, "").otherwise(F.concat_ws(":", "source", "line_no")).alias("source_segment_id"), F.when(n % 13 == 12, "").otherwise(F.col("source").cast("string")).alias("source_id"), F.lit("p").alias("source_path"), F.col("line_hash").alias("normalized_text_hash"),
        F.when(bare, 0).otherwise(F.col("start_byte")).alias("start_byte"), F.when(bare, 0).otherwise(F.col("end_byte") + 1).alias("end_byte"), F.lit(None).cast("array<string>").alias("heading_path"), F.when(n % 19 == 18, "  ").when(n % 23 == 22, "|---|").otherwise(F.col("line")).alias("text"), "line_no",
    )
    more = rows.where("line_no % 41 = 40").withColumn("unit_id", F.concat("unit_id", F.lit("d")))
    plain = table(spark, d, "nation").select(F.concat(F.lit("m"), "n_nationkey").alias("unit_id"), *(F.lit("").alias(c) for c in ("source_segment_id", "source_id", "source_path", "normalized_text_hash", "text")), *(F.lit(0).cast("long").alias(c) for c in ("start_byte", "end_byte", "line_no")), F.lit(None).cast("array<string>").alias("heading_path"))
    return rows.unionByName(more).unionByName(plain)


def _chunks(spark, d):
    n = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.concat(F.lit("c"), n).alias("chunk_id"), F.when(n % 5 == 0, "").otherwise("u").alias("canonical_unit_id"), F.when(n % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("u"))).alias("unit_ids"),
        F.when(n % 7 == 0, " ").when(n % 7 == 1, "none").otherwise(F.concat(n, F.lit(":0"))).alias("source_segment_id"),
    )


CHUNKS = """chunks AS (SELECT 'c' || doc_id AS id, doc_id % 10 = 0 AS no_unit, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN 'none' ELSE doc_id || ':0' END AS asked FROM documents),
chunk_found AS (SELECT id, 'RAG_CHUNK_NO_UNIT' AS code FROM chunks WHERE no_unit UNION ALL SELECT id, 'RAG_CHUNK_NO_SEGMENT' FROM chunks LEFT JOIN seg ON segment_id = asked WHERE segment_id IS NULL
 UNION ALL SELECT id, 'RAG_CHUNK_NON_SEMANTIC_SOURCE' FROM chunks JOIN seg ON segment_id = asked WHERE disposition <> 'canonical_atom' OR kind IN ('blank', 'decorative_separator', 'table_separator', 'metadata', 'structure_only'))"""


@query(f"""WITH {UNITS}, {CHUNKS}, first_ AS (SELECT source_id, start_byte, end_byte, min(unit_id) AS f FROM units WHERE source_segment_id <> '' AND NOT (start_byte = 0 AND end_byte = 0) GROUP BY ALL HAVING count(*) > 1)
SELECT unit_id AS id, 'FEED_UNIT_NO_SEGMENT' AS code FROM units WHERE source_segment_id = '' UNION ALL SELECT unit_id, 'FEED_UNIT_NO_SOURCE' FROM units WHERE source_segment_id <> '' AND source_id = ''
UNION ALL SELECT unit_id, 'FEED_UNIT_NO_SPAN' FROM units WHERE source_segment_id <> '' AND start_byte = 0 AND end_byte = 0 UNION ALL SELECT unit_id, 'FEED_EMPTY_TEXT' FROM units WHERE trim(text) = ''
UNION ALL SELECT unit_id, 'FEED_JUNK_TEXT' FROM units WHERE trim(text) <> '' AND {JUNK.format('text')}
UNION ALL SELECT unit_id, 'FEED_DUPLICATE_SPAN' FROM units JOIN first_ USING (source_id, start_byte, end_byte) WHERE source_segment_id <> '' AND unit_id <> f UNION ALL SELECT id, code FROM chunk_found""")
def feed_quality(spark, d):
    return ig.feed_quality(_units(spark, d), _chunks(spark, d), _segments(spark, d))


@query(f"WITH {SEGMENTS}, {CHUNKS} SELECT id, code FROM chunk_found")
def chunk_segment_findings(spark, d):
    return ig.chunk_findings(_chunks(spark, d), _segments(spark, d))


@query("""WITH u AS (SELECT o_orderkey AS unit_id, CASE WHEN o_orderkey % 3 = 0 THEN 'table_cell' ELSE 'table_row' END AS kind, o_orderkey % 4 = 0 OR o_orderkey % 5 = 0 AS bare, o_orderstatus = 'P' AS leaked, o_orderpriority AS raw, replace(o_orderpriority, '-', '') AS decoded, o_custkey % 2 = 0 AS is_raw FROM orders)
SELECT unit_id, 'FEED_TABLE_CELL_NOT_ROW_CONTEXT' AS code, 'blocking' AS severity FROM u WHERE kind = 'table_cell' AND bare UNION ALL SELECT unit_id, 'FEED_METADATA_TABLE_LEAKED', 'blocking' FROM u WHERE leaked
UNION ALL SELECT unit_id, 'FEED_RAW_DECODED_MISMATCH', 'informational' FROM u WHERE NOT is_raw AND trim(raw) <> trim(decoded)""")
def unit_context_findings(spark, d):
    k = F.col("o_orderkey")
    units = table(spark, d, "orders").select(
        k.alias("unit_id"), F.when(k % 3 == 0, "table_cell").otherwise("table_row").alias("kind"), F.when(k % 4 == 0, " ").otherwise("t1").alias("table_id"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"))).alias("column_headers"),
        F.when(F.col("o_orderstatus") == "P", "metadata_table").otherwise("data_table").alias("table_role"), F.col("o_orderpriority").alias("raw_text"), F.replace("o_orderpriority", F.lit("-"), F.lit("")).alias("decoded_value"), F.when(F.col("o_custkey") % 2 == 0, "raw").otherwise("decoded").alias("business_rule_mode"),
    )
    return ig.context_findings(units)


# -- selections -----------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT doc_id, CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence, lang, source FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, confidence = 'medium' AS is_medium, confidence IN ('medium', 'high') AS at_least_medium, lang = 'de' OR source = 'src3' AS tagged, source = 'src1' AS authoritative FROM c""")
def chunk_filters(spark, d):
    c = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    confidence = F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").otherwise("medium")
    tags = F.array("lang", F.upper("source"))
    return c.select("doc_id", (confidence == "medium").alias("is_medium"), sl.at_least(confidence, "medium").alias("at_least_medium"), sl.with_tag(tags, ["DE", "src3"]).alias("tagged"), (F.col("source") == "src1").alias("authoritative"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 4, 5)")
def project_filter(spark, d):
    return sl.matching({"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3, 4, 5], "c_name": []}, table(spark, d, "customer")).select("c_custkey")


SAMPLES = ("1. [Scope](#scope)", "[to fill in] -", "**Field**:", "[](x)", "Chapitre 3 - Objet", "Status : draft of the thing", "Section à compléter plus tard", "The following rules apply here:", "two words", "`a` *b* __c__ [d](e) f", "****", "![alt text here](x.png)", "A plain sentence of the corpus.")
TEXTS = f"""texts AS (SELECT doc_id || ':' || line_no AS id, line AS t FROM kinds UNION ALL SELECT 'sample ' || i, s FROM (SELECT unnest([{', '.join("'" + s + "'" for s in SAMPLES)}]) AS s, generate_subscripts([{', '.join('0' for _ in SAMPLES)}], 1) AS i))"""


@query(rf"""WITH {LINES}, {TEXTS}, p AS (SELECT id, trim(t) AS t, trim(regexp_replace(regexp_replace(regexp_replace(trim(t), '(!?)\[([^\]\n]*)\]\(([^)\n]*)\)', '\2', 'g'), '`|\*\*|__|\*|_', '', 'g'), '\s+', ' ', 'g')) AS plain FROM texts),
f AS (SELECT *, strip_accents(lower(plain)) AS folded FROM p), n AS (SELECT *, len(regexp_extract_all(plain, '[\p{{L}}\p{{Nd}}]+')) AS tokens, regexp_replace(folded, '^[-*+0-9.) ]+', '') AS bare FROM f)
SELECT id, CASE WHEN t = '' THEN 'blank' WHEN regexp_matches(t, '^\s*(?:\d+[.)]\s*)?\[[^\]\n]+\]\(\s*#[^)]+\)\s*$') THEN 'contents_link' WHEN regexp_matches(t, '^\s*(?:\*\*)?\[[^\]\n]+\](?:\*\*)?\s*(?:[-—–:])?\s*$') THEN 'bracketed' WHEN plain = '' THEN 'no_text'
 WHEN regexp_matches(t, '^\s*(?:\*\*|__)[^*_]{{1,120}}(?:\*\*|__)\s*:?\s*$') THEN 'label' WHEN starts_with(bare, 'statut :') OR starts_with(bare, 'status :') OR regexp_matches(bare, '^\s*(chapitre|chapter)\s+\d+\s*[-—–]') THEN 'reference'
 WHEN contains(folded, 'section a completer') OR contains(folded, 'a completer lors de la prochaine revision') OR contains(folded, 'to be completed') THEN 'placeholder' WHEN ends_with(folded, ':') AND tokens >= 3 THEN 'lead_in' WHEN tokens <= 2 THEN 'few_tokens'
 WHEN {JUNK.format('plain')} THEN 'junk' END AS rejection FROM n""")
def atom_texts(spark, d):
    lines = _kinds(spark, d).select(F.concat_ws(":", "source", "line_no").alias("id"), F.col("line").alias("t"))
    samples = spark.createDataFrame([(f"sample {k}", s) for k, s in enumerate(SAMPLES, 1)], "id string, t string")
    return lines.unionByName(samples).select("id", sl.atom_rejection(F.col("t")).alias("rejection"))


@query(f"""WITH {LINES}, u AS (SELECT *, strlen(trim(line)) >= 40 AND line_no % 5 <= 3 AND kind IN ('paragraph', 'list_item') AS emit FROM kinds) SELECT kind, count(*) AS units, count_if(emit) AS eligible, count_if(emit) / count(*)::DOUBLE AS coverage FROM u GROUP BY kind""")
def unit_emission(spark, d):
    u = _kinds(spark, d).select("kind", sl.emitted(F.col("kind"), F.col("line"), F.col("line_no") % 5, 40, 3, ("paragraph", "list_item")).alias("emit"))
    return u.groupBy("kind").agg(F.count(F.lit(1)).alias("units"), F.count_if("emit").alias("eligible"), F.avg(F.col("emit").cast("double")).alias("coverage"))


@query(f"""WITH {LINES} SELECT doc_id, count_if(line_no % 2 = 0 AND NOT {JUNK.format('trim(line)')} AND len(list_filter(regexp_split_to_array(trim(line), '\\s+'), lambda x: x <> '')) >= 3 AND length(trim(line)) >= 20) AS candidates FROM kinds GROUP BY doc_id""")
def scalar_candidates(spark, d):
    rows = _kinds(spark, d).select(F.col("source").alias("doc_id"), sl.scalar_candidate(F.when(F.col("line_no") % 2 == 0, "scalar_string").otherwise("scalar_int"), F.col("line")).alias("ok"))
    return rows.groupBy("doc_id").agg(F.count_if("ok").alias("candidates"))


@query(f"""WITH {SEGMENTS} SELECT disposition, count(*) AS segments, count_if(disposition IN ('coverage_only', 'structure_only', 'excluded_by_policy', 'metadata') OR kind IN ('blank', 'decorative_separator', 'table_separator', 'metadata')) AS non_semantic,
 count_if(disposition = 'canonical_atom' AND line_no % 3 = 0) AS extractable FROM seg GROUP BY disposition""")
def segment_selection(spark, d):
    s = _segments(spark, d)
    take = sl.extractable(F.when(F.col("disposition") == "canonical_atom", "admitted").otherwise("excluded"), F.when(F.col("line_no") % 3 == 0, "atomized"))
    return s.groupBy("disposition").agg(F.count(F.lit(1)).alias("segments"), F.count_if(sl.non_semantic(F.col("disposition"), F.col("kind"))).alias("non_semantic"), F.count_if(take).alias("extractable"))


# -- audits -----------------------------------------------------------------------------------------------------------------


@query(f"""WITH {UNITS}, {CHUNKS}, active AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS source_id FROM documents WHERE doc_id % 4 <> 3)
SELECT (SELECT count(*) FROM units) + (SELECT count(*) FROM nation) AS units, (SELECT count(*) FROM units) AS source_backed_units, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks WHERE asked <> '') AS source_backed_chunks,
 (SELECT count(*) FROM active) AS active_sources, (SELECT count(*) FROM active WHERE source_id NOT IN (SELECT source_id FROM units)) AS sources_without_units""")
def feed_totals(spark, d):
    sources = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.when(F.col("doc_id") % 4 == 3, "archived").when(F.col("doc_id") % 4 == 2, "").otherwise("active").alias("status"))
    return au.feed_totals(_units(spark, d).withColumn("source_ids", F.lit(None).cast("array<string>")), _chunks(spark, d), sources)


@query(f"WITH {LINES} SELECT count_if(kind = 'list_item') AS of_kind, count(*) AS units, count_if(kind = 'list_item') / count(*)::DOUBLE AS ratio FROM kinds")
def unit_kind_share(spark, d):
    return au.kind_share(_kinds(spark, d), "list_item")


PATH_UNITS = f"""{LINES}, {FILES}, pu AS (SELECT path, end_byte - start_byte AS size FROM kinds JOIN files USING (doc_id) WHERE kind <> 'blank' AND line_no % 3 = 0 AND ends_with(path, '.md'))"""


def _path_units(spark, d):
    own = files(spark, d).select(F.col("doc_id").alias("source"), F.col("path").alias("source_path"))
    return _kinds(spark, d).where("kind <> 'blank' and line_no % 3 = 0").join(own.where(F.col("source_path").endswith(".md")), "source")


@query(f"""WITH {PATH_UNITS}, c AS (SELECT path, sum(size) AS covered FROM pu GROUP BY path) SELECT lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, count(*) AS sources, count(covered) AS with_units, coalesce(sum(covered), 0) / sum(strlen(text)) * 100 AS byte_coverage_pct FROM files LEFT JOIN c USING (path) GROUP BY 1""")
def extension_coverage(spark, d):
    return au.extension_coverage(files(spark, d).select("path", F.octet_length("text").cast("long").alias("size_bytes")), _path_units(spark, d))


@query(f"WITH {PATH_UNITS} SELECT path, CAST(strlen(text) AS BIGINT) AS size_bytes FROM files WHERE path NOT IN (SELECT path FROM pu) ORDER BY path LIMIT 50")
def first_paths_without_units(spark, d):
    return au.first_without_units(files(spark, d).select("path", F.octet_length("text").cast("long").alias("size_bytes")), _path_units(spark, d))


@query(f"WITH {LINES} SELECT doc_id || ':' || line_no AS unit_id, doc_id AS source FROM kinds WHERE line_no % 7 = 3 AND trim(line) <> trim(line || '!')")
def text_mismatches(spark, d):
    units = _kinds(spark, d).select(F.concat_ws(":", "source", "line_no").alias("unit_id"), "source", "start_byte", "end_byte", F.when(F.col("line_no") % 7 == 3, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("text"))
    return au.text_mismatches(units, table(spark, d, "documents").select(F.col("doc_id").alias("source"), F.col("text").alias("source_text")))


@query("""SELECT source AS source_id, 'unit' AS kind, doc_id AS position, 'u' || doc_id AS id FROM documents WHERE source <> 'src7' UNION ALL SELECT 'src1', 'unit', doc_id, 'u' || doc_id FROM documents
UNION ALL SELECT source, 'chunk', doc_id, 'c' || doc_id FROM documents WHERE source <> 'src7'""")
def corpus_index(spark, d):
    docs = table(spark, d, "documents")
    units = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.array("source", F.lit("src1")).alias("source_ids"))
    chunks = docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.col("source").alias("source_id"))
    return au.corpus_index(docs.where("source <> 'src7'").select(F.col("source").alias("source_id")), units, chunks)


@query("SELECT 'by_layer' AS axis, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'by_domain', l_linestatus, count(*) FROM lineitem GROUP BY ALL UNION ALL SELECT 'by_node_type', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY ALL")
def runtime_histograms(spark, d):
    return au.histograms(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("by_layer"), F.col("l_linestatus").alias("by_domain"), F.col("l_linenumber").alias("by_node_type")), ["by_layer", "by_domain", "by_node_type"])


@query("SELECT count(*) AS nodes, count_if(o_orderstatus = 'O') AS active, count_if(o_orderstatus IN ('F', 'P')) AS stale, count_if(o_orderstatus = 'O') / count(*)::DOUBLE AS active_ratio FROM orders")
def node_governance(spark, d):
    return au.governance_summary(table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "repealed").otherwise("amended").alias("status")))


@query("""WITH n AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'p' || p_partkey ELSE 'P' || p_partkey END AS node_id, p_size, p_partkey FROM part)
SELECT node_id, 'node_id' AS error FROM n WHERE p_partkey % 11 = 0 UNION ALL SELECT node_id, 'depth_range' FROM n WHERE p_size % 10 > 7 UNION ALL SELECT node_id, 'depth_of_type' FROM n WHERE p_partkey % 2 = 0 AND p_size % 10 <> 4 UNION ALL SELECT node_id, 'node_type' FROM n WHERE p_partkey % 13 = 1 AND p_partkey % 2 = 1
UNION ALL SELECT node_id, 'ordinal_path' FROM n WHERE p_partkey % 17 = 0 UNION ALL SELECT node_id, 'source_hash' FROM n WHERE p_partkey % 19 = 0 UNION ALL SELECT node_id, 'status' FROM n WHERE p_partkey % 23 = 0 UNION ALL SELECT node_id, 'priority' FROM n WHERE p_partkey % 29 = 0 UNION ALL SELECT node_id, 'domain' FROM n WHERE p_partkey % 31 = 0""")
def node_errors(spark, d):
    k = F.col("p_partkey")
    n = table(spark, d, "part").select(
        F.concat(F.when(k % 11 == 0, "p").otherwise("P"), k).alias("node_id"), F.lit("DOC").alias("document_id"), F.when(k % 2 == 0, "article").when(k % 13 == 1, "verse").otherwise("table").alias("node_type"), F.lit("r").alias("canonical_ref"), F.lit("d").alias("display_ref"), (F.col("p_size") % 10).alias("depth"),
        F.when(k % 17 == 0, "1.").otherwise("1.2").alias("ordinal_path"), F.when(k % 19 == 0, "md5:ab").otherwise("sha256:ab").alias("source_hash"), F.when(k % 23 == 0, "gone").otherwise("active").alias("status"), F.when(k % 29 == 0, F.lit(None)).otherwise("high").alias("priority"), F.when(k % 31 == 0, " ").otherwise("x").alias("domain"),
    )
    return au.node_errors(n)


@query("SELECT count_if(l_linenumber > 1) AS with_span, count_if(l_linenumber <= 1) AS without_span, CAST(sum(l_partkey) FILTER (l_linenumber > 1) AS BIGINT) AS covered_bytes, least(sum(l_partkey) FILTER (l_linenumber > 1) / 5e6, 1.0) AS coverage_ratio FROM lineitem")
def node_span_coverage(spark, d):
    return au.span_coverage(table(spark, d, "lineitem").select((F.col("l_linenumber") - 1).alias("start_line"), F.col("l_linenumber").alias("end_line"), F.col("l_partkey").alias("byte_length")), 5_000_000)


@query("""WITH a AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 'partial' WHEN l_quantity > 45 THEN 'not_satisfied' WHEN l_linestatus = 'F' THEN 'not_applicable' ELSE 'satisfied' END AS c FROM lineitem)
SELECT l_orderkey, CASE WHEN NOT bool_or(c IN ('partial', 'not_satisfied')) THEN 'satisfied' WHEN bool_or(c = 'not_satisfied') THEN 'not_satisfied' ELSE 'partial' END AS overall FROM a GROUP BY l_orderkey""")
def evidence_compliance(spark, d):
    c = F.when(F.col("l_returnflag") == "R", "partial").when(F.col("l_quantity") > 45, "not_satisfied").when(F.col("l_linestatus") == "F", "not_applicable").otherwise("satisfied")
    return au.overall_compliance(table(spark, d, "lineitem").select("l_orderkey", c.alias("compliance")), "l_orderkey")


@query("SELECT count_if(c_acctbal >= 0) AS passed, count_if(c_acctbal < 0) AS failed, count_if(c_acctbal < 0 AND c_mktsegment = 'BUILDING') AS blocking_failures, count_if(c_acctbal < 0 AND c_mktsegment = 'BUILDING') = 0 AS gate_passes FROM customer")
def control_verdict(spark, d):
    return au.control_verdict(table(spark, d, "customer").select(F.col("c_custkey").alias("control_id"), F.when(F.col("c_acctbal") >= 0, "passed").otherwise("failed").alias("status"), F.when(F.col("c_mktsegment") == "BUILDING", "blocking").otherwise("warning").alias("gate_mode")))


@query("SELECT CASE WHEN page_id % 5 = 0 THEN 'unspecified' ELSE regexp_extract(url, '^([a-z]+)://', 1) END AS source_type, count(*) AS records, count_if(page_id % 3 = 0) AS web_sources FROM pages GROUP BY 1")
def snapshot_source_types(spark, d):
    return au.snapshot_sources(table(spark, d, "pages").select(F.when(F.col("page_id") % 5 == 0, "").otherwise(F.regexp_extract("url", "^([a-z]+)://", 1)).alias("source_type"), F.when(F.col("page_id") % 3 == 0, F.col("url")).alias("web_source")))
