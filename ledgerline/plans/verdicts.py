"""Queries that put verdicts together: certificates of documents, the report of all quality rules, exports within a lens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import governance as gv
from ledgerline.operators import quality as qu

from .corpus import FACETS, FINDINGS, LENS, LINES, REASON, RECORDS, _chunks, _columns, _facets, _kinds, _units, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- certificates ---------------------------------------------------------------------------------------------------


@query(f"""WITH {LINES}, a AS (SELECT doc_id, line, CASE WHEN line_no % 31 = 30 THEN '' WHEN doc_id % 8 = 0 AND line_no = 1 THEN 'a000000' ELSE 'a' || lpad(CAST(line_no AS VARCHAR), 6, '0') END AS id, CASE WHEN line_no % 43 = 42 THEN '' ELSE sha256(line) END AS h,
 line_no % 29 = 28 AS spanless, line_no % 47 = 46 AND line_no % 29 <> 28 AS inverted FROM kinds),
i AS (SELECT doc_id, id, count(*) AS n FROM a GROUP BY ALL),
p AS (SELECT doc_id, count(*) AS n, count_if(id = '') AS nameless, count_if(spanless) AS spanless, count_if(inverted) AS inverted, count_if(h = '') AS unhashed, count_if(trim(line) = '') AS empty, string_agg(h, '' ORDER BY id, h) AS links FROM a GROUP BY doc_id),
t AS (SELECT doc_id, count_if(n > 1 AND id <> '') AS twice FROM i GROUP BY doc_id),
s AS (SELECT doc_id, sha256(text) AS hash, strlen(text) AS total, CAST(CASE doc_id % 6 WHEN 0 THEN strlen(text) // 10 WHEN 1 THEN least(strlen(text), 1) ELSE 0 END AS BIGINT) AS lost FROM documents WHERE text IS NOT NULL),
f AS (SELECT s.doc_id, s.hash, coalesce(p.n, 0) AS n, links, list_filter([{{'c': 'LOW_COVERAGE', 'b': true, 'n': CAST(CASE WHEN total > 0 THEN (total - lost) / total::DOUBLE * 100 < 95 ELSE coalesce(p.n, 0) = 0 END AS BIGINT)}}, {{'c': 'HIGH_LOSS', 'b': true, 'n': CAST(total > 0 AND lost / total::DOUBLE > 0.05 AS BIGINT)}}, {{'c': 'NOT_LOSSLESS', 'b': true, 'n': CAST(lost > 0 AS BIGINT)}},
 {{'c': 'EMPTY_ATOM_ID', 'b': true, 'n': coalesce(nameless, 0)::BIGINT}}, {{'c': 'DUPLICATE_ATOM_ID', 'b': true, 'n': coalesce(twice, 0)::BIGINT}}, {{'c': 'MISSING_SOURCE_SPAN', 'b': false, 'n': coalesce(spanless, 0)::BIGINT}}, {{'c': 'INVALID_SOURCE_SPAN', 'b': true, 'n': coalesce(inverted, 0)::BIGINT}}, {{'c': 'MISSING_CONTENT_HASH', 'b': true, 'n': coalesce(unhashed, 0)::BIGINT}},
 {{'c': 'EXCESSIVE_EMPTY_ATOMS', 'b': true, 'n': CAST(coalesce(empty * 2 > p.n, false) AS BIGINT)}}, {{'c': 'EMPTY_ATOMS', 'b': false, 'n': CAST(coalesce(empty > 0 AND empty * 2 <= p.n, false) AS BIGINT)}}, {{'c': 'NO_ATOMS', 'b': true, 'n': CAST(p.n IS NULL AS BIGINT)}}], lambda x: x.n > 0) AS f FROM s LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id))
SELECT doc_id AS document, CASE WHEN len(list_filter(f, lambda x: x.b)) > 0 THEN 'failed' WHEN len(f) > 0 THEN 'provisional' ELSE 'certified' END AS level, CAST(n AS BIGINT) AS atoms, CAST(coalesce(list_sum(list_transform(f, lambda x: x.n)), 0) AS BIGINT) AS findings,
 CAST(coalesce(list_sum(list_transform(list_filter(f, lambda x: x.b), lambda x: x.n)), 0) AS BIGINT) AS blocking, array_to_string(list_transform(f, lambda x: x.c), ',') AS codes, CASE WHEN n > 0 THEN 'sha256:' || sha256(hash || links) ELSE '' END AS chain_hash FROM f""")
def certificates(spark, d):
    """All lines as atoms, some with a fault; a tenth of some documents and one byte of others is lost."""
    n, doc = F.col("line_no"), F.col("source")
    name = F.when(n % 31 == 30, "").when((doc % 8 == 0) & (n == 1), "a000000").otherwise(F.concat(F.lit("a"), F.lpad(n.cast("string"), 6, "0")))
    bare = n % 29 == 28
    atoms = _kinds(spark, d).select(
        doc.alias("document"), name.alias("atom_id"), F.col("line").alias("text"), F.when(bare, 0).otherwise(n + 1).alias("start_line"), F.when(bare, 0).when(n % 47 == 46, n).otherwise(n + 1).alias("end_line"), F.when(n % 43 == 42, "").otherwise(F.col("line_hash")).alias("content_hash"),
    )
    size, k = F.octet_length("text").cast("long"), F.col("doc_id") % 6
    lost = F.when(k == 0, F.floor(size / 10)).when(k == 1, F.least(size, F.lit(1))).otherwise(0).cast("long")
    sources = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("document"), F.sha2("text", 256).alias("source_hash"), size.alias("total_bytes"), (size - lost).alias("covered_bytes"), lost.alias("lost_bytes"), F.lit(1).alias("blocks"))
    return gv.certificates(atoms, sources, lossless=True)


# -- the report of all families -------------------------------------------------------------------------------------

DISPOSED = ("lexicon_atom", "", "requires_review", "non_semantic", None, "identifier_atom")
REPORT = f"""{FINDINGS}, raw_ AS (SELECT doc_id, line_no, kind, line, doc_id || ':' || line_no AS unit_id FROM kinds WHERE kind <> 'blank'),
frag AS (SELECT 'p' || page_id AS source_id, 'f' || page_id AS fragment_id, (['lexicon_atom', '', 'requires_review', 'non_semantic', NULL, 'identifier_atom'])[length(url) % 6 + 1] AS disposition FROM pages),
known AS (SELECT 'd' || doc_id AS source_id, true AS open_ FROM documents UNION ALL SELECT 'p' || page_id, page_id % 4 <> 0 AND page_id % 5 <> 0 AND page_id % 3 <> 0 FROM pages),
used AS (SELECT 'd' || doc_id AS source_id FROM raw_ UNION SELECT source_id FROM frag WHERE disposition IN ('lexicon_atom', 'identifier_atom', 'normative_value_atom')),
report AS (SELECT unit_id AS id, code, severity FROM findings UNION ALL SELECT unit_id, 'FEED_TABLE_CELL_NOT_ROW_CONTEXT', 'blocking' FROM raw_ WHERE kind = 'table' AND line_no % 4 = 0
 UNION ALL SELECT unit_id, 'FEED_METADATA_TABLE_LEAKED', 'blocking' FROM raw_ WHERE line_no % 20 = 19 UNION ALL SELECT unit_id, 'FEED_RAW_DECODED_MISMATCH', 'informational' FROM raw_ WHERE line_no % 5 = 4 AND doc_id % 2 = 1
 UNION ALL SELECT source_id, 'SOURCE_ZERO_UNIT_NO_REASON', 'blocking' FROM known ANTI JOIN used USING (source_id) WHERE open_ UNION ALL SELECT fragment_id, 'SHORT_CRITICAL_REQUIRES_REVIEW', 'blocking' FROM frag WHERE coalesce(disposition, '') IN ('', 'requires_review'))"""


def _report(spark, d):
    """Lines of documents as units; pages are sources with short fragments and no units, some excluded, not atomized or with a reason."""
    n, k = F.col("line_no"), F.col("page_id")
    mode = F.when(F.col("source") % 2 == 0, "raw").otherwise("decoded")
    units = _units(spark, d).withColumns({
        "source_id": F.concat(F.lit("d"), "source"), "kind": F.when(F.col("kind") == "table", "table_cell").otherwise(F.col("kind")), "table_id": F.when(n % 4 == 0, "").otherwise("t"), "column_headers": F.array(F.lit("a")), "table_role": F.when(n % 20 == 19, "metadata_table").otherwise("data_table"),
        "raw_text": F.col("text"), "decoded_value": F.when(n % 5 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "business_rule_mode": mode,
    })
    pages = table(spark, d, "pages")
    stated = lambda on, a, b: F.when(on, a).otherwise(b)
    sources = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("source_id"), F.lit("admitted").alias("admission_status"), F.lit("atomized").alias("atomization_status"), F.lit("").alias("exclusion_reason"))
    sources = sources.unionByName(pages.select(F.concat(F.lit("p"), k).alias("source_id"), stated(k % 4 == 0, "excluded", "admitted").alias("admission_status"), stated(k % 5 == 0, "coverage_only", "atomized").alias("atomization_status"), stated(k % 3 == 0, "kept as evidence", " ").alias("exclusion_reason")))
    disposed = F.array(*map(F.lit, DISPOSED))[F.length("url") % len(DISPOSED)]
    fragments = pages.select(F.concat(F.lit("p"), k).alias("source_id"), F.concat(F.lit("f"), k).alias("fragment_id"), disposed.alias("disposition"))
    return qu.semantic_report(units, ["source", "line_no"], sources, fragments)


@query(f"WITH {REPORT} SELECT * FROM report")
def semantic_report(spark, d):
    return _report(spark, d)


@query(f"""WITH {REPORT} SELECT count_if(severity = 'blocking') AS blocking, count_if(severity = 'warning') AS warning, count_if(severity = 'informational') AS informational,
 CASE WHEN count_if(severity = 'blocking') > 0 THEN 'fail' WHEN count_if(severity = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS status FROM report""")
def semantic_report_verdict(spark, d):
    return qu.report_verdict(_report(spark, d))


# -- exports within a lens ------------------------------------------------------------------------------------------

@query(f"""WITH {RECORDS}, {FACETS}, {REASON}, o AS (SELECT out_.*, r.reason AS why, l.doc_id IS NOT NULL AS faceted FROM out_ JOIN r USING (doc_id) LEFT JOIN labels l USING (doc_id))
SELECT chunk_id, source_id, CASE WHEN rejection IS NOT NULL THEN 'rejected' WHEN NOT faceted OR why IS NOT NULL THEN 'excluded' ELSE 'record' END AS outcome, CASE WHEN rejection IS NOT NULL THEN rejection WHEN NOT faceted THEN 'lens_no_facets' WHEN why IS NOT NULL THEN 'lens_excluded' END AS code,
 CASE WHEN rejection IS NULL AND faceted THEN why END AS reason FROM o""")
def rag_outcomes(spark, d):
    """Records, rejections and exclusions of one export in one pass; documents without a label bear no facets."""
    facets = _facets(spark, d).join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("has_facets", F.lit(True))
    rows = _chunks(spark, d).join(facets, "doc_id", "left")
    return qu.scoped_outcome(rows, _columns(facets), F.coalesce("has_facets", F.lit(False)), LENS).select("chunk_id", "source_id", "outcome", "code", "reason")
