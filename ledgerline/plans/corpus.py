"""Queries over ``documents`` as a corpus: snapshots, segments, units, quality, chunks, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.functions.globs import allowed, glob_regex
from ledgerline.operators import headings as hd
from ledgerline.operators import lens as ln
from ledgerline.operators import quality as qu
from ledgerline.operators import segments as sg
from ledgerline.operators import snapshots as sn
from ledgerline.sources.files import class_action, extension, file_class
from ledgerline.sources.shared import ensure_checkpoints

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# -- documents as files ---------------------------------------------------------------------------------------------

EXT = {0: "md", 1: "yaml", 2: "pdf", 3: "docx", 4: "png", 5: "bin"}


def files(spark: SparkSession, d: str) -> DataFrame:
    ext = F.expr("element_at(array('md','yaml','pdf','docx','png','bin'), cast(doc_id % 6 + 1 as int))")
    folder = F.when(F.col("source") == "src3", "archive").otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.concat_ws("/", folder, "source", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), ext)).alias("path"))


FILES = """files AS (SELECT doc_id, text, lang, source, (CASE WHEN source = 'src3' THEN 'archive' ELSE lang END) || '/' || source || '/d' || doc_id || '.' || (['md','yaml','pdf','docx','png','bin'])[doc_id % 6 + 1] AS path FROM documents)"""


@query(f"""WITH {FILES} SELECT path, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes, (['md','yaml','pdf','docx','png','bin'])[doc_id % 6 + 1] AS ext,
  CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' WHEN 3 THEN 'office' WHEN 4 THEN 'image' ELSE 'binary' END AS class,
  CASE doc_id % 6 WHEN 0 THEN 'allow' WHEN 1 THEN 'allow' WHEN 2 THEN 'warn' WHEN 3 THEN 'warn' ELSE 'block' END AS action
FROM files WHERE NOT regexp_matches(path, '^archive(/.*)?$') AND regexp_matches(path, '^(.*/)?[^/]*\\.(md|yaml|pdf|docx|png|bin)$')""")
def snapshot_inventory(spark, d):
    rows = files(spark, d).where(allowed(F.col("path"), [f"**/*.{e}" for e in EXT.values()], ["archive/**"]))
    cls = file_class(F.col("path"))
    return rows.select("path", tx.raw_hash(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"), extension(F.col("path")).alias("ext"), cls.alias("class"), class_action(cls, {"pdf": "warn", "office": "warn", "image": "block", "binary": "block"}).alias("action"))


def _revisions(spark, d):
    f = files(spark, d)
    old = f.where("doc_id % 7 <> 0").select("path", tx.raw_hash(F.col("text")).alias("content_hash"))
    new = f.where("doc_id % 11 <> 0").select("path", tx.raw_hash(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("\nrevised"))).otherwise(F.col("text"))).alias("content_hash"))
    return old, new


REVISIONS = f"""{FILES}, o AS (SELECT path, sha256(text) AS h FROM files WHERE doc_id % 7 <> 0),
n AS (SELECT path, sha256(CASE WHEN doc_id % 13 = 0 THEN text || chr(10) || 'revised' ELSE text END) AS h FROM files WHERE doc_id % 11 <> 0)"""


@query(f"""WITH {REVISIONS} SELECT coalesce(o.path, n.path) AS path, o.h AS old_hash, n.h AS new_hash,
 CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN CASE WHEN lower(o.path) LIKE '%archive%' THEN 'archived' ELSE 'removed' END WHEN o.h <> n.h THEN 'changed' ELSE 'unchanged' END AS status
FROM o FULL JOIN n ON o.path = n.path""")
def diff_snapshots(spark, d):
    return sn.diff_snapshots(*_revisions(spark, d))


@query(f"WITH {REVISIONS} SELECT n.path, n.h AS content_hash FROM n ANTI JOIN o ON n.path = o.path AND n.h = o.h")
def lockfile_guard(spark, d):
    old, new = _revisions(spark, d)
    return sn.unapproved(new, old).select("path", "content_hash")


@query(f"""WITH {REVISIONS}, j AS (SELECT coalesce(o.path, n.path) AS path, o.h AS a, n.h AS b FROM o FULL JOIN n ON o.path = n.path)
SELECT path, CASE WHEN b IS NULL THEN 'SOURCE_MISSING' WHEN a IS NULL THEN 'SOURCE_UNDECLARED' ELSE 'SOURCE_HASH_MISMATCH' END AS code FROM j WHERE a IS NULL OR b IS NULL OR a <> b""")
def manifest_validation(spark, d):
    return sn.validate_manifest(*_revisions(spark, d))


@query(f"""WITH {FILES}, e AS (SELECT (['md','yaml','pdf','docx','png','bin'])[doc_id % 6 + 1] AS ext FROM files)
SELECT ext, count(*) AS files, CASE ext WHEN 'md' THEN 'markdown' WHEN 'yaml' THEN 'yaml' END AS parser, ext IN ('md','yaml') AS supported FROM e GROUP BY ext""")
def format_inventory(spark, d):
    from ledgerline.sources.files import format_inventory as inventory

    return inventory(files(spark, d).select(extension(F.col("path")).alias("ext")), {"md": "markdown", "yaml": "yaml"})


# -- lines and coverage ---------------------------------------------------------------------------------------------

LINES = r"""lines AS (SELECT doc_id, i - 1 AS line_no, line, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
kinds AS (SELECT *, start_byte + strlen(line) AS end_byte, CASE WHEN trim(regexp_replace(line, '\s+', '', 'g')) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' WHEN regexp_matches(line, '^(\*{3,}|-{3,}|_{3,})\s*$') THEN 'rule'
  WHEN regexp_matches(line, '^(```|~~~)') THEN 'code' WHEN regexp_matches(line, '\|') THEN 'table' WHEN regexp_matches(line, '^\s*([-*+]|\d+[.)])\s') THEN 'list_item' WHEN regexp_matches(line, '^\s*>') THEN 'quote' ELSE 'paragraph' END AS kind FROM lines)"""


def _kinds(spark, d):
    lines = sg.line_ledger(table(spark, d, "documents"))
    return lines.withColumn("kind", sg.disposition(F.col("line")))


@query(f"WITH {LINES} SELECT doc_id AS source, CAST(line_no AS BIGINT) AS line_no, start_byte, CAST(end_byte AS BIGINT) AS end_byte, sha256(line) AS line_hash, kind FROM kinds")
def line_ledger(spark, d):
    return _kinds(spark, d).select("source", "line_no", "start_byte", F.col("end_byte").cast("long").alias("end_byte"), "line_hash", "kind")


COVERAGE = f"""{LINES}, cov AS (SELECT d.doc_id, d.lang, d.source AS origin, CAST(strlen(d.text) AS BIGINT) AS total_bytes, c.covered_bytes, c.excluded_bytes, greatest(CAST(strlen(d.text) AS BIGINT) - c.covered_bytes - c.excluded_bytes, 0) AS uncovered_bytes
 FROM documents d JOIN (SELECT doc_id, CAST(sum(CASE WHEN kind NOT IN ('blank', 'rule') THEN end_byte - start_byte ELSE 0 END) AS BIGINT) AS covered_bytes, CAST(sum(CASE WHEN kind IN ('blank', 'rule') THEN end_byte - start_byte ELSE 0 END) AS BIGINT) AS excluded_bytes FROM kinds GROUP BY doc_id) c USING (doc_id))"""


def _coverage(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("source"), "lang", F.col("source").alias("origin"), F.octet_length("text").cast("long").alias("total_bytes"))
    return sg.coverage(_kinds(spark, d).withColumn("semantic", ~F.col("kind").isin("blank", "rule")), docs)


@query(f"WITH {COVERAGE} SELECT doc_id AS source, total_bytes, covered_bytes, excluded_bytes, uncovered_bytes FROM cov")
def byte_coverage(spark, d):
    return _coverage(spark, d).select("source", "total_bytes", "covered_bytes", "excluded_bytes", "uncovered_bytes")


@query(f"WITH {COVERAGE} SELECT lang, origin, CAST(sum(total_bytes) AS BIGINT) AS total_bytes, CAST(sum(covered_bytes) AS BIGINT) AS covered_bytes, CAST(sum(excluded_bytes) AS BIGINT) AS excluded_bytes, CAST(sum(uncovered_bytes) AS BIGINT) AS uncovered_bytes, count(*) AS sources FROM cov GROUP BY GROUPING SETS ((), (lang), (origin))")
def coverage_by_role(spark, d):
    return sg.ledger_totals(_coverage(spark, d), ["lang", "origin"])


@query(f"WITH {LINES} SELECT kind, count(*) AS lines, CAST(sum(end_byte - start_byte) AS BIGINT) AS bytes FROM kinds GROUP BY kind")
def kind_histogram(spark, d):
    return _kinds(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("end_byte") - F.col("start_byte")).cast("long").alias("bytes"))


@query("""WITH s AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(abs(value)) * 60 AS BIGINT) AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT user_id, reach AS gap_start, s AS gap_end FROM m WHERE s > reach""")
def span_gaps(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (F.unix_seconds(F.col("ts").cast("timestamp")) + (F.floor(F.abs("value")) * 60).cast("long")).alias("e"))
    return sg.span_gaps(e, "user_id", "s", "e")


NORM = r"""regexp_replace(array_to_string(list_transform(string_split({0}, chr(10)), lambda l: regexp_replace(regexp_replace(l, '\s+$', ''), '\s+', ' ', 'g')), chr(10)), '^\n+|\n+$', '', 'g')"""


@query(f"""WITH {LINES}, h AS (SELECT doc_id, line_no, sha256({NORM.format('line')}) AS hash FROM kinds WHERE kind <> 'blank'),
g AS (SELECT hash, count(*) AS group_size, min((doc_id, line_no)) AS f FROM h GROUP BY hash HAVING count(*) >= 2)
SELECT hash, doc_id AS source, CAST(line_no AS BIGINT) AS line_no, group_size, CASE WHEN group_size >= 3 THEN 'blocking' ELSE 'warning' END AS severity FROM h JOIN g USING (hash) WHERE (doc_id, line_no) <> f""")
def normalized_hash_dupes(spark, d):
    ensure_checkpoints(spark)
    units = _kinds(spark, d).where("kind <> 'blank'").select("source", "line_no", tx.normalized_hash(F.col("line")).alias("hash")).checkpoint()
    return sg.duplicate_findings(units, "hash", ["source", "line_no"])


@query(f"""WITH {LINES}, h AS (SELECT doc_id || ':' || line_no AS unit_id, sha256({NORM.format('line')}) AS hash FROM kinds WHERE kind <> 'blank'),
g AS (SELECT hash, count(*) AS units FROM h GROUP BY hash HAVING count(*) > 1 ORDER BY units DESC, hash LIMIT 10),
r AS (SELECT h.*, g.units, row_number() OVER (PARTITION BY hash ORDER BY unit_id) AS n FROM h JOIN g USING (hash))
SELECT hash, units, string_agg(unit_id, ',' ORDER BY unit_id) AS examples FROM r WHERE n <= 5 GROUP BY hash, units""")
def dup_top_groups(spark, d):
    units = _kinds(spark, d).where("kind <> 'blank'").select(F.concat_ws(":", "source", "line_no").alias("unit_id"), F.col("line").alias("text"))
    return sg.duplicate_groups(units, 10, 5)


@query(f"WITH {LINES} SELECT doc_id AS source, CAST(line_no AS BIGINT) AS line_no, length(trim(line)) AS chars FROM kinds WHERE kind <> 'blank' ORDER BY chars, source, line_no LIMIT 20")
def short_offenders(spark, d):
    return _kinds(spark, d).where("kind <> 'blank'").select("source", "line_no", F.length(F.trim("line")).cast("long").alias("chars")).orderBy("chars", "source", "line_no").limit(20)


@query(r"""WITH u AS (SELECT lang, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS t, length(text) AS c FROM documents)
SELECT lang, count(*) AS units, count_if(t <= 2) AS tokens_le_2, count_if(t <= 10) AS tokens_le_10, count_if(t <= 25) AS tokens_le_25, count_if(t <= 100) AS tokens_le_100, count_if(t > 100) AS tokens_gt_100,
count_if(c <= 10) AS chars_le_10, count_if(c <= 50) AS chars_le_50, count_if(c <= 200) AS chars_le_200, count_if(c <= 1000) AS chars_le_1000, count_if(c > 1000) AS chars_gt_1000 FROM u GROUP BY lang""")
def length_buckets(spark, d):
    return sg.length_buckets(table(spark, d, "documents"), "lang", tx.word_count(F.col("text")), F.length("text"))


# -- quality gate ---------------------------------------------------------------------------------------------------

UNITS = f"""{LINES}, units AS (SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, doc_id || ':' || line_no AS unit_id, trim(line) AS t, kind, len(list_filter(regexp_split_to_array(line, '\\s+'), lambda x: x <> '')) AS tokens, length(trim(line)) AS chars, sha256({NORM.format('line')}) AS hash FROM kinds WHERE kind <> 'blank')"""
FINDINGS = f"""{UNITS}, g AS (SELECT hash, count(*) AS n, min((doc_id, line_no)) AS f FROM units GROUP BY hash HAVING count(*) >= 2),
findings AS (
 SELECT unit_id, 'FEED_UNIT_BELOW_TOKEN_MIN' AS code, 'blocking' AS severity FROM units WHERE tokens < CASE kind WHEN 'paragraph' THEN 3 WHEN 'list_item' THEN 2 WHEN 'callout' THEN 3 WHEN 'table_row' THEN 2 ELSE 1 END
 UNION ALL SELECT unit_id, 'FEED_UNIT_BELOW_CHAR_MIN', 'blocking' FROM units WHERE chars < CASE kind WHEN 'paragraph' THEN 20 WHEN 'list_item' THEN 12 WHEN 'callout' THEN 20 WHEN 'table_row' THEN 12 ELSE 4 END
 UNION ALL SELECT unit_id, 'FEED_STOP_LABEL', 'blocking' FROM units WHERE regexp_replace(lower(t), '[.:;,!?]+$', '') IN ('champ','valeur','statut','status','version','field','value','key','name','date','id')
 UNION ALL SELECT unit_id, 'FEED_JUNK_TEXT', 'blocking' FROM units WHERE NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}]')
 UNION ALL SELECT unit_id, 'FEED_DUPLICATE_NORMALIZED_TEXT', CASE WHEN n >= 3 THEN 'blocking' ELSE 'warning' END FROM units JOIN g USING (hash) WHERE (doc_id, line_no) <> f)"""


def _units(spark, d):
    return _kinds(spark, d).where("kind <> 'blank'").select("source", "line_no", F.concat_ws(":", "source", "line_no").alias("unit_id"), "kind", F.col("line").alias("text"))


@query(f"WITH {FINDINGS} SELECT * FROM findings")
def semantic_quality_findings(spark, d):
    return qu.semantic_findings(_units(spark, d), ["source", "line_no"])


@query(f"WITH {FINDINGS} SELECT code, severity, count(*) AS findings FROM findings GROUP BY ALL")
def quality_report(spark, d):
    return qu.semantic_findings(_units(spark, d), ["source", "line_no"]).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query(f"WITH {FINDINGS} SELECT count_if(severity = 'blocking') AS blocking, count_if(severity = 'warning') AS warnings, CASE WHEN count_if(severity = 'blocking') > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM findings")
def quality_status(spark, d):
    return qu.report_status(qu.semantic_findings(_units(spark, d), ["source", "line_no"]))


@query(r"""SELECT doc_id, source FROM documents d ANTI JOIN (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE len(list_filter(regexp_split_to_array(l, '\s+'), lambda x: x <> '')) >= 40) u USING (doc_id)""")
def zero_unit_sources(spark, d):
    used = _units(spark, d).where(tx.word_count(F.col("text")) >= 40).select(F.col("source").alias("doc_id")).distinct()
    return table(spark, d, "documents").select("doc_id", "source").join(used, "doc_id", "left_anti")


@query(r"""SELECT l.quality, count(*) AS docs, round(avg(length(d.text)), 4) AS mean_chars, count_if(len(regexp_extract_all(d.text, '[\p{L}\p{Nd}]+')) < 50) AS short FROM labels l JOIN documents d USING (doc_id) GROUP BY l.quality""")
def labelled_quality(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return table(spark, d, "labels").join(docs, "doc_id").groupBy("quality").agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.count_if(tx.semantic_tokens(F.col("text")) < 50).alias("short"))


# -- chunks and exports ---------------------------------------------------------------------------------------------

CHUNKS = f"""chunks AS (SELECT 'chunk-' || substr(sha256(CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END || chr(0) || 'doc/' || doc_id || chr(0) || text), 1, 16) AS chunk_id, CASE WHEN doc_id % 29 = 0 THEN '' ELSE source END AS source_id,
 CASE WHEN doc_id % 31 = 0 THEN '' ELSE sha256(source || text) END AS source_hash, CASE WHEN doc_id % 37 = 0 THEN '  ' ELSE text END AS body, lang, doc_id, text,
 array_to_string(list_filter([CASE WHEN doc_id % 29 = 0 THEN NULL ELSE source END, lang, 'part ' || (doc_id % 4) || ' › section ' || (doc_id % 3)], lambda x: x IS NOT NULL), ' · ') AS context_prefix FROM documents)"""


def _chunks(spark, d):
    doc = table(spark, d, "documents")
    src = F.when(F.col("doc_id") % 29 == 0, "").otherwise(F.col("source"))
    none = F.lit(None).cast("string")
    heads = F.array(F.concat(F.lit("part "), F.col("doc_id") % 4), F.concat(F.lit("section "), F.col("doc_id") % 3))
    return doc.select(
        tx.chunk_id(src, F.concat(F.lit("doc/"), F.col("doc_id")), F.col("text")).alias("chunk_id"), src.alias("source_id"), F.when(F.col("doc_id") % 31 == 0, "").otherwise(tx.raw_hash(F.concat("source", "text"))).alias("source_hash"),
        F.when(F.col("doc_id") % 37 == 0, "  ").otherwise(F.col("text")).alias("body"), "lang", "doc_id", "text",
        tx.context_prefix(src, none, F.col("lang"), heads, none, F.lit(0), F.array().cast("array<string>"), none).alias("context_prefix"),
    )


@query(f"WITH {CHUNKS} SELECT chunk_id, length(text) AS char_count, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS token_count, greatest(CAST(floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) * 1.33::DOUBLE) AS BIGINT), 1) AS governed_tokens, sha256({NORM.format('text')}) AS normalized_hash FROM chunks")
def chunk_enrich(spark, d):
    return _chunks(spark, d).select("chunk_id", F.length("text").cast("long").alias("char_count"), tx.tokens_by_chars(F.length("text")).alias("token_count"), tx.tokens_by_words(F.col("text")).alias("governed_tokens"), tx.normalized_hash(F.col("text")).alias("normalized_hash"))


@query(f"WITH {CHUNKS} SELECT chunk_id, context_prefix FROM chunks")
def context_prefix(spark, d):
    return _chunks(spark, d).select("chunk_id", "context_prefix")


RECORDS = f"""{CHUNKS}, out_ AS (SELECT *, CASE WHEN trim(source_id) = '' THEN 'missing_source_id' WHEN trim(source_hash) = '' THEN 'missing_source_hash' WHEN trim(body) = '' THEN 'empty_body' END AS rejection FROM chunks),
records AS (SELECT chunk_id, source_id, source_hash, lang, doc_id, context_prefix, sha256(trim(body)) AS body_hash, sha256(context_prefix || chr(10) || chr(10) || trim(body)) AS embedding_hash FROM out_ WHERE rejection IS NULL)"""


def _records(spark, d):
    return qu.export_outcome(_chunks(spark, d))


@query(f"WITH {RECORDS} SELECT chunk_id, source_id, source_hash, body_hash, embedding_hash FROM records")
def rag_export(spark, d):
    return qu.export_records(_records(spark, d)).select("chunk_id", "source_id", "source_hash", "body_hash", "embedding_hash")


@query(f"WITH {RECORDS} SELECT chunk_id, rejection AS code FROM out_ WHERE rejection IS NOT NULL")
def rag_rejections(spark, d):
    return _records(spark, d).where("rejection is not null").select("chunk_id", F.col("rejection").alias("code"))


MANIFEST = "SELECT source_id, arg_min(source_hash, chunk_id) AS source_hash, count(*) AS chunk_count, sha256(string_agg(chunk_id || chr(0) || source_hash || chr(0) || embedding_hash || chr(0), '' ORDER BY chunk_id)) AS chunk_digest FROM {0} GROUP BY source_id"


@query(f"WITH {RECORDS} " + MANIFEST.format("records"))
def rag_manifest_sources(spark, d):
    return sn.manifest_sources(qu.export_records(_records(spark, d)))


@query(f"""WITH {RECORDS}, long AS (SELECT chunk_id, 'source_id' AS field, source_id AS value FROM records UNION ALL SELECT chunk_id, 'lang', lang FROM records UNION ALL SELECT chunk_id, 'tags', unnest(list_filter([lang, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE '' END], lambda x: x <> '')) FROM records)
SELECT field, count(DISTINCT chunk_id) AS records, count(DISTINCT value) AS distinct_values, string_agg(DISTINCT value, ',' ORDER BY value) AS vocabulary FROM long GROUP BY field""")
def retrieval_contract(spark, d):
    rec = qu.export_records(_records(spark, d)).withColumn("tags", F.array("lang", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("")))
    return sn.retrieval_contract(rec, ["source_id", "lang", "tags"])


def _versions(spark, d):
    rec = qu.export_records(_records(spark, d))
    changed = F.when(F.col("doc_id") % 17 == 0, F.sha2(F.concat("body_hash", F.lit("x")), 256)).otherwise(F.col("body_hash"))
    emb = F.when(F.col("doc_id") % 17 == 0, F.sha2(F.concat("embedding_hash", F.lit("x")), 256)).when(F.col("doc_id") % 19 == 0, F.sha2(F.concat("embedding_hash", F.lit("y")), 256)).otherwise(F.col("embedding_hash"))
    src = F.when(F.col("doc_id") % 23 == 0, F.sha2(F.concat("source_hash", F.lit("z")), 256)).otherwise(F.col("source_hash"))
    new = rec.where("doc_id % 5 <> 1").withColumns({"body_hash": changed, "embedding_hash": emb, "source_hash": src})
    return rec.where("doc_id % 5 <> 2"), new


VERSIONS = f"""{RECORDS}, o AS (SELECT * FROM records WHERE doc_id % 5 <> 2), n AS (SELECT chunk_id, source_id, CASE WHEN doc_id % 23 = 0 THEN sha256(source_hash || 'z') ELSE source_hash END AS source_hash, CASE WHEN doc_id % 17 = 0 THEN sha256(body_hash || 'x') ELSE body_hash END AS body_hash,
 CASE WHEN doc_id % 17 = 0 THEN sha256(embedding_hash || 'x') WHEN doc_id % 19 = 0 THEN sha256(embedding_hash || 'y') ELSE embedding_hash END AS embedding_hash FROM records WHERE doc_id % 5 <> 1),
j AS (SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, coalesce(n.source_id, o.source_id) AS source_id, CASE WHEN n.chunk_id IS NULL THEN 'removed' WHEN o.chunk_id IS NULL THEN 'added' WHEN o.body_hash <> n.body_hash THEN 'body_changed' WHEN o.embedding_hash <> n.embedding_hash THEN 'context_changed' WHEN o.source_hash <> n.source_hash THEN 'source_hash_changed' END AS reason FROM o FULL JOIN n ON o.chunk_id = n.chunk_id)"""


@query(f"WITH {VERSIONS} SELECT chunk_id, source_id, CASE reason WHEN 'removed' THEN 'delete' WHEN 'source_hash_changed' THEN 'update_metadata' ELSE 'embed' END AS action, reason FROM j WHERE reason IS NOT NULL")
def rag_delta(spark, d):
    return sn.chunk_delta(*_versions(spark, d))


@query(f"WITH {VERSIONS} SELECT CASE reason WHEN 'removed' THEN 'delete' WHEN 'source_hash_changed' THEN 'update_metadata' ELSE 'embed' END AS action, reason, count(*) AS chunks FROM j WHERE reason IS NOT NULL GROUP BY ALL")
def rag_delta_summary(spark, d):
    return sn.chunk_delta(*_versions(spark, d)).groupBy("action", "reason").agg(F.count(F.lit(1)).alias("chunks"))


@query(f"""WITH {VERSIONS}, a AS ({MANIFEST.format('o')}), b AS ({MANIFEST.format('n')})
SELECT coalesce(a.source_id, b.source_id) AS source_id, CASE WHEN a.source_id IS NULL THEN 'added' WHEN b.source_id IS NULL THEN 'removed' WHEN a.source_hash <> b.source_hash OR a.chunk_digest <> b.chunk_digest THEN 'changed' ELSE 'unchanged' END AS status, coalesce(a.chunk_count, 0) AS old_chunks, coalesce(b.chunk_count, 0) AS new_chunks FROM a FULL JOIN b ON a.source_id = b.source_id""")
def rag_delta_sources(spark, d):
    old, new = _versions(spark, d)
    return sn.source_delta(sn.manifest_sources(old), sn.manifest_sources(new))


# -- facets and lenses ----------------------------------------------------------------------------------------------

LENS = {"include": {"all_of": [{"nature": ["rule", "definition"]}], "any_of": [{"activity": ["audit"]}, {"confidentiality": ["public"]}], "none_of": [{"trust_tier": ["certified"]}]}, "exclude": {"any_of": [{"risk_tier": ["high"], "confidentiality": ["secret"]}, {"applicability": ["blocked"]}]}}
FACETS = """f AS (SELECT d.doc_id, (['rule','rule','definition','evidence','context'])[d.doc_id % 5 + 1] AS nature, CASE WHEN l.quality = 1 THEN 'indicative' ELSE 'unverified' END AS trust_tier, CASE WHEN d.doc_id % 10 = 0 THEN 'derived' ELSE 'source_backed' END AS provenance,
 CASE WHEN l.toxic = 1 THEN 'secret' WHEN d.doc_id % 3 = 0 THEN 'public' WHEN d.doc_id % 41 = 0 THEN 'open' ELSE 'internal' END AS confidentiality, CASE WHEN d.doc_id % 12 = 5 THEN 'blocked' ELSE 'applicable' END AS applicability,
 CASE WHEN d.doc_id % 4 = 1 THEN ['audit', d.lang] ELSE [d.lang] END AS activity, CASE WHEN d.doc_id % 43 = 0 THEN CAST([] AS VARCHAR[]) WHEN d.doc_id % 2 = 0 THEN ['high'] END AS risk_tier FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _facets(spark, d):
    kind = F.expr("element_at(array('clause','list_item','definition','table','meta'), cast(doc_id % 5 + 1 as int))")
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    return rows.select(
        "doc_id", ln.derived_nature(kind).alias("nature"), F.when(F.col("quality") == 1, "indicative").otherwise("unverified").alias("trust_tier"), F.when(F.col("doc_id") % 10 == 0, "derived").otherwise("source_backed").alias("provenance"),
        F.when(F.col("toxic") == 1, "secret").when(F.col("doc_id") % 3 == 0, "public").when(F.col("doc_id") % 41 == 0, "open").otherwise("internal").alias("confidentiality"), F.when(F.col("doc_id") % 12 == 5, "blocked").otherwise("applicable").alias("applicability"),
        F.when(F.col("doc_id") % 4 == 1, F.array(F.lit("audit"), "lang")).otherwise(F.array("lang")).alias("activity"), F.expr("CASE WHEN doc_id % 43 = 0 THEN cast(array() as array<string>) WHEN doc_id % 2 = 0 THEN array('high') END").alias("risk_tier"),
    )


def _columns(df):
    return {c: F.col(c) for c in df.columns if c in ln.VOCABULARY or c in ln.LISTS}


@query(f"WITH {FACETS} SELECT doc_id, nature, trust_tier, provenance, confidentiality, applicability, array_to_string(activity, ',') AS activity FROM f")
def facet_derive(spark, d):
    return _facets(spark, d).select("doc_id", "nature", "trust_tier", "provenance", "confidentiality", "applicability", F.array_join("activity", ",").alias("activity"))


@query(f"WITH {FACETS} SELECT doc_id, CASE WHEN confidentiality = 'open' THEN 'confidentiality' ELSE 'risk_tier' END AS axis FROM f WHERE confidentiality = 'open' OR len(risk_tier) = 0")
def facet_validation(spark, d):
    f = _facets(spark, d)
    return f.withColumn("axis", ln.facet_errors(_columns(f))).where("axis is not null").select("doc_id", "axis")


REASON = """r AS (SELECT doc_id, CASE WHEN coalesce(list_contains(risk_tier, 'high'), false) AND confidentiality = 'secret' THEN 'excluded_by_facets.confidentiality' WHEN applicability = 'blocked' THEN 'excluded_by_facets.applicability' WHEN nature NOT IN ('rule', 'definition') THEN 'not_selected_by_lens'
 WHEN NOT (list_contains(activity, 'audit') OR confidentiality = 'public') THEN 'not_selected_by_lens' WHEN trust_tier = 'certified' THEN 'not_selected_by_lens' END AS reason FROM f)"""


@query(f"WITH {FACETS}, {REASON} SELECT doc_id FROM r WHERE reason IS NULL")
def lens_scope(spark, d):
    f = _facets(spark, d)
    return f.where(ln.lens_reason(_columns(f), LENS).isNull()).select("doc_id")


@query(f"WITH {FACETS}, {REASON} SELECT doc_id, reason FROM r WHERE reason IS NOT NULL")
def lens_exclusions(spark, d):
    f = _facets(spark, d)
    return f.withColumn("reason", ln.lens_reason(_columns(f), LENS)).where("reason is not null").select("doc_id", "reason")


@query(f"""WITH {FACETS}, o AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'restricted' ELSE '' END AS c, CASE WHEN doc_id % 6 = 1 THEN ['review'] ELSE CAST([] AS VARCHAR[]) END AS a FROM documents WHERE doc_id % 3 <> 2)
SELECT f.doc_id, coalesce(nullif(o.c, ''), f.confidentiality) AS confidentiality, array_to_string(CASE WHEN len(o.a) > 0 THEN o.a ELSE f.activity END, ',') AS activity FROM f LEFT JOIN o USING (doc_id)""")
def facet_merge(spark, d):
    over = table(spark, d, "documents").where("doc_id % 3 <> 2").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "restricted").otherwise("").alias("c"), F.expr("if(doc_id % 6 = 1, array('review'), cast(array() as array<string>))").alias("a"))
    return _facets(spark, d).join(over, "doc_id", "left").select("doc_id", ln.merged(F.col("c"), F.col("confidentiality")).alias("confidentiality"), F.array_join(ln.merged_list(F.col("a"), F.col("activity")), ",").alias("activity"))


# -- headings -------------------------------------------------------------------------------------------------------

HEADINGS = """h AS (SELECT p_brand AS doc, p_partkey AS ord, CAST(CASE WHEN p_partkey % 7 = 0 THEN 1 WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS INTEGER) AS level, p_name AS title FROM part)"""


def _headings(spark, d):
    level = F.when(F.col("p_partkey") % 7 == 0, 1).when(F.col("p_size") % 3 == 0, 2).otherwise(3)
    return table(spark, d, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), level.alias("level"), F.col("p_name").alias("title"))


@query(f"""WITH {HEADINGS}, w AS (SELECT *, max(CASE WHEN level = 1 THEN ord END) OVER q AS o1, max(CASE WHEN level = 2 THEN ord END) OVER q AS o2, max(CASE WHEN level = 3 THEN ord END) OVER q AS o3 FROM h WINDOW q AS (PARTITION BY doc ORDER BY ord ROWS UNBOUNDED PRECEDING))
SELECT w.doc, w.ord, concat_ws('/', a.title, CASE WHEN o2 > coalesce(o1, -1) THEN b.title END, CASE WHEN o3 > greatest(coalesce(o1, -1), coalesce(o2, -1)) THEN c.title END) AS path
FROM w LEFT JOIN h a ON a.doc = w.doc AND a.ord = o1 LEFT JOIN h b ON b.doc = w.doc AND b.ord = o2 LEFT JOIN h c ON c.doc = w.doc AND c.ord = o3""")
def heading_path(spark, d):
    return hd.heading_paths(_headings(spark, d)).select("doc", "ord", F.array_join("path", "/").alias("path"))


TOC = f"""{HEADINGS}, p AS (SELECT *, CASE WHEN level = 1 THEN NULL WHEN level = 2 THEN max(CASE WHEN level = 1 THEN ord END) OVER q ELSE max(CASE WHEN level <= 2 THEN ord END) OVER q END AS parent FROM h WINDOW q AS (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc, parent ORDER BY ord) AS nth FROM p),
toc AS (SELECT k.doc, k.ord, k.level, k.title, k.parent, concat_ws('.', b.nth, a.nth, k.nth) AS number, (SELECT count(*) FROM k c WHERE c.doc = k.doc AND c.parent = k.ord) AS children FROM k LEFT JOIN k a ON a.doc = k.doc AND a.ord = k.parent LEFT JOIN k b ON b.doc = a.doc AND b.ord = a.parent)"""


@query(f"WITH {TOC} SELECT doc, ord, number, parent, children FROM toc")
def certified_toc(spark, d):
    return hd.numbered_toc(_headings(spark, d)).select("doc", "ord", "number", "parent", "children")


@query(f"""WITH {TOC}, a AS (SELECT doc, number, title, level, sha256(title) AS hash FROM toc), b AS (SELECT doc, number, CASE WHEN ord % 9 = 0 THEN title || '!' ELSE title END AS title, level, sha256(CASE WHEN ord % 9 = 0 OR ord % 10 = 0 THEN title || '!' ELSE title END) AS hash FROM toc WHERE ord % 8 <> 0)
SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.number, b.number) AS number, CASE WHEN b.level IS NULL THEN 'removed' WHEN a.level IS NULL THEN 'added' ELSE concat_ws(',', CASE WHEN a.title <> b.title THEN 'renamed' END, CASE WHEN a.level <> b.level THEN 'depth_changed' END, CASE WHEN a.hash <> b.hash THEN 'hash_changed' END) END AS codes
FROM a FULL JOIN b ON a.doc = b.doc AND a.number = b.number WHERE b.level IS NULL OR a.level IS NULL OR a.title <> b.title OR a.hash <> b.hash""")
def toc_drift(spark, d):
    toc = hd.numbered_toc(_headings(spark, d))
    a = toc.select("doc", "number", "title", "level", F.sha2("title", 256).alias("hash"))
    new = lambda *m: F.when(F.greatest(*(F.col("ord") % k == 0 for k in m)) if len(m) > 1 else F.col("ord") % m[0] == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    b = toc.where("ord % 8 <> 0").select("doc", "number", new(9).alias("title"), "level", F.sha2(new(9, 10), 256).alias("hash"))
    return hd.toc_drift(a, b)


@query(f"WITH {HEADINGS}, l AS (SELECT *, lag(level) OVER (PARTITION BY doc ORDER BY ord) AS previous FROM h) SELECT doc, ord, level, previous FROM l WHERE level > previous + 1")
def hierarchy_jumps(spark, d):
    return hd.depth_jumps(_headings(spark, d)).select("doc", "ord", "level", "previous")


@query("WITH p AS (SELECT url, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)?', 1) AS path FROM pages) SELECT url, path, regexp_matches(path, '^(.*/)?[^/]*1[^/]*$') AS selected FROM p")
def glob_scope(spark, d):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)?", 1)
    return table(spark, d, "pages").select("url", path.alias("path"), path.rlike(glob_regex("**/*1*")).alias("selected"))
