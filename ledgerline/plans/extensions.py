"""Queries on Markdown below block level and on the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import extensions as ex
from ledgerline.operators import inline as il
from ledgerline.operators import segments as sg

from .corpus import FILES, LINES, _kinds, files, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


MARKED = f"""{LINES}, marked AS (SELECT doc_id AS source, line_no, start_byte, line || ' [see é](x/' || line_no || ') and ![' || kind || ']( p.png)' AS line, CASE WHEN line_no % 3 = 0 THEN '| ' || kind || ' | é' || line_no || ' |' ELSE kind || '|b' END AS row_,
  CASE line_no % 3 WHEN 0 THEN '  - ' WHEN 1 THEN '12. ' ELSE '' END || 'item ' || kind AS item FROM kinds)"""
REFERENCE = r"(!?)\[([^\]\n]*)\]\(([^)\n]*)\)"


def _marked(spark, d, line):
    return _kinds(spark, d).select("source", "line_no", "start_byte", line.alias("line"))


@query(rf"""WITH {MARKED}, m AS (SELECT source, line_no, start_byte, line, unnest(generate_series(1, len(regexp_extract_all(line, '{REFERENCE}')))) AS i, regexp_extract_all(line, '{REFERENCE}') AS m0, regexp_extract_all(line, '{REFERENCE}', 1) AS m1, regexp_extract_all(line, '{REFERENCE}', 2) AS m2, regexp_extract_all(line, '{REFERENCE}', 3) AS m3, regexp_split_to_array(line, '{REFERENCE}') AS gaps FROM marked),
s AS (SELECT *, start_byte + list_sum(list_transform(gaps[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(m0[1:i - 1], lambda x: strlen(x))), 0) AS spot FROM m)
SELECT source, CAST(line_no AS BIGINT) AS line_no, CASE m1[i] WHEN '!' THEN 'image_ref' ELSE 'link' END AS kind, m2[i] AS label, trim(m3[i]) AS target, CAST(spot AS BIGINT) AS start_byte, CAST(spot + strlen(m0[i]) AS BIGINT) AS end_byte FROM s""")
def inline_references(spark, d):
    return il.inline_references(_marked(spark, d, F.concat("line", F.lit(" [see é](x/"), "line_no", F.lit(") and !["), "kind", F.lit("]( p.png)"))))


@query(rf"""WITH {MARKED}, c AS (SELECT source, line_no, start_byte, string_split(row_, '|') AS parts, unnest(generate_series(0, len(string_split(row_, '|')) - 1)) AS i FROM marked)
SELECT source, CAST(line_no AS BIGINT) AS line_no, CAST(i AS INTEGER) AS cell_no, trim(parts[i + 1]) AS text, CAST(start_byte + coalesce(list_sum(list_transform(parts[1:i], lambda x: strlen(x) + 1)), 0) AS BIGINT) AS start_byte,
 CAST(start_byte + coalesce(list_sum(list_transform(parts[1:i], lambda x: strlen(x) + 1)), 0) + strlen(parts[i + 1]) AS BIGINT) AS end_byte FROM c WHERE NOT (trim(parts[i + 1]) = '' AND i IN (0, len(parts) - 1))""")
def table_cells(spark, d):
    row = F.when(F.col("line_no") % 3 == 0, F.concat(F.lit("| "), "kind", F.lit(" | é"), "line_no", F.lit(" |"))).otherwise(F.concat("kind", F.lit("|b")))
    return il.table_cells(_marked(spark, d, row))


@query(f"""WITH {MARKED} SELECT source, CAST(line_no AS BIGINT) AS line_no, CASE line_no % 3 WHEN 0 THEN '-' ELSE '12.' END AS marker, CASE line_no % 3 WHEN 0 THEN 1 ELSE 0 END AS depth, substr(item, 5) AS text, CAST(start_byte + 4 AS BIGINT) AS start_byte, CAST(start_byte + strlen(item) AS BIGINT) AS end_byte FROM marked WHERE line_no % 3 < 2""")
def list_items(spark, d):
    return il.list_items(_marked(spark, d, F.concat(F.when(F.col("line_no") % 3 == 0, "  - ").when(F.col("line_no") % 3 == 1, "12. ").otherwise(""), F.lit("item "), "kind")))


def _share_of_words(premise, hypothesis):
    return [len(set(h.split()) & set(p.split())) / max(1, len(set(h.split()))) for p, h in zip(premise, hypothesis)]


@query(r"""WITH p AS (SELECT conv_id || '/' || turn AS id, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS h FROM conversations), w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(h, '\s+'), lambda x: x <> '')) AS b FROM p WHERE h IS NOT NULL)
SELECT id, len(list_intersect(a, b)) / greatest(1, len(b))::DOUBLE AS score FROM w""")
def scored_pairs(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "conversations")
    pairs = c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("premise"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("hypothesis")).where("hypothesis is not null")
    return ex.score_pairs(pairs, _share_of_words)


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 7 = 1 THEN 'unknown_id' WHEN doc_id % 7 = 2 THEN 'duplicate' ELSE 'out_of_range' END AS fault FROM documents WHERE doc_id % 7 <= 3""")
def score_faults(spark, d):
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id")
    scores = docs.where(k % 7 != 0).select(k.alias("id"), F.when(k % 7 == 3, 1.5).otherwise(0.5).alias("score"), F.explode(F.when(k % 7 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("col")
    return ex.score_faults(docs.where(k % 7 != 1).select(k.alias("id")), scores)


@query("""WITH f AS (SELECT o_orderkey, unnest([('priced', 'o_totalprice > 100000', o_totalprice > 100000), ('open', 'o_orderstatus = ''O''', o_orderstatus = 'O')]) AS r FROM orders)
SELECT o_orderkey, r[1] AS rule, r[3] AS holds, sha256(r[1] || chr(10) || r[2] || chr(10) || o_orderkey || chr(10) || r[3]) AS digest FROM f""")
def evaluated_rules(spark, d):
    return ex.evaluate_rules(table(spark, d, "orders"), "o_orderkey", {"priced": "o_totalprice > 100000", "open": "o_orderstatus = 'O'"})


def _adapters() -> ex.Adapters:
    def lines(own):
        rows = sg.line_ledger(own, "path")
        return rows.select(F.col("source").alias("path"), sg.disposition(F.col("line")).alias("kind"), F.col("line").alias("text"), "start_byte", F.col("end_byte").cast("long").alias("end_byte"))

    def whole(own):
        return own.select("path", F.lit("metadata").alias("kind"), "text", F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"))

    out = ex.Adapters()
    out.register("md", lines)
    out.register("yaml", whole)
    return out


@query(f"""WITH {LINES}, {FILES}, s AS (SELECT path, kind, end_byte - start_byte AS size FROM kinds JOIN files USING (doc_id) WHERE ends_with(path, '.md') UNION ALL SELECT path, CASE WHEN ends_with(path, '.yaml') THEN 'metadata' ELSE 'unsupported_block' END, strlen(text) FROM files WHERE NOT ends_with(path, '.md'))
SELECT path, kind, count(*) AS segments, CAST(sum(size) AS BIGINT) AS bytes FROM s GROUP BY ALL""")
def adapter_segments(spark, d):
    parsed = _adapters().parse(files(spark, d).select("path", "text"))
    return parsed.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.col("end_byte") - F.col("start_byte")).alias("bytes"))


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 5 = 0 THEN 'span_outside' ELSE 'bytes_differ' END AS fault FROM files WHERE ends_with(path, '.yaml') AND doc_id % 5 <= 1")
def adapter_faults(spark, d):
    own = files(spark, d).select("path", "text", "doc_id")
    parsed = _adapters().parse(own.select("path", "text")).join(own.select("path", "doc_id"), "path")
    yaml = F.col("path").endswith(".yaml")
    broken = parsed.withColumn("end_byte", F.when(yaml & (F.col("doc_id") % 5 == 0), F.col("end_byte") + 1).otherwise(F.col("end_byte"))).withColumn("text", F.when(yaml & (F.col("doc_id") % 5 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return ex.contract_faults(broken.drop("doc_id"), own)


@query(f"WITH {LINES} SELECT doc_id AS source, CAST(line_no AS BIGINT) AS position, CASE kind WHEN 'paragraph' THEN 'rule' ELSE 'item' END AS atom_type, line AS text FROM kinds WHERE strlen(trim(line)) >= 30 AND line_no % 6 <= 4 AND kind IN ('paragraph', 'list_item')")
def profile_atoms(spark, d):
    units = _kinds(spark, d).select("source", F.col("line_no").alias("position"), "kind", (F.col("line_no") % 6).alias("level"), F.col("line").alias("text"))
    return ex.AtomizationProfile({"paragraph": "rule", "list_item": "item"}, 30, 4).atoms(units)


@query(f"""WITH {LINES}, s AS (SELECT doc_id, list_distinct(list(kind)) AS seen FROM kinds GROUP BY doc_id), f AS (SELECT doc_id, unnest(list_filter([CASE WHEN NOT list_contains(seen, 'table') THEN 'missing table' END, CASE WHEN NOT list_contains(seen, 'paragraph') THEN 'missing paragraph' END, CASE WHEN len(list_filter(seen, lambda x: x NOT IN ('table', 'paragraph', 'blank'))) > 0 THEN 'unknown kind' END], lambda x: x IS NOT NULL)) AS fault FROM s) SELECT doc_id AS source, fault FROM f""")
def hierarchy_faults(spark, d):
    return ex.HierarchyProfile({"table": 1, "paragraph": 2, "blank": 9}, ("table", "paragraph")).faults(_kinds(spark, d).select("source", "kind"))
