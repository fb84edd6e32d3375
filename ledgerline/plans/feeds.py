"""Queries on portable atoms, feeds of nodes, conformance and the strict gate, over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.operators import conformance as cf
from ledgerline.operators import feeds as fd
from ledgerline.sources.shared import ensure_checkpoints

from .corpus import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _one_of(n: Column, values: list) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (n % len(values) + 1).cast("int"))


def _lines(spark, d):
    ensure_checkpoints(spark)
    return table(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))


LINES = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)"

# -- atoms ----------------------------------------------------------------------------------------------------------

KINDS = ["heading", "paragraph", "list_item", "table", "paragraph"]
UNITS = f"""{LINES}, u AS (SELECT doc_id, source, 'u' || doc_id || '.' || p AS unit_id, ({KINDS})[p % 5 + 1] AS type, line AS text, p % 9 AS level, CASE WHEN p % 5 <> 0 THEN 'u' || doc_id || '.' || (p - p % 5) END AS parent_id, p + 1 AS line FROM l)"""


def _units(spark, d):
    p, named = F.col("p"), lambda at: F.concat(F.lit("u"), "doc_id", F.lit("."), at)
    return _lines(spark, d).select(
        F.col("doc_id").alias("source"), F.col("source").alias("origin"), named(p).alias("unit_id"), _one_of(p, KINDS).alias("type"), F.col("line").alias("text"), (p % 9).alias("level"), F.when(p % 5 != 0, named(p - p % 5)).alias("parent_id"), (p + 1).alias("line")
    )


ATOMS = f"""{UNITS}, a AS (SELECT doc_id AS source, 'RBOK.' || upper(unit_id) AS atom_id, CASE WHEN type = 'heading' THEN regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') ELSE unit_id END AS canonical_ref,
 CASE type WHEN 'heading' THEN 'clause' WHEN 'paragraph' THEN 'rule' ELSE 'provision' END AS type, text, 'sha256:' || sha256(text) AS content_hash, level AS depth, parent_id, line AS source_line FROM (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM u) WHERE strlen(text) >= 5 AND level <= 6 AND type <> 'table')"""


@query(f"WITH {ATOMS} SELECT source, atom_id, canonical_ref, type, content_hash, CAST(depth AS INTEGER) AS depth, parent_id, 'legal' AS domain, 'rbok' AS profile, CAST(source_line AS INTEGER) AS source_line FROM a")
def portable_atoms(spark, d):
    """An atom for every line that the profile takes, by the place of the line for its kind."""
    return fd.portable_atoms(_units(spark, d), "rbok").drop("text")


@query(f"""WITH {UNITS}, e AS (SELECT source, doc_id * 1000000 + line AS line, 'LEGAL.' || upper(unit_id) AS atom, upper(unit_id) AS unit, coalesce(parent_id, '') AS parent, strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 10 AND level <= 4 AND type IN ('heading', 'paragraph') AS emits FROM u),
o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY line) - 1 AS place, sha256(atom || '|' || unit || '|' || parent) AS digest FROM e WHERE emits), b AS (SELECT source, place // 1024 AS b, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM o GROUP BY ALL),
h AS (SELECT source, CASE WHEN count(*) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY b)) END AS matrix_hash FROM b GROUP BY source)
SELECT e.source, count_if(emits) AS total_atoms, count(*) AS total_source, count_if(emits) / count(*) AS coverage, any_value(h.matrix_hash) AS matrix_hash FROM e LEFT JOIN h USING (source) GROUP BY e.source""")
def trace_matrices(spark, d):
    """The matrix of each source over all its documents; entries are folded in blocks."""
    units = _units(spark, d).withColumn("line", F.col("source") * 1_000_000 + F.col("line")).withColumn("source", F.col("origin"))
    return fd.trace_matrices(units, "legal")


# -- feeds ----------------------------------------------------------------------------------------------------------

TYPES, STATES, RANKS = ["document", "chapter", "section", "article", "table"], ["active", "amended", "", "gone", "repealed"], ["high", None, "low"]
NODES = f"""{LINES}, i AS (SELECT *, 'N' || upper(substr(sha256(line), 1, 10)) AS node_id FROM l),
n AS (SELECT i.source AS feed, i.doc_id * 1000000 + i.p AS ord, i.node_id, u.node_id AS parent_id, ({TYPES})[i.p % 5 + 1] AS node_type, i.p % 4 AS depth, substr(i.line, 1, 8) AS canonical_ref, substr(i.line, 1, 5) || (i.p % 3) AS display_ref, CASE WHEN (i.doc_id + i.p) % 17 = 5 THEN '9.' || i.p ELSE '' END AS ordinal_path,
 '' AS document_id, CASE WHEN i.p % 2 = 0 THEN '' ELSE 'sha256:ab' END AS source_hash, CASE WHEN i.p % 4 = 0 THEN '' ELSE 'd' END AS domain, ({STATES})[(i.doc_id + i.p) % 5 + 1] AS status, CASE (i.doc_id + i.p) % 3 WHEN 0 THEN 'high' WHEN 2 THEN 'low' END AS priority
 FROM i LEFT JOIN i AS u ON u.doc_id = i.doc_id AND i.p > 0 AND u.p = (i.p - 1) // 3)"""


def _nodes(spark, d):
    """The lines of a source's documents as the nodes of its feed, each below the line at a third of its place; equal lines have one id, in one feed or several."""
    lines = _lines(spark, d).withColumn("node_id", F.concat(F.lit("N"), F.upper(F.substring(F.sha2("line", 256), 1, 10))))
    above = lines.select("doc_id", F.col("p").alias("q"), F.col("node_id").alias("parent_id"))
    p, both = F.col("p"), F.col("doc_id") + F.col("p")
    return lines.withColumn("q", F.when(p > 0, F.floor((p - 1) / 3))).join(above, ["doc_id", "q"], "left").select(
        F.col("source").alias("feed"), (F.col("doc_id") * 1_000_000 + p).alias("ord"), "node_id", "parent_id", _one_of(p, TYPES).alias("node_type"), (p % 4).alias("depth"), F.substring("line", 1, 8).alias("canonical_ref"), F.concat(F.substring("line", 1, 5), p % 3).alias("display_ref"),
        F.when(both % 17 == 5, F.concat(F.lit("9."), p)).otherwise("").alias("ordinal_path"), F.lit("").alias("document_id"), F.when(p % 2 == 0, "").otherwise("sha256:ab").alias("source_hash"), F.when(p % 4 == 0, "").otherwise("d").alias("domain"),
        _one_of(both, STATES).alias("status"), _one_of(both, RANKS).alias("priority"),
    )


def _feeds(spark, d):
    return table(spark, d, "documents").select(F.col("source").alias("feed")).distinct()


@query(f"""WITH RECURSIVE {NODES}, s AS (SELECT *, row_number() OVER (PARTITION BY feed, coalesce(parent_id, '') ORDER BY ord) AS place FROM n), f AS (SELECT feed, node_id AS parent_id, min(ord) AS first FROM n GROUP BY ALL),
u AS (SELECT s.feed, s.ord, s.ordinal_path AS stated, CAST(place AS VARCHAR) AS place, CASE WHEN s.ordinal_path = '' AND f.first < s.ord THEN f.first END AS up FROM s LEFT JOIN f ON f.feed = s.feed AND f.parent_id = s.parent_id),
r(feed, ord, path) AS (SELECT feed, ord, CASE WHEN stated <> '' THEN stated ELSE place END FROM u WHERE up IS NULL UNION ALL SELECT u.feed, u.ord, r.path || '.' || u.place FROM r JOIN u ON u.feed = r.feed AND u.up = r.ord),
x AS (SELECT n.*, r.path, n.feed <> 'src7' AS has, CASE node_type WHEN 'document' THEN 0 WHEN 'chapter' THEN 1 WHEN 'section' THEN 2 WHEN 'article' THEN 4 ELSE depth END AS right_depth, status NOT IN ('active', 'amended', 'repealed') AS no_status FROM n JOIN r USING (feed, ord))
SELECT feed, ord, node_id, parent_id, node_type, CAST(right_depth AS INTEGER) AS depth, canonical_ref, display_ref, path AS ordinal_path, CASE WHEN has THEN 'DOC-' || feed ELSE '' END AS document_id, CASE WHEN has AND source_hash = '' THEN 'sha256:00' ELSE source_hash END AS source_hash,
 CASE WHEN has AND domain = '' THEN 'general' ELSE domain END AS domain, CASE WHEN has AND no_status THEN 'draft' ELSE status END AS status, CASE WHEN has AND priority IS NULL THEN 'medium' ELSE priority END AS priority,
 concat_ws(',', CASE WHEN has THEN 'document_id' END, CASE WHEN has AND source_hash = '' THEN 'source_hash' END, CASE WHEN has AND domain = '' THEN 'domain' END, CASE WHEN has AND no_status THEN 'status' END, CASE WHEN has AND priority IS NULL THEN 'priority' END,
  CASE WHEN right_depth <> depth THEN 'depth' END, CASE WHEN ordinal_path = '' THEN 'ordinal_path' END) AS filled FROM x""")
def normalised_nodes(spark, d):
    """Every feed has defaults but one."""
    feed = F.col("feed")
    defaults = _feeds(spark, d).where("feed <> 'src7'").select("feed", F.concat(F.lit("DOC-"), feed).alias("document_id"), F.lit("sha256:00").alias("source_hash"), F.lit("general").alias("domain"), F.lit("draft").alias("status"), F.lit("medium").alias("priority"))
    return fd.normalised_nodes(_nodes(spark, d), defaults).withColumn("filled", F.array_join("filled", ","))


@query(f"WITH {NODES}, g AS (SELECT *, row_number() OVER (ORDER BY feed, ord) - 1 AS idx FROM n) SELECT node_id, arg_max(node_type, idx) AS node_type, CAST(arg_max(depth, idx) AS INTEGER) AS depth, arg_max(parent_id IS NULL, idx) AS root, max(idx) AS position FROM g GROUP BY node_id")
def feed_index(spark, d):
    return fd.feed_index(_nodes(spark, d))


@query(f"""WITH {NODES}, c AS (SELECT feed, ord, node_id, 'canonical' AS kind, canonical_ref AS ref FROM n UNION ALL SELECT feed, ord, node_id, 'display', display_ref FROM n)
SELECT kind, ref, arg_max(node_id, (feed, ord)) AS node_id, count(*) AS claims, count(DISTINCT node_id) > 1 AS contested FROM c GROUP BY kind, ref""")
def citation_map(spark, d):
    return fd.citation_map(_nodes(spark, d))


@query(f"""WITH {NODES} SELECT node_id, count(*) AS versions, count(DISTINCT feed) > 1 AS across_feeds, CASE WHEN count(DISTINCT (status, depth, canonical_ref)) = 1 THEN 'identical' ELSE 'conflict' END AS kind, arg_max(feed, (feed, ord)) AS winner FROM n GROUP BY node_id HAVING count(*) > 1""")
def feed_conflicts(spark, d):
    return fd.feed_conflicts(_nodes(spark, d), ["status", "depth", "canonical_ref"])


@query(f"WITH {NODES} SELECT feed, ord, node_id, parent_id, status FROM n QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY feed DESC, ord DESC) = 1")
def standing_nodes(spark, d):
    return fd.standing_nodes(_nodes(spark, d).select("feed", "ord", "node_id", "parent_id", "status"))


@query(f"WITH {NODES}, k AS (SELECT feed, count(*) AS node_count FROM n WHERE feed <> 'src3' GROUP BY feed), f AS (SELECT DISTINCT source AS feed FROM documents) SELECT f.feed, coalesce(node_count, 0) AS node_count FROM f LEFT JOIN k ON k.feed = f.feed")
def feed_documents(spark, d):
    """One feed has no nodes: its row has none."""
    return fd.feed_documents(_feeds(spark, d), _nodes(spark, d).where("feed <> 'src3'"))


ATOM_TYPES, REVIEWS = ["rule", "clause", "definition", "list_item", "code_block", "table", "meta"], ["rejected", "draft", "pending", "amended", "approved", "odd"]


@query(f"""WITH a AS (SELECT doc_id, 'A' || doc_id AS atom_id, 'ref-' || (doc_id % 50) AS canonical_ref, ({ATOM_TYPES})[doc_id % 7 + 1] AS type, CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END AS title, ({REVIEWS})[doc_id % 6 + 1] AS review_state, 'sha256:' || sha256(text) AS source_hash FROM documents),
t AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place FROM a WHERE review_state IN ('amended', 'approved'))
SELECT 'N-' || upper(substr(sha256(atom_id || ':' || canonical_ref), 1, 16)) AS node_id, 'feed-doc-' || substr(sha256('docs/all.md'), 1, 16) AS document_id, CASE WHEN type IN ('definition', 'meta') THEN 'definition' WHEN type IN ('table', 'code_block') THEN 'annex' ELSE 'article' END AS node_type, canonical_ref,
 type || CASE WHEN title <> '' THEN ': ' || title ELSE '@L' || doc_id END AS display_ref, CAST(place AS VARCHAR) AS ordinal_path, source_hash, CASE WHEN type IN ('rule', 'clause') THEN 'high' WHEN type = 'definition' THEN 'medium' ELSE 'low' END AS priority,
 CASE WHEN type IN ('rule', 'clause') THEN 80 WHEN type = 'definition' THEN 60 WHEN type = 'list_item' THEN 40 ELSE 20 END AS rank, review_state, atom_id FROM t""")
def certified_entries(spark, d):
    ensure_checkpoints(spark)
    n = F.col("doc_id")
    atoms = table(spark, d, "documents").select(
        n.alias("ord"), F.concat(F.lit("A"), n).alias("atom_id"), F.concat(F.lit("ref-"), n % 50).alias("canonical_ref"), _one_of(n, ATOM_TYPES).alias("type"), F.when(n % 3 != 0, F.col("lang")).otherwise("").alias("title"), F.concat(F.lit("L"), n).alias("span"),
        F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"), _one_of(n, REVIEWS).alias("review_state"),
    )
    return fd.certified_entries(atoms, F.lit("docs/all.md"), "amended")


# -- conformance ----------------------------------------------------------------------------------------------------

_SPACED = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
CONFORMANCE = f"""{ATOMS}, m AS (SELECT source, atom_id, CASE WHEN source % 11 = 6 THEN '' ELSE canonical_ref END AS canonical_ref, text, CASE WHEN source % 11 = 1 AND depth = 2 THEN 'sha256:0' ELSE content_hash END AS content_hash, CASE WHEN source % 11 = 5 THEN depth + 3 ELSE depth END AS depth,
  CASE WHEN parent_id IS NULL THEN '' WHEN source % 11 = 4 THEN 'RBOK.NONE' ELSE 'RBOK.' || upper(parent_id) END AS parent_id, CASE WHEN source % 11 = 2 THEN source_line * 2 - 1 ELSE source_line END AS source_line FROM a WHERE source % 11 <> 7 OR depth = 0),
w AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE source % 11 = 3 AND depth = 1),
k AS (SELECT doc_id, p + 1 AS source_line, lower(line) AS here, lower(lead(line) OVER (PARTITION BY doc_id ORDER BY p)) AS following FROM l),
j AS (SELECT w.*, here IS NULL OR (NOT contains(here, lower(substr(w.text, 1, 15))) AND following IS NOT NULL AND NOT contains(following, lower(substr(w.text, 1, 15)))) AS off FROM w LEFT JOIN k ON k.doc_id = w.source AND k.source_line = w.source_line),
t AS (SELECT doc_id, {_SPACED.format('text')} AS spaced, strlen(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size, {_SPACED.format("substr(text, 1, length(text) // CASE doc_id % 11 WHEN 8 THEN 2 ELSE 1 END - CASE doc_id % 11 WHEN 9 THEN length(text) // 40 ELSE 0 END)")} AS again FROM documents),
g AS (SELECT source, sum(strlen(text)) AS bytes, count_if(off) AS spans, count_if(content_hash <> 'sha256:' || sha256(text)) AS hashes, count(*) - count(DISTINCT atom_id) AS twice, count_if(parent_id <> '' AND NOT EXISTS (SELECT 1 FROM w WHERE w.source = j.source AND w.atom_id = j.parent_id)) AS lost, count_if(depth > 6) AS deep, count_if(canonical_ref = '') AS bare FROM j GROUP BY source),
c AS (SELECT t.doc_id AS source, unnest([{{'check': 'losslessness', 'violations': CASE WHEN size > 0 AND coalesce(bytes, 0) / size < 0.4 THEN 1 ELSE 0 END}}, {{'check': 'span_accuracy', 'violations': coalesce(spans, 0)}}, {{'check': 'hash_integrity', 'violations': coalesce(hashes, 0)}}, {{'check': 'id_uniqueness', 'violations': coalesce(twice, 0)}},
 {{'check': 'parent_validity', 'violations': coalesce(lost, 0)}}, {{'check': 'depth_bounds', 'violations': coalesce(deep, 0)}}, {{'check': 'ref_presence', 'violations': coalesce(bare, 0)}}, {{'check': 'roundtrip', 'violations': CASE WHEN spaced <> again AND round(length(again) / strlen(spaced), 4) < 0.9 THEN 1 ELSE 0 END}}]) AS x FROM t LEFT JOIN g ON g.source = t.doc_id)"""


def _conformance(spark, d):
    """Atoms of all documents, in every eleventh of them with one kind of fault."""
    docs, kind = table(spark, d, "documents"), F.col("source") % 11
    parent = F.when(F.col("parent_id").isNull(), "").when(kind == 4, "RBOK.NONE").otherwise(F.concat(F.lit("RBOK."), F.upper("parent_id")))
    atoms = fd.portable_atoms(_units(spark, d), "rbok").where((kind != 7) | (F.col("depth") == 0)).select(
        "source", "atom_id", parent.alias("parent_id"), F.when(kind == 6, "").otherwise(F.col("canonical_ref")).alias("canonical_ref"), "text", F.when((kind == 1) & (F.col("depth") == 2), "sha256:0").otherwise(F.col("content_hash")).alias("content_hash"),
        (F.col("depth") + F.when(kind == 5, 3).otherwise(0)).alias("depth"), F.when(kind == 2, F.col("source_line") * 2 - 1).otherwise(F.col("source_line")).alias("source_line"),
    )
    size, n = F.length("text"), F.col("doc_id") % 11
    keep = F.when(n == 8, F.floor(size / 2)).when(n == 9, size - F.floor(size / 40)).otherwise(size)
    rebuilt = docs.select(F.col("doc_id").alias("source"), F.substring("text", F.lit(1), keep.cast("int")).alias("text"))
    return cf.conformance(docs.select(F.col("doc_id").alias("source"), "text"), atoms.unionByName(atoms.where((kind == 3) & (F.col("depth") == 1))), rebuilt, 6, 0.4)


@query(f'WITH {CONFORMANCE} SELECT source, x."check" AS "check", CAST(x.violations AS BIGINT) AS violations, x.violations = 0 AS passed FROM c')
def conformance_checks(spark, d):
    return _conformance(spark, d)


@query(f"WITH {CONFORMANCE} SELECT source, count(*) AS total_checks, count_if(x.violations = 0) AS passed, count_if(x.violations > 0) AS failed, count_if(x.violations > 0) = 0 AS pass FROM c GROUP BY source")
def conformance_verdicts(spark, d):
    return cf.conformance_verdicts(_conformance(spark, d))


BLOCKS = ["document", "table", "code_block", "image", "paragraph", "thematic_break"]
STRICT = f"""{LINES}, n AS (SELECT doc_id, p, 'n' || p AS node_id, ({BLOCKS})[p % 6 + 1] AS kind, CASE WHEN doc_id % 4 = 0 AND p % 3 <> 0 THEN ' ' ELSE line END AS text, CASE WHEN doc_id % 7 <> 1 THEN '3' ELSE '' END AS col_count, CASE WHEN doc_id % 7 <> 2 THEN 'sql' END AS language, CASE WHEN doc_id % 7 <> 3 THEN 'alt' END AS alt_text,
 CASE WHEN doc_id % 7 = 4 AND p % 5 = 1 THEN 0 WHEN doc_id % 7 = 5 AND p % 5 = 1 THEN p + 9 ELSE p + 1 END AS start_line, CASE WHEN doc_id % 7 = 4 AND p % 5 = 1 THEN 0 ELSE p + 1 END AS end_line FROM l),
w AS (SELECT doc_id, count_if(kind NOT IN ('document', 'thematic_break')) AS n, count_if(kind NOT IN ('document', 'thematic_break') AND trim(text) = '') AS e FROM n GROUP BY doc_id),
f AS (SELECT doc_id AS document, 'UNTYPED_TABLE' AS code, node_id, 'tables' AS category, 'high' AS severity, true AS blocking FROM n WHERE kind = 'table' AND col_count = ''
 UNION ALL SELECT doc_id, 'CODE_BLOCK_NO_LANG', node_id, 'code_blocks', 'medium', false FROM n WHERE kind = 'code_block' AND language IS NULL
 UNION ALL SELECT doc_id, 'MISSING_SPAN', node_id, 'spans', 'high', true FROM n WHERE kind NOT IN ('document', 'thematic_break') AND end_line = 0
 UNION ALL SELECT doc_id, 'INVERTED_SPAN', node_id, 'spans', 'critical', true FROM n WHERE kind NOT IN ('document', 'thematic_break') AND start_line > end_line
 UNION ALL SELECT doc_id, 'IMAGE_NO_ALT', node_id, 'images', 'medium', false FROM n WHERE kind = 'image' AND alt_text IS NULL AND trim(text) = ''
 UNION ALL SELECT doc_id, 'EXCESSIVE_EMPTY_NODES', NULL, 'content', 'high', true FROM w WHERE e > n * 0.5
 UNION ALL SELECT doc_id, 'TOC_MISSING', NULL, 'toc', 'high', true FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'TOC_NOT_CERTIFIED', NULL, 'toc', 'critical', true FROM documents WHERE doc_id % 5 = 1
 UNION ALL SELECT doc_id, 'TOC_HASH_INVALID', NULL, 'toc', 'critical', true FROM documents WHERE doc_id % 5 = 2 UNION ALL SELECT DISTINCT doc_id, 'LEXICON_UNGOVERNED', NULL, 'lexicon', 'medium', false FROM l WHERE doc_id % 3 = 0 AND p % 7 = 5)"""


def _strict(spark, d):
    """The lines of all documents as nodes, with each kind of fault in some documents; texts of some documents are mostly empty."""
    doc, p, kind = F.col("doc_id"), F.col("p"), F.col("doc_id") % 7
    odd = p % 5 == 1
    nodes = _lines(spark, d).select(
        doc.alias("document"), F.concat(F.lit("n"), p).alias("node_id"), _one_of(p, BLOCKS).alias("kind"), F.when((doc % 4 == 0) & (p % 3 != 0), " ").otherwise(F.col("line")).alias("text"), F.when(kind != 1, "3").otherwise("").alias("col_count"), F.when(kind != 2, "sql").alias("language"), F.when(kind != 3, "alt").alias("alt_text"),
        F.when((kind == 4) & odd, 0).when((kind == 5) & odd, p + 9).otherwise(p + 1).alias("start_line"), F.when((kind == 4) & odd, 0).otherwise(p + 1).alias("end_line"),
    )
    docs = table(spark, d, "documents")
    tocs = docs.where("doc_id % 5 <> 0").select(doc.alias("document"), (doc % 5 != 1).alias("certified"), F.when(doc % 5 == 2, "00").otherwise(F.sha2("text", 256)).alias("stated_hash"), F.sha2("text", 256).alias("hash"))
    terms = _lines(spark, d).where("doc_id % 3 = 0").select(doc.alias("document"), F.when(p % 7 == 5, "deprecated").when(p % 2 == 0, "canonical").otherwise("synonym").alias("status"))
    return nodes, cf.strict_findings(nodes, tocs, terms)


@query(f"WITH {STRICT} SELECT * FROM f")
def strict_findings(spark, d):
    return _strict(spark, d)[1]


@query(f"""WITH {STRICT}, g AS (SELECT document, count(DISTINCT category) AS failed, count_if(blocking) AS blocking FROM f GROUP BY document)
SELECT doc_id AS document, 7 - coalesce(failed, 0) AS passed, coalesce(failed, 0) AS failed, coalesce(g.blocking, 0) AS blocking, coalesce(g.blocking, 0) = 0 AS pass FROM documents LEFT JOIN g ON document = doc_id""")
def strict_verdicts(spark, d):
    return cf.strict_verdicts(*_strict(spark, d))
