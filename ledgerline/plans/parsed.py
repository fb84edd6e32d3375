"""Queries that parse nested texts: YAML and JSON segments, XML and HTML atoms, Markdown containers.

The texts are put together from the columns of ``documents`` and ``pages``, piece by piece; the SQL adds up the lengths of the same pieces, so it knows the span
that each leaf, run or block must have without parsing anything. Spans are checked against the bytes that lie there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.sources.containers import markdown_tree as tree_of
from ledgerline.sources.markup import markup_atoms as atoms_of
from ledgerline.sources.shared import ensure_checkpoints
from ledgerline.sources.structured import coverage, structured_segments

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


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _built(pieces: list[str]) -> str:
    return " || ".join(f"({p})" for p in pieces)


def _pieces_sql(pieces: list[str], wanted: list[tuple], names: str, source: str = "documents") -> str:
    """CTE ``e``: doc_id, the text, and for each wanted (first piece, last piece, fields of SQL) a row with its span and the fields."""
    rows = ", ".join("{'i': %d, 'j': %d, %s}" % (i, j, ", ".join(f"'{n}': {v}" for n, v in zip(names.split(", "), fields))) for i, j, *fields in wanted)
    return f"""WITH p AS (SELECT *, [{', '.join(f'({x})' for x in pieces)}] AS pieces FROM {source}),
n AS (SELECT *, list_transform(pieces, lambda x: strlen(x)) AS sizes, array_to_string(pieces, '') AS whole FROM p),
x AS (SELECT *, unnest([{rows}]) AS w FROM n),
e AS (SELECT CAST(doc_id AS VARCHAR) AS source, w.*, CAST(coalesce(list_sum(sizes[1:w.i]), 0) AS BIGINT) AS start_byte, CAST(list_sum(sizes[1:w.j + 1]) AS BIGINT) AS end_byte,
             array_to_string(pieces[w.i + 1:w.j + 1], '') AS raw FROM x)"""


def _at_span(text: str = "whole") -> Column:
    """What lies at a row's span in the text beside it."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int")), "UTF-8")


_ID, _LANG, _SOURCE = "CAST(doc_id AS STRING)", "coalesce(lang, 'none')", "coalesce(source, 'none')"
_NL, _QUOTE, _SLASH = "chr(10)", "chr(34)", "chr(92)"
#: Pieces of a YAML text: what goes before a leaf and the leaf as written; then the leaf's path, kind and value.
_YAML = [
    (_text("%YAML 1.2\n---\n# record é\nid: "), _ID, "id", "scalar_int", _ID),
    (_text("   # number\nmeta:\n  lang: "), _LANG, "meta.lang", "scalar_string", _LANG),
    (_text("\n  source: "), f"chr(39) || replace({_SOURCE}, chr(39), chr(39) || chr(39)) || ' it' || chr(39) || chr(39) || 's' || chr(39)", "meta.source", "scalar_string", f"{_SOURCE} || ' it' || chr(39) || 's'"),
    (_text("\n  tags: ["), _LANG, "meta.tags[0]", "scalar_string", _LANG),
    (_text(", "), f"{_QUOTE} || 'a, ' || {_SLASH} || {_QUOTE} || {_LANG} || {_SLASH} || 'u00e9' || {_QUOTE}", "meta.tags[1]", "scalar_string", f"'a, ' || {_QUOTE} || {_LANG} || 'é'"),
    (_text(", {deep: "), "CAST(n_chars AS STRING)", "meta.tags[2].deep", "scalar_int", "CAST(n_chars AS STRING)"),
    (_text(",\n    none: "), "'~'", "meta.tags[2].none", "scalar_string", "'~'"),
    (_text("}, ]\n  ratio: "), "CAST(n_chars AS STRING) || '.5'", "meta.ratio", "scalar_float", "CAST(n_chars AS STRING) || '.5'"),
    (_text("\n  ok: "), "'true'", "meta.ok", "scalar_bool", "'true'"),
    (_text("\nlines:\n- "), f"'plain ' || {_LANG} || {_NL} || '  goes on'", "lines[0]", "scalar_string", f"'plain ' || {_LANG} || ' goes on'"),
    (_text("\n- name: &n "), "'n' || CAST(doc_id AS STRING)", "lines[1].name", "scalar_string", "'n' || CAST(doc_id AS STRING)"),
    (_text("\n  same: *n\n  url: "), "'http://x.y/' || CAST(doc_id AS STRING) || '#a'", "lines[1].url", "scalar_string", "'http://x.y/' || CAST(doc_id AS STRING) || '#a'"),
    (_text("\n- - "), _LANG, "lines[2][0]", "scalar_string", _LANG),
    (_text("\n  - "), "'-1e3'", "lines[2][1]", "scalar_float", "'-1e3'"),
    (_text("\nbody: "), f"'|2-' || {_NL} || '  ' || replace(coalesce(text, ''), {_NL}, {_NL} || '  ') || {_NL}", "body", "scalar_string", f"rtrim(coalesce(text, ''), {_NL})"),
    (_text("folded: "), _text(">\n  one\n  two\n\n  three\n"), "folded", "scalar_string", _text("one two\nthree\n")),
    (_text("last: "), _LANG, "last", "scalar_string", _LANG),
    (_text("\n...\nid: [ not read"), None, None, None, None),
]
_YAML_PIECES = [x for before, leaf, *_ in _YAML for x in ((before, leaf) if leaf else (before,))]
_YAML_LEAVES = [(2 * k + 1, 2 * k + 1, _text(path), _text(kind), value) for k, (_, leaf, path, kind, value) in enumerate(_YAML) if leaf]


def _yaml(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("yaml").alias("format"), F.expr(_built(_YAML_PIECES)).alias("text"))


@query(_pieces_sql(_YAML_PIECES, _YAML_LEAVES, "path, node_kind, value") + " SELECT source, path, node_kind, value, start_byte, end_byte, raw FROM e")
def yaml_scalars(spark, d):
    """Leaves of a YAML text for each document, with what lies at their spans."""
    docs = _yaml(spark, d)
    rows = structured_segments(docs).where("kind <> 'structured_coverage'")
    return rows.join(docs.select("source", F.col("text").alias("whole")), "source").select("source", "path", "node_kind", "value", "start_byte", "end_byte", _at_span().alias("raw"))


@query(_pieces_sql(_YAML_PIECES, [(0, len(_YAML_PIECES) - 1, "1")], "one") + f""" SELECT 'yaml-' || source AS source, CAST({len(_YAML_LEAVES)} AS BIGINT) AS leaves, end_byte AS bytes, true AS tiles FROM e
UNION ALL SELECT 'json-' || event_id, CAST(len(json_keys(props)) AS BIGINT), CAST(strlen(props) AS BIGINT), true FROM events""")
def structured_coverage(spark, d):
    """Leaves and gaps cover each YAML text and each event's JSON byte by byte."""
    json = table(spark, d, "events").select(F.concat(F.lit("json-"), "event_id").alias("source"), F.lit("json").alias("format"), F.col("props").alias("text"))
    return coverage(structured_segments(_yaml(spark, d).withColumn("source", F.concat(F.lit("yaml-"), "source")).unionByName(json)))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&#62;')"
_PLAIN = "trim(regexp_replace({0}, '[^A-Za-z0-9 <>&é]', 'x', 'g'))"  # of the SQL; Spark replaces all matches anyway
_HEAD = "'t' || substr(coalesce(text, ''), 1, 40) || '.'"
_FED = "'https://fed/eli/cc/' || CAST(doc_id AS STRING)"
_ART = f"{_FED} || '/a'"
#: Pieces of an XML text, and of its runs the first and last piece, path, identity, value.
_XML_PIECES = [
    _text('<?xml version="1.0"?>\n<!DOCTYPE act [<!ENTITY x "y">]>\n<j:act xmlns:j="urn:j" about="'), _FED, _text('">\n  <title>'), "chr(10) || ' ' || " + _ESCAPED.format(_HEAD) + " || ' '",
    _text("</title><!-- no <run> --><p>"), "'a&amp;b ' || " + _LANG, _text("<br/>"), "'then ' || " + _SOURCE, _text("</p>\n<p id='"), _ART, _text("'>"),
    "'<![CDATA[' || 'x < y ' || " + _LANG + " || ']]>'", _text("<b>"), "'é&#233;'", _text("</b></p>\n<p>"), "'end'", _text("</p></j:act>\n"),
]
_XML_RUNS = [
    (3, 3, "'/act/title'", _FED, "1", f"trim({_HEAD}, ' ' || chr(10) || chr(9) || chr(13))"), (5, 5, "'/act/p'", _FED, "1", f"'a&b ' || {_LANG}"), (7, 7, "'/act/p'", _FED, "2", f"'then ' || {_SOURCE}"),
    (11, 11, "'/act/p[2]'", _ART, "1", f"'x < y ' || {_LANG}"), (13, 13, "'/act/p[2]/b'", _ART, "1", "'éé'"), (15, 15, "'/act/p[3]'", _FED, "1", "'end'"),
]


@query(_pieces_sql(_XML_PIECES, _XML_RUNS, "path, identity, nth, value") + """ SELECT source, path, identity, identity || '#' || path || CASE WHEN nth > 1 THEN '~' || nth ELSE '' END AS ref, value AS text, sha256(value) AS text_hash, start_byte, end_byte, raw FROM e""")
def xml_atoms(spark, d):
    """Runs of an XML act for each document: entities and sections decoded, identities of the nearest carrier."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.lit("xml").alias("format"), F.expr(_built(_XML_PIECES)).alias("text"))
    rows = atoms_of(docs).where("kind <> 'markup'").withColumnRenamed("text", "run")
    return rows.join(docs.select("source", F.col("text").alias("whole")), "source").select("source", "path", "identity", "ref", F.col("run").alias("text"), "text_hash", "start_byte", "end_byte", _at_span().alias("raw"))


def _pages(spark, d):
    page = F.expr("replace(html, '<article>', '<article id=\"https://fed/eli/' || page_id || '\">')")
    return table(spark, d, "pages").select(F.col("page_id").cast("string").alias("source"), F.lit("html").alias("format"), page.alias("text"))


_BLOCKS = "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
_HTML_SQL = """WITH RECURSIVE h AS (SELECT page_id, replace(html, '<article>', '<article id="https://fed/eli/' || page_id || '">') AS html FROM pages),
k AS (SELECT page_id, regexp_extract_all(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<[^>]*>|[^<]+') AS toks FROM h),
t AS (SELECT page_id, i, tok, coalesce(sum(strlen(tok)) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at,
             CASE WHEN tok NOT LIKE '<%' THEN 'text' WHEN tok LIKE '<!%' THEN 'skip' WHEN tok LIKE '</%' THEN 'close' WHEN regexp_matches(tok, '(?i)^<(script|style|br|meta|img|link|hr|input)\\b') THEN 'single' ELSE 'open' END AS what,
             lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS name
      FROM (SELECT page_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM k)),
w AS (SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS names, CAST([] AS VARCHAR[]) AS paths, CAST([] AS VARCHAR[]) AS seen FROM h
      UNION ALL
      SELECT page_id, i, CASE what WHEN 'open' THEN list_append(names, name) WHEN 'close' THEN CASE WHEN back IS NULL THEN names ELSE names[1:len(names) - back] END ELSE names END,
             CASE what WHEN 'open' THEN list_append(paths, base || CASE WHEN n > 0 THEN '[' || (n + 1) || ']' ELSE '' END) WHEN 'close' THEN CASE WHEN back IS NULL THEN paths ELSE paths[1:len(paths) - back] END ELSE paths END,
             CASE WHEN what IN ('open', 'single') THEN list_append(seen, base) ELSE seen END
      FROM (SELECT *, coalesce(paths[-1], '') || '/' || name AS base, len(list_filter(seen, lambda s: s = coalesce(paths[-1], '') || '/' || name)) AS n, list_position(list_reverse(names), name) AS back
            FROM (SELECT w.page_id, t.i, t.what, t.name, w.seen,
                         CASE WHEN t.what = 'open' AND ((w.names[-1] = 'p' AND t.name IN (BLOCKS)) OR (w.names[-1] = 'li' AND t.name = 'li')) THEN w.names[1:len(w.names) - 1] ELSE w.names END AS names,
                         CASE WHEN t.what = 'open' AND ((w.names[-1] = 'p' AND t.name IN (BLOCKS)) OR (w.names[-1] = 'li' AND t.name = 'li')) THEN w.paths[1:len(w.paths) - 1] ELSE w.paths END AS paths
                  FROM w JOIN t ON t.page_id = w.page_id AND t.i = w.i + 1))),
r AS (SELECT t.page_id, coalesce(w.paths[-1], '') AS path, len(w.paths) AS depth, trim(t.tok, ' ' || chr(10) || chr(9) || chr(13)) AS text, t.at + strlen(t.tok) - strlen(ltrim(t.tok, ' ' || chr(10) || chr(9) || chr(13))) AS start, t.i
      FROM t JOIN w ON w.page_id = t.page_id AND w.i = t.i - 1 WHERE t.what = 'text'),
s AS (SELECT *, CASE WHEN path LIKE '/html/body/article%' THEN 'https://fed/eli/' || page_id ELSE '' END AS identity, row_number() OVER (PARTITION BY page_id, path ORDER BY i) AS nth FROM r WHERE text <> '')
SELECT CAST(page_id AS VARCHAR) AS source, path, identity, CASE WHEN identity = '' THEN CAST(page_id AS VARCHAR) ELSE identity END || '#' || path || CASE WHEN nth > 1 THEN '~' || nth ELSE '' END AS ref,
       CAST(depth AS INTEGER) AS depth, text, CAST(start AS BIGINT) AS start_byte, CAST(start + strlen(text) AS BIGINT) AS end_byte FROM s""".replace("BLOCKS", ", ".join(f"'{b}'" for b in _BLOCKS))


@query(_HTML_SQL)
def html_atoms(spark, d):
    """Runs of the pages with their element paths; the SQL walks the tags one by one."""
    return atoms_of(_pages(spark, d)).where("kind <> 'markup'").select("source", "path", "identity", "ref", "depth", "text", "start_byte", "end_byte")


@query("SELECT CAST(page_id AS VARCHAR) AS source, CAST(strlen(replace(html, '<article>', '<article id=\"https://fed/eli/' || page_id || '\">')) AS BIGINT) AS bytes, true AS tiles FROM pages")
def html_coverage(spark, d):
    """Runs and markup reassemble each page byte by byte."""
    return coverage(atoms_of(_pages(spark, d))).drop("leaves")


_TITLE, _LINK, _IMAGE = f"'Document ' || {_ID}", f"'[' || {_LANG} || '](/l/' || {_LANG} || ')'", f"'![' || {_SOURCE} || '](/i/' || {_SOURCE} || '.png)'"
_CELL = f"' ' || {_LANG} || ' '"
#: Pieces of a Markdown text.
_MD = [
    "'# '", _TITLE, _NL, _NL,  # 0-3
    "'A paragraph with '", _LINK, "' and '", _IMAGE, f"'.' || {_NL}", f"'é second line ' || {_ID} || {_NL}", _NL,  # 4-10
    f"'- first ' || {_LANG} || {_NL}", "'  - nested '", _LINK, _NL, f"'  - nested too' || {_NL}", f"'- second' || {_NL}", f"'  goes on' || {_NL}", _NL,  # 11-18
    f"'> quoted ' || {_SOURCE} || {_NL}", f"'> ' || {_NL}", "'> '", f"'- item ' || {_LANG} || {_NL}", "'> '", f"'- other' || {_NL}", _NL,  # 19-25
    f"'> [!NOTE]' || {_NL}", "'> '", "'Heed '", _LINK, _NL, _NL,  # 26-31
    "'|'", "' Field '", "'|'", "' Value '", f"'|' || {_NL}", f"'|---|---|' || {_NL}", "'|'", _CELL, "'|'", _IMAGE, f"'|' || {_NL}", _NL,  # 32-43
    "'|'", "'Name'", "'|'", "' N '", f"'|' || {_NL}", f"'|---|---|' || {_NL}", "'|'", _CELL, "'|'", _ID, f"'|' || {_NL}", _NL,  # 44-55
    f"'```' || {_NL} || '- no item [a](b)' || {_NL} || '```' || {_NL}", f"'---' || {_NL}",  # 56-57
]
#: Blocks: first and last piece, kind, the block that holds it (its place here, -1 for none), and the text of a table's row.
_MD_BLOCKS = [
    (0, 2, "heading", -1, None), (3, 3, "blank", -1, None), (4, 9, "paragraph", -1, None), (5, 5, "link", 2, None), (7, 7, "image_ref", 2, None), (10, 10, "blank", -1, None),
    (11, 17, "list", -1, None), (11, 15, "list_item", 6, None), (12, 15, "list", 7, None), (12, 14, "list_item", 8, None), (13, 13, "link", 9, None), (15, 15, "list_item", 8, None), (16, 17, "list_item", 6, None), (18, 18, "blank", -1, None),
    (19, 24, "blockquote", -1, None), (19, 19, "paragraph", 14, None), (22, 24, "list", 14, None), (22, 22, "list_item", 16, None), (24, 24, "list_item", 16, None), (25, 25, "blank", -1, None),
    (26, 30, "callout", -1, None), (28, 30, "paragraph", 20, None), (29, 29, "link", 21, None), (31, 31, "blank", -1, None),
    (32, 42, "table", -1, None), (32, 36, "table_header", 24, None), (33, 33, "table_cell", 25, None), (35, 35, "table_cell", 25, None), (37, 37, "table_separator", 24, None), (38, 42, "table_row", 24, f"'Field=' || {_LANG} || '; Value=' || {_IMAGE}"),
    (39, 39, "table_cell", 29, None), (41, 41, "table_cell", 29, None), (41, 41, "image_ref", 31, None), (43, 43, "blank", -1, None),
    (44, 54, "table", -1, None), (44, 48, "table_header", 34, None), (45, 45, "table_cell", 35, None), (47, 47, "table_cell", 35, None), (49, 49, "table_separator", 34, None), (50, 54, "table_row", 34, f"'Name=' || {_LANG} || '; N=' || {_ID}"),
    (51, 51, "table_cell", 39, None), (53, 53, "table_cell", 39, None), (55, 55, "blank", -1, None), (56, 56, "code_block", -1, None), (57, 57, "decorative_separator", -1, None),
]
#: Bytes of a first piece that are a marker or indentation, behind which nested blocks start.
_BEHIND = {8: 2, 9: 2, 11: 2, 15: 2}


def _md_rows() -> list[tuple]:
    return [(i, j, _text(kind), str(k), str(parent), str(_BEHIND.get(k, 0)), row or "NULL", "'metadata_table'" if k in (25, 28, 29) else "NULL") for k, (i, j, kind, parent, row) in enumerate(_MD_BLOCKS)]


def _markdown(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("source"), F.expr(_built(_MD)).alias("text"))


@query(_pieces_sql(_MD, _md_rows(), "kind, k, up, behind, row_text, table_role") + """, f AS (SELECT *, 'seg:' || source || ':' || (start_byte + behind) || '-' || end_byte || ':' || kind AS segment_id FROM e)
SELECT f.source, f.segment_id, g.segment_id AS parent_id, f.kind, f.start_byte + f.behind AS start_byte, f.end_byte, f.row_text, f.table_role FROM f LEFT JOIN f g ON g.source = f.source AND g.k = f.up""")
def markdown_tree(spark, d):
    """Root blocks and what they hold, each with its parent's id; spans are those of the pieces."""
    return tree_of(_markdown(spark, d)).select("source", "segment_id", "parent_id", "kind", "start_byte", "end_byte", "row_text", "table_role")


@query(_pieces_sql(_MD, [(0, len(_MD) - 1, "1")], "one") + """ SELECT source, end_byte AS bytes, true AS tiles, CAST(0 AS BIGINT) AS astray FROM e""")
def markdown_tree_coverage(spark, d):
    """Root blocks cover each text; no segment lies outside its parent. Texts are parsed once, and what is used three times is written."""
    ensure_checkpoints(spark)
    rows = tree_of(_markdown(spark, d)).select("source", "segment_id", "parent_id", "start_byte", "end_byte", "kind").checkpoint()
    parents = rows.select("source", F.col("segment_id").alias("parent_id"), F.col("start_byte").alias("from"), F.col("end_byte").alias("to"))
    held = rows.where("parent_id is not null").join(parents, ["source", "parent_id"], "left")
    astray = held.groupBy("source").agg(F.count_if(F.expr("`from` is null or start_byte < `from` or end_byte > `to`")).alias("astray"))
    return coverage(rows.where("parent_id is null")).drop("leaves").join(astray, "source", "left").na.fill(0, ["astray"])
