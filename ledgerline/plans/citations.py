"""Queries on references that lines make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import citations as ci

from .corpus import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What lines about parts say; ``{n}`` is a part's size, ``{b}`` its number.
SAID = (
    "see Section {n}.2 and section {n}", "Annex A{n}", "appendix b-{n} of it", "[RFC {b}]", "[{n}]", "[note {b}](#n{n})", "[x] done", "(Smith et al., 2024) said", "(Roe & Doe 1999) and (Doe, 2019)", "cf. Article L.{n}-2", "Article {b}, article {b}.1",
    "§ {n} holds", "[here](./a{n}.md) or [there](https://h/{b})", "plain {b} text", "as per clause {n}_1 or Clause {b}", "[note {b}] and [iso {n}-1]",
)
PICKS = ("p_partkey", "p_partkey // 3 + p_size", "p_partkey // 7 + 5 * p_size")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _line(sql: bool) -> str:
    pick = lambda p: f"list_extract([{', '.join(repr(s) for s in SAID)}], CAST(({p}) % {len(SAID)} AS INTEGER) + 1)" if sql else f"element_at(array({', '.join(repr(s) for s in SAID)}), cast(({p.replace('//', 'DIV')}) % {len(SAID)} + 1 as int))"
    said = " || ', ' || ".join(f"{pick(p)}" for p in PICKS) + " || ' ' || p_name"
    return f"replace(replace({said}, '{{n}}', CAST(p_size AS {'VARCHAR' if sql else 'STRING'})), '{{b}}', CAST(p_partkey AS {'VARCHAR' if sql else 'STRING'}))"


def _sql_all(pattern: str, *groups: int) -> str:
    """Each match of a line with its groups, as a list of structs (r, a, b)."""
    flags = "'i'" if pattern.startswith("(?i)") else "''"
    p = pattern.removeprefix("(?i)").replace("'", "''")
    one = lambda g: f"regexp_extract_all(t, '{p}', {g}, {flags})"
    return f"list_distinct(list_transform(range(1, len({one(0)}) + 1), lambda i: {{'r': {one(0)}[i], 'a': {one(1)}[i], 'b': {one(2) if 2 in groups else one(1)}[i]}}))"


REFERENCES = f"""l AS (SELECT p_partkey AS document, p_size AS line_no, {_line(True)} AS t FROM part),
m AS (SELECT *, {_sql_all(ci.ANNEX, 1, 2)} AS annex, {_sql_all(ci.BRACKETS, 1)} AS brackets, {_sql_all(ci.AUTHOR_YEAR, 1, 2)} AS authored, {_sql_all(ci.CUE, 1, 2)} AS cues, list_filter({_sql_all(ci.LINK, 1, 2)}, lambda x: regexp_matches(x.b, '^(#|\\./|\\.\\./)')) AS links,
 list_transform(range(1, len(regexp_extract_all(t, '{ci.PLACE.removeprefix("(?i)")}', 0, 'i')) + 1), lambda i: {{'r': regexp_extract_all(t, '{ci.PLACE.removeprefix("(?i)")}', 0, 'i')[i], 'a': regexp_extract_all(t, '{ci.PLACE.removeprefix("(?i)")}', 1, 'i')[i], 'b': regexp_extract_all(t, '{ci.PLACE.removeprefix("(?i)")}', 2, 'i')[i]}}) AS places FROM l),
k AS (SELECT *, list_reduce(list_concat([list_transform(list_concat(cues, links), lambda x: x.r)], list_transform(places, lambda x: [x.r])), lambda acc, x: CASE WHEN len(list_filter(acc, lambda e: contains(e, x[1]) OR contains(x[1], e))) > 0 THEN acc ELSE list_append(acc, x[1]) END) AS known FROM m),
refs AS (SELECT document, line_no, 'annex' AS kind, x.r AS raw, upper(x.b) AS target, x.a || ' ' || x.b AS label, 'high' AS confidence FROM (SELECT *, unnest(annex) AS x FROM m)
 UNION ALL SELECT document, line_no, 'bibliographic', x.r, x.a, '', CASE WHEN regexp_matches(x.a, '^ *\\d{{1,3}} *$') OR regexp_matches(upper(x.a), '^ *(RFC|ISO|IEEE|NIST|ICH|GAMP)') THEN 'high' ELSE 'medium' END FROM (SELECT *, unnest(brackets) AS x FROM m) WHERE lower(x.a) <> 'x' AND substr(t, instr(t, x.r) + length(x.r), 1) <> '('
 UNION ALL SELECT document, line_no, 'bibliographic', x.r, x.a || ' ' || x.b, x.a, 'high' FROM (SELECT *, unnest(authored) AS x FROM m) UNION ALL SELECT document, line_no, 'cross_reference', x.r, x.b, x.a, 'high' FROM (SELECT *, unnest(list_concat(cues, links)) AS x FROM m)
 UNION ALL SELECT DISTINCT document, line_no, 'cross_reference', x.r, x.b, x.a, 'medium' FROM (SELECT *, unnest(places) AS x FROM k) WHERE list_contains(known[len(cues) + len(links) + 1:], x.r))"""


def _references(spark, d):
    return ci.detected_references(table(spark, d, "part").select(F.col("p_partkey").alias("document"), F.col("p_size").alias("line_no"), F.expr(_line(False)).alias("text")))


@query(f"WITH {REFERENCES} SELECT * FROM refs")
def detected_references(spark, d):
    """References in a line about each part."""
    return _references(spark, d)


@query(f"WITH {REFERENCES} SELECT kind, confidence, count(*) AS refs, count(DISTINCT target) AS targets, count(DISTINCT document) AS documents FROM refs GROUP BY ALL")
def reference_kinds(spark, d):
    return _references(spark, d).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("target").alias("targets"), F.countDistinct("document").alias("documents"))
