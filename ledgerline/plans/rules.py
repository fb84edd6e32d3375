"""Queries on ordered rules: semantic roles, short fragments, admission, captured pages, promotion. Cases are made from the tables; every rule has some that it decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.operators import rules as ru

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


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(n: str, values: list) -> str:
    return f"({_list(values)})[({n}) % {len(values)} + 1]"


def _lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))


LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents)"

# -- roles ----------------------------------------------------------------------------------------------------------

HEADS = ["Définitions", "Exceptions et LIMITATION", "Exemples", "PROCÉDURE", "Warning", "Divers", "Sonstiges", "Général"]
CUES = [" sauf", " except if it must", " Note: x ", " remarquez", " step 3", " 1. x", " par exemple", " e.g. x", " Étape 2", " is defined as", " the term x y means", " shall", " within 3 days", " cf. x", " see also", " RFC 12", " DANGER", " mustard", " élevoir", " hors_ligne", ""]
BLOCKS = ["heading", "paragraph", "paragraph", "code_block", "paragraph", "blockquote", "paragraph", "table_cell", "html", "thematic_break", "list_item"]


def _patterns_sql(role: str) -> str:
    return "regexp_matches(t, '" + "|".join("(?:" + p.replace("'", "''") + ")" for p in ru.ROLE_PATTERNS[role]) + "', 'i')"


def _roles_sql() -> str:
    by_kind = " ".join(f"WHEN kind = '{k}' THEN '{r}'" for k, r in ru.KIND_ROLES.items())
    by_head = " ".join("WHEN " + " OR ".join(f"contains(lower(h), '{w}')" for w in words) + f" THEN '{role}'" for role, words in ru.HEADING_ROLES.items())
    by_text = " ".join(f"WHEN {_patterns_sql(role)}" + (f" AND NOT {_patterns_sql('rule')}" if role == "exception" else "") + f" THEN '{role}'" for role in ru.ROLE_PATTERNS)
    return f"CASE {by_kind} {by_head} {by_text} ELSE 'unknown' END"


@query(f"""WITH {LINES}, n AS (SELECT doc_id AS document, p AS node_id, {_pick('p', BLOCKS)} AS kind, CASE WHEN p % 11 = 0 THEN {_pick('doc_id + p // 11', HEADS)} ELSE substr(line, 1, 40) || {_pick('doc_id + p', CUES)} END AS t, CASE WHEN p % 11 <> 0 THEN p - p % 11 END AS parent_id FROM l),
r AS (SELECT document, node_id, kind, {_roles_sql()} AS role FROM (SELECT n.*, h.t AS h FROM n LEFT JOIN n AS h ON h.document = n.document AND h.node_id = n.parent_id) WHERE kind <> 'thematic_break')
SELECT document, CAST(node_id AS INTEGER) AS node_id, kind, role, CASE WHEN role = 'unknown' THEN 'low' WHEN role IN ('structure', 'rule', 'definition', 'warning') OR kind IN ('code_block', 'blockquote') THEN 'high' ELSE 'medium' END AS confidence FROM r""")
def semantic_roles(spark, d):
    """Lines of all documents as blocks below headings."""
    doc, p = F.col("doc_id"), F.col("p")
    text = F.when(p % 11 == 0, _one_of(doc + F.floor(p / 11), HEADS)).otherwise(F.concat(F.substring("line", 1, 40), _one_of(doc + p, CUES)))
    return ru.classified_blocks(_lines(spark, d).select(doc.alias("document"), p.alias("node_id"), _one_of(p, BLOCKS).alias("kind"), text.alias("text"), F.when(p % 11 != 0, p - p % 11).alias("parent_id")))


# -- short fragments ------------------------------------------------------------------------------------------------

HINTS, NODE_KINDS = ["Notes", "Statut", "", "risk.owner", "Remarks", "x", None], ["cell", "scalar_string", "scalar_null", "cell", "scalar_bool"]
MADE = ["upper(w)", "w || p", "w", "' Yes '", "'field'", "'--- |'", "'A+B'", "w || '?'", "w || '-' || upper(w)", "' '"]


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(replace(text, 'ß', 's'), ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS p FROM documents),
f AS (SELECT doc_id, p, trim(CASE p % {len(MADE)} {' '.join(f'WHEN {i} THEN {m}' for i, m in enumerate(MADE))} END, chr(9) || chr(10) || chr(13) || ' ') AS t, {_pick('p // 10', HINTS)} AS hint, {_pick('p // 7', NODE_KINDS)} AS kind, p % 13 = 5 AS header, p % 17 = 6 AS embedded FROM w),
x AS (SELECT *, CASE WHEN NOT regexp_matches(t, '[^-_*~|.,;:!?()\\[\\]{{}}<>+=`\\s]') THEN 'non_semantic' WHEN header THEN 'non_semantic' WHEN embedded THEN 'contextualized_in_parent'
  WHEN lower(t) IN {tuple(ru.CONTROLLED)} OR kind = 'scalar_bool' OR regexp_matches(lower(coalesce(hint, '')), '{'|'.join(ru.VALUE_HINTS)}') THEN 'normative_value_atom' WHEN regexp_matches(t, '\\pL') AND regexp_matches(t, '\\p{{Nd}}') THEN 'identifier_atom'
  WHEN NOT regexp_matches(t, '[^\\pL+&/_-]') AND length(regexp_replace(t, '[^\\pL]', '', 'g')) >= 2 AND length(regexp_replace(t, '[^\\p{{Lu}}+&/]', '', 'g')) >= 2 THEN 'lexicon_atom' WHEN lower(t) IN {tuple(ru.LABELS)} OR kind = 'scalar_null' THEN 'non_semantic' ELSE 'requires_review' END AS disposition FROM f WHERE t <> '' AND length(t) <= 10),
s AS (SELECT *, trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(lower(coalesce(nullif(hint, ''), 'value')), '[^a-z0-9]+', '-', 'g'), '-') AS scope FROM x)
SELECT doc_id, disposition, CASE disposition WHEN 'lexicon_atom' THEN 'lexicon:' || slug WHEN 'identifier_atom' THEN 'identifier:' || slug WHEN 'normative_value_atom' THEN 'value:' || scope || ':' || slug END AS artifact, count(*) AS fragments FROM s GROUP BY ALL""")
def short_critical_atoms(spark, d):
    """Words of all documents, some changed, as fragments of tables and scalars; per document, what they are and what they become. (Engines differ on the capital of ß, so it is replaced.)"""
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("ß"), F.lit("s")), " ", -1)).alias("p", "w"))
    p, made = F.col("p"), F.lit(None).cast("string")
    for i, m in enumerate(MADE):
        made = F.when(p % len(MADE) == i, F.expr(m)).otherwise(made)
    rows = words.select("doc_id", made.alias("t"), _one_of(F.floor(p / 10), HINTS).alias("hint"), _one_of(F.floor(p / 7), NODE_KINDS).alias("kind"), (p % 13 == 5).alias("header"), (p % 17 == 6).alias("embedded"))
    rows = rows.withColumn("disposition", ru.short_disposition(*(F.col(c) for c in ("t", "hint", "kind", "header", "embedded"))))
    groups = rows.groupBy("doc_id", "disposition", ru.promoted_id(F.col("disposition"), F.col("t"), F.col("hint")).alias("artifact")).agg(F.count(F.lit(1)).alias("fragments"))
    return groups.where("if(disposition is null, 0, fragments) > 0")  # one group a document; a filter on the rows would judge each word twice


# -- admission ------------------------------------------------------------------------------------------------------

STATED = {
    "admission_status": ("doc_id // 3", ["admitted", "admitted", "excluded", "admitted", "blocked", "admitted", "", "pending"]), "atomization_status": ("doc_id // 2", ["atomized", "", "not_atomized", "unsupported", "derivative", "coverage_only", "excluded", "odd", None, "atomized"]),
    "exclusion_reason": ("doc_id", ["why", " ", "", "why", "why"]), "source_role": ("doc_id // 5", ["canonical", "reference", "derivative", "metadata", "binary", "canonical", "odd", ""]),
    "format_support": ("doc_id // 7", ["supported", "partial", "unsupported", "supported", "supported", "", "odd"]), "derivative_of": ("doc_id // 11", ["parent", None, " ", "parent"]), "units": ("doc_id", [1, 0, 3]),
}
PATHS = ["docs/a.md", "x/Modèle/b.md", "c.JSON", "d.pdf", "a.b/noext", "e.csv", "f.png", "g.weird", "h.yml", "test-data/i.pdf", "k.pptx"]
SOURCES = "s AS (SELECT doc_id, " + ", ".join(f"{_pick(n, v)} AS {c}" for c, (n, v) in STATED.items()) + f", {_pick('doc_id // 13', PATHS)} AS path FROM documents)"
REFERENCE = ("not_atomized", "reference/template/generated/archive/config source not atomized by default", "reference", "supported")
BINARY = ("unsupported", "binary policy", "binary", "unsupported")
#: What is assumed of each of ``PATHS``.
ASSUMED = [
    ("atomized", "", "canonical", "supported"), REFERENCE, ("not_atomized", "json metadata not atomized", "metadata", "partial"), ("unsupported", "format not yet supported by canonical scanners", "reference", "unsupported"),
    ("not_atomized", 'no canonical scanner registered for extension ""', "reference", "unsupported"), ("unsupported", "tabular format not yet supported by canonical scanners", "reference", "partial"), BINARY,
    ("not_atomized", 'no canonical scanner registered for extension ".weird"', "reference", "unsupported"), ("atomized", "", "canonical", "supported"), REFERENCE, BINARY,
]
CODE = """CASE WHEN coalesce(admission_status, '') = '' THEN 'SOURCE_NO_ADMISSION_STATUS' WHEN admission_status NOT IN ('admitted', 'excluded', 'blocked') THEN 'SOURCE_INVALID_ADMISSION_STATUS'
 WHEN source_role NOT IN ('canonical', 'reference', 'derivative', 'metadata', 'binary') THEN 'SOURCE_INVALID_ROLE' WHEN format_support NOT IN ('supported', 'partial', 'unsupported') THEN 'SOURCE_INVALID_FORMAT_SUPPORT'
 WHEN admission_status <> 'admitted' THEN CASE WHEN coalesce(atomization_status, '') <> '' THEN 'SOURCE_INVALID_TRANSITION' WHEN trim(exclusion_reason) = '' THEN 'SOURCE_NO_REASON' END
 WHEN coalesce(atomization_status, '') = '' THEN 'SOURCE_ADMITTED_NO_ATOMIZATION_STATUS' WHEN atomization_status = 'odd' THEN 'SOURCE_INVALID_ATOMIZATION_STATUS'
 WHEN atomization_status = 'unsupported' AND format_support = 'supported' THEN 'SOURCE_INVALID_TRANSITION' WHEN atomization_status NOT IN ('atomized', 'derivative') AND trim(exclusion_reason) = '' THEN 'SOURCE_NO_REASON'
 WHEN (atomization_status = 'derivative' OR source_role = 'derivative') AND trim(coalesce(derivative_of, '')) = '' THEN 'SOURCE_NO_DERIVATIVE_TARGET' WHEN atomization_status = 'atomized' AND units = 0 THEN 'SOURCE_ATOMIZED_BUT_ZERO_UNITS' END"""


def _sources(spark, d):
    named = {"doc_id": F.col("doc_id"), "doc_id // 2": F.floor(F.col("doc_id") / 2), "doc_id // 3": F.floor(F.col("doc_id") / 3), "doc_id // 5": F.floor(F.col("doc_id") / 5), "doc_id // 7": F.floor(F.col("doc_id") / 7), "doc_id // 11": F.floor(F.col("doc_id") / 11)}
    return table(spark, d, "documents").select("doc_id", *(_one_of(named[n], v).alias(c) for c, (n, v) in STATED.items()), _one_of(F.floor(F.col("doc_id") / 13), PATHS).alias("path"))


@query(f"WITH {SOURCES} SELECT doc_id, code FROM (SELECT doc_id, {CODE} AS code FROM s) WHERE code IS NOT NULL")
def source_admission(spark, d):
    return _sources(spark, d).select("doc_id", ru.admission_code().alias("code")).where("code is not null")


@query(f"""WITH {SOURCES}, a AS (SELECT *, ({_list([x[0] for x in ASSUMED])})[i] AS d_how, ({_list([x[1] for x in ASSUMED])})[i] AS d_reason, ({_list([x[2] for x in ASSUMED])})[i] AS d_role, ({_list([x[3] for x in ASSUMED])})[i] AS d_format FROM (SELECT *, doc_id // 13 % {len(PATHS)} + 1 AS i FROM s)),
b AS (SELECT * REPLACE (coalesce(nullif(admission_status, ''), 'admitted') AS admission_status, coalesce(nullif(source_role, ''), d_role) AS source_role, coalesce(nullif(format_support, ''), d_format) AS format_support) FROM a),
c AS (SELECT * REPLACE (CASE WHEN admission_status = 'admitted' THEN coalesce(nullif(atomization_status, ''), d_how) ELSE atomization_status END AS atomization_status) FROM b),
e AS (SELECT * REPLACE (CASE WHEN exclusion_reason = '' AND (admission_status <> 'admitted' OR atomization_status IN ('unsupported', 'not_atomized', 'coverage_only', 'excluded')) THEN d_reason ELSE exclusion_reason END AS exclusion_reason) FROM c)
SELECT doc_id, path, admission_status, atomization_status, exclusion_reason, source_role, format_support, {CODE} AS code FROM e""")
def backfilled_admission(spark, d):
    """Sources with their empty fields filled from their paths, and what still breaks a rule then."""
    rows = ru.backfilled(_sources(spark, d), "path")
    return rows.select("doc_id", "path", "admission_status", "atomization_status", "exclusion_reason", "source_role", "format_support", ru.admission_code().alias("code"))


# -- captured pages -------------------------------------------------------------------------------------------------

GOOD = {"canonical_url": "https://a.org/x", "fetched_url": "", "parent_url": "http://a.org", "http_status": 200, "content_hash": "sha256:" + "ab" * 32, "normalized_hash": None, "fetched_at": "2026-01-31T23:59:59Z", "crawler_version": "c/1", "scope_policy": "seed", "robots": "allowed", "licence": "allowed", "depth": 1}
#: A fault of a page and the code it has, in the order of the rules; the last ones only count for admitted pages.
FAULTS = [
    ("canonical_url", " ", "WEB_SOURCE_NO_CANONICAL_URL"), ("canonical_url", "ftp://a.org/x", "WEB_SOURCE_BAD_URL"), ("fetched_url", "https:///x", "WEB_SOURCE_BAD_URL"), ("parent_url", "a.org/x", "WEB_SOURCE_BAD_URL"), ("http_status", 42, "WEB_SOURCE_BAD_HTTP_STATUS"), ("content_hash", "", "WEB_SOURCE_NO_CONTENT_HASH"),
    ("content_hash", "ab" * 32, "WEB_SOURCE_UNSTABLE_HASH"), ("normalized_hash", "sha256:AB", "WEB_SOURCE_UNSTABLE_HASH"), ("fetched_at", "2026-02-30T00:00:00Z", "WEB_SOURCE_NO_FETCHED_AT"), ("fetched_at", "2026-01-31", "WEB_SOURCE_NO_FETCHED_AT"), ("crawler_version", None, "WEB_SOURCE_NO_CRAWLER_VERSION"),
    ("scope_policy", "far", "WEB_SOURCE_BAD_SCOPE_POLICY"), ("robots", "", "WEB_SOURCE_ROBOTS_UNDECIDED"), ("licence", "maybe", "WEB_SOURCE_LICENCE_UNDECIDED"), ("depth", -1, "WEB_SOURCE_NEGATIVE_DEPTH"), ("parent_url", "", "WEB_SOURCE_DEPTH_WITHOUT_PARENT"), ("robots", "undecided", "WEB_SOURCE_ROBOTS_UNDECIDED"),
    ("licence", "undecided", "WEB_SOURCE_LICENCE_UNDECIDED"), ("robots", "disallowed", "WEB_SOURCE_DISALLOWED_BUT_ADMITTED"), ("licence", "disallowed", "WEB_SOURCE_DISALLOWED_BUT_ADMITTED"), ("scope_policy", "out_scope", "WEB_SOURCE_OUT_OF_SCOPE_BUT_ADMITTED"),
]
_M, _A = len(FAULTS) + 2, 16


@query(f"""WITH e AS (SELECT event_id, least(f, g) AS first, event_id // {_M * 8} % 2 = 0 AS admitted FROM (SELECT event_id, event_id % {_M} AS f, event_id // {_M} % 8 * 3 AS g FROM events)), c AS (SELECT event_id, CASE WHEN first < {_A} OR admitted THEN ({_list([c for *_, c in FAULTS])})[first + 1] END AS code, first, admitted FROM e)
SELECT event_id, code FROM (SELECT event_id, CASE WHEN code IS NOT NULL THEN code END AS code FROM c) WHERE code IS NOT NULL""")
def web_source_validation(spark, d):
    """A captured page for each event, with two faults at most; the first in the order of the rules is reported."""
    n = F.col("event_id")
    a, b = n % _M, F.floor(n / _M) % 8 * 3
    page = {}
    for c, good in GOOD.items():
        value = F.lit(good)
        for i, (name, bad, _) in reversed(list(enumerate(FAULTS))):
            if name == c:
                value = F.when((a == i) | (b == i), F.lit(bad)).otherwise(value)
        page[c] = value.alias(c)
    rows = table(spark, d, "events").select("event_id", *page.values(), (F.floor(n / (_M * 8)) % 2 == 0).alias("admitted"))
    return rows.select("event_id", ru.web_source_code().alias("code")).where("code is not null")


# -- promotion ------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT s_suppkey AS bundle, 'src-' || s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'customer_confidential' ELSE 'open' END AS access_policy, 'silo-' || s_nationkey AS silo_id, s_suppkey % 2 = 0 AS exported FROM supplier),
c AS (SELECT s_suppkey AS bundle, s_suppkey * 7 % 5 AS certificate_id, s_acctbal < 3000 AS revoked FROM supplier),
a AS (SELECT l_suppkey AS bundle, l_orderkey * 10 + l_linenumber AS atom_id, CASE WHEN l_returnflag = 'R' THEN 'draft' ELSE 'approved' END AS review_state, CASE WHEN l_linenumber = 3 THEN NULL ELSE 'user_promoted' END AS provenance, CASE WHEN l_quantity > 45 THEN 'certified' ELSE 'community' END AS trust_tier,
 l_tax > 0.05 AS confidential, l_orderkey % 5 AS certificate_id, 'src-' || CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE l_suppkey END AS source_id, l_partkey % 8 = 0 AS wrong_silo, CASE WHEN l_linestatus = 'F' THEN 'silo_only' ELSE 'all' END AS surfacing, CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS shared_catalog FROM lineitem),
j AS (SELECT a.*, b.source_id AS source_, c.revoked FROM a JOIN b USING (bundle) LEFT JOIN c ON c.bundle = a.bundle AND c.certificate_id = a.certificate_id)
SELECT bundle, 'review_state_must_be_approved' AS code, CAST(atom_id AS VARCHAR) AS target FROM j WHERE review_state <> 'approved' UNION ALL SELECT bundle, 'promoted_atom_requires_user_promoted_provenance', CAST(atom_id AS VARCHAR) FROM j WHERE provenance IS NULL
UNION ALL SELECT bundle, 'user_promoted_cannot_be_certified', CAST(atom_id AS VARCHAR) FROM j WHERE trust_tier = 'certified' UNION ALL SELECT bundle, 'customer_confidential_atom_must_remain_siloed', CAST(atom_id AS VARCHAR) FROM j WHERE confidential AND NOT (surfacing = 'silo_only' AND shared_catalog IS NOT DISTINCT FROM false)
UNION ALL SELECT bundle, 'promotion_source_mismatch', CAST(atom_id AS VARCHAR) FROM j WHERE source_id <> source_ UNION ALL SELECT bundle, 'promotion_silo_mismatch', CAST(atom_id AS VARCHAR) FROM j WHERE wrong_silo UNION ALL SELECT bundle, 'certificate_required', CAST(atom_id AS VARCHAR) FROM j WHERE revoked IS NULL
UNION ALL SELECT bundle, 'certificate_revoked', CAST(certificate_id AS VARCHAR) FROM j WHERE revoked UNION ALL SELECT bundle, 'customer_confidential_source_exposed', source_id FROM b WHERE access_policy = 'customer_confidential' AND exported""")
def canon_promotion(spark, d):
    """Order lines as atoms that their supplier's bundle promotes."""
    sup, k = table(spark, d, "supplier"), F.col("s_suppkey")
    bundles = sup.select(k.alias("bundle"), F.concat(F.lit("src-"), k).alias("source_id"), F.when(k % 3 == 0, "customer_confidential").otherwise("open").alias("access_policy"), F.concat(F.lit("silo-"), "s_nationkey").alias("silo_id"), (k % 2 == 0).alias("exported"))
    certs = sup.select(k.alias("bundle"), (k * 7 % 5).cast("string").alias("certificate_id"), (F.col("s_acctbal") < 3000).alias("revoked"))
    part = F.col("l_partkey")
    silo = bundles.select("bundle", F.col("silo_id").alias("own_silo"))
    atoms = table(spark, d, "lineitem").withColumn("bundle", F.col("l_suppkey")).join(silo, "bundle").select(
        "bundle", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("atom_id"), F.when(F.col("l_returnflag") == "R", "draft").otherwise("approved").alias("review_state"), F.when(F.col("l_linenumber") != 3, "user_promoted").alias("provenance"), F.when(F.col("l_quantity") > 45, "certified").otherwise("community").alias("trust_tier"),
        F.when(F.col("l_tax") > 0.05, "customer_confidential").otherwise("open").alias("confidentiality"), (F.col("l_orderkey") % 5).cast("string").alias("certificate_id"), F.concat(F.lit("src-"), F.when(part % 9 == 0, F.lit(0)).otherwise(F.col("l_suppkey"))).alias("source_id"),
        F.when(part % 8 == 0, F.lit(None)).otherwise(F.col("own_silo")).alias("silo_id"), F.when(F.col("l_linestatus") == "F", "silo_only").otherwise("all").alias("surfacing"), F.when(part % 4 == 1, True).when(part % 4 != 0, False).alias("shared_catalog"),
    )
    return ru.promotion_findings(bundles, atoms, certs)
