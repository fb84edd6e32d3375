"""Ordered rules on rows: semantic roles, short fragments, admission of sources, captured pages, promotion of atoms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import is_blank, once, slug
from ledgerline.sources.files import IMAGE, OFFICE

#: Roles by kind of block, words of a heading that decide, and patterns of each role in the order in which they are tried.
KIND_ROLES = {"heading": "structure", "document": "structure", "code_block": "example", "blockquote": "note", "table": "reference", "table_row": "reference", "table_cell": "reference", "html": "note"}
HEADING_ROLES = {
    "definition": ("définition", "definition", "glossaire"), "exception": ("exception", "exclusion", "limitation"), "example": ("exemple", "example"), "procedure": ("procédure", "procedure", "workflow", "étape"),
    "warning": ("avertissement", "warning", "attention"),
}
ROLE_PATTERNS = {
    "note": (r"(?:^|\b)(?:note\s*[:.]\s|remarque|n\.b\.\s|nb\s*:)", r"\b(?:observation|pr[ée]cision|commentaire)\b"),
    "warning": (r"(?:^|\b)(?:attention|avertissement|warning|danger|alerte|mise en garde)\b", r"\b(?:important\s*:)\b", r"\b(?:risque|caution)\b"),
    "procedure": (r"\b(?:proc[ée]dure|[ée]tape[s]?\s*\d|step\s*\d|processus|workflow)\b", r"(?:^|\b)(?:1[\.\)]\s|premi[eè]rement|d'abord|ensuite|enfin)\b", r"\b(?:suivre les [ée]tapes|follow the steps|instructions)\b"),
    "exception": (r"\b(?:sauf|except[ée]?|exception|unless|notwithstanding|par d[ée]rogation)\b", r"\b(?:ne sont? pas couvert|ne s'applique pas|does not apply|is excluded|exclusion)\b", r"\b(?:sous r[ée]serve|subject to|[àa] condition|hors)\b"),
    "example": (r"\b(?:par exemple|exemple|example|e\.g\.|for instance|such as|illustr)\b", r"\b(?:cas pratique|use case|sc[ée]nario)\b"),
    "definition": (r"(?:^|\b)(?:on entend par|au sens d[ue]|d[ée]signe|is defined as|refers? to)\b", r"\b(?:the term\b.*\bmeans?\b)", r"\b(?:d[ée]finition|glossaire|terminologie|vocabulary)\b", r"^[A-Z][a-z]{5,}[^.]{0,60}\s*:\s+[a-z]"),
    "rule": (r"\b(?:doit|doivent|shall|must|is required|est tenu|sont tenus|obligatoire)\b", r"\b(?:il est interdit|ne peut pas|ne doivent pas|shall not|must not|prohibited)\b", r"\b(?:pris en charge|est couvert|sont couverts|is covered|are covered)\b", r"\b(?:dans un d[ée]lai de|within \d+ days?|au plus tard)\b"),
    "reference": (r"\b(?:conform[ée]ment [àa]|en application de|pursuant to|in accordance with)\b", r"(?:\bcf\.\s)", r"\b(?:voir|see also)\b", r"\b(?:article \d+|art\.\s*\d+)\b", r"\b(?:ISO\s*\d+|RFC\s*\d+|GDPR|HIPAA|SOC|MDR|IVDR)\b"),
}
#: Short fragments, and the characters and words that tell what they are.
SHORT = 10
JUNK = "-_*~|.,;:!?()[]{}<>+=`"
CONTROLLED = ("yes", "no", "true", "false", "oui", "non", "pass", "fail", "passed", "failed", "blocked", "active", "draft")
VALUE_HINTS = ("status", "statut", "priority", "priorite", "severity", "criticality", "risk", "approved", "required", "enabled", "mode", "level")
LABELS = ("field", "value", "champ", "valeur", "key", "name", "id", "date", "type")
#: Vocabularies of admission and of captured pages.
ADMISSIONS, SOURCE_ROLES, FORMATS = ("admitted", "excluded", "blocked"), ("canonical", "reference", "derivative", "metadata", "binary"), ("supported", "partial", "unsupported")
ATOMIZATIONS = ("atomized", "coverage_only", "not_atomized", "unsupported", "derivative", "excluded")
TEMPLATE_MARKS = ("template", "schema", "schemas", "config", "configs", "configuration", "exemple", "example", "sample", "fixture", "testdata", "test-data", "modele", "generated", "archive", "archives", "workbook", "workbooks")
DECISIONS, SCOPES = ("allowed", "disallowed", "undecided"), ("seed", "in_scope", "out_scope")

#: Word boundaries between ASCII letters, digits and underscores, whatever the Java version takes \b for.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def _any(text: Column, patterns: tuple) -> Column:
    """One pattern that matches if any does, in any case, with lines ended by \\n alone."""
    return text.rlike("(?iud)" + "|".join(p.replace(r"\b", _EDGE) for p in patterns))


def first_of(rules: list[tuple[Column, str]]) -> Column:
    """The code of the first condition that holds, else null; a null condition doesn't hold."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for on, code in rules:
        out = out.when(on, F.lit(code))
    return out


def semantic_role(kind: Column, text: Column, heading: Column) -> Column:
    """Role of a block by its kind, by the heading it stands under, else by the first role whose patterns match; an exception that holds a rule's words is none. Nulls count as empty."""
    text, heading = F.coalesce(text, F.lit("")), F.lower(F.coalesce(heading, F.lit("")))
    out = F.create_map(*(F.lit(x) for kv in KIND_ROLES.items() for x in kv))[kind]
    heads = first_of([(heading.rlike("|".join(words)), role) for role, words in HEADING_ROLES.items()])
    texts = first_of([(_any(text, p) & ~_any(text, ROLE_PATTERNS["rule"]) if role == "exception" else _any(text, p), role) for role, p in ROLE_PATTERNS.items()])
    return F.coalesce(out, heads, texts, F.lit("unknown"))


def role_confidence(kind: Column, role: Column) -> Column:
    sure = (role == "structure") | F.coalesce(kind.isin("code_block", "blockquote", "table"), F.lit(False)) | role.isin("rule", "definition", "warning")
    return F.when(role == "unknown", "low").when(sure, "high").otherwise("medium")


def classified_blocks(nodes: DataFrame) -> DataFrame:
    """(document, node_id, kind, role, confidence) of ``nodes(document, node_id, kind, text, parent_id)``; documents and rules between blocks are left out. Only headings are joined, to the blocks right below them."""
    heads = nodes.where("kind = 'heading'").select("document", F.col("node_id").alias("parent_id"), F.col("text").alias("heading"))
    rows = nodes.where("kind not in ('document', 'thematic_break')").join(heads, ["document", "parent_id"], "left")
    rows = rows.select("document", "node_id", "kind", semantic_role(F.col("kind"), F.col("text"), F.col("heading")).alias("role"))
    return rows.withColumn("confidence", role_confidence(F.col("kind"), F.col("role")))


def short_disposition(fragment: Column, hint: Column, kind: Column, header: Column, embedded: Column) -> Column:
    """What a fragment of at most ``SHORT`` characters is, by what it says, by its column or path (``hint``) and by the kind of its node; null for longer or empty ones."""
    meaning = "[^" + "".join("\\" + c for c in JUNK) + r"\s]"  # a separator line of a table has no other characters than JUNK
    two = lambda x: rf"{x}.*{x}"

    def found(text: Column, low: Column, x: Column) -> Column:
        return first_of([
            (~text.rlike("(?U)" + meaning), "non_semantic"), (x["header"], "non_semantic"), (x["embedded"], "contextualized_in_parent"),
            (low.isin(*CONTROLLED) | (x["kind"] == "scalar_bool") | F.lower(x["hint"]).rlike("|".join(VALUE_HINTS)), "normative_value_atom"), (text.rlike(r"\p{L}") & text.rlike(r"\p{Nd}"), "identifier_atom"),
            (~text.rlike(r"[^\p{L}+&/_-]") & text.rlike("(?s)" + two(r"\p{L}")) & text.rlike("(?s)" + two(r"[\p{Lu}+&/]")), "lexicon_atom"), (low.isin(*LABELS) | (x["kind"] == "scalar_null"), "non_semantic"),
        ]).otherwise("requires_review")

    text = F.regexp_replace(F.coalesce(fragment, F.lit("")), r"(?U)^\s+|\s+$", "")
    fields = F.struct(text.alias("text"), F.coalesce(hint, F.lit("")).alias("hint"), F.coalesce(kind, F.lit("")).alias("kind"), header.alias("header"), embedded.alias("embedded"))
    return once(fields, lambda x: F.when((x["text"] != "") & (F.length(x["text"]) <= SHORT), once(F.lower(x["text"]), lambda low: found(x["text"], low, x))))


def promoted_id(disposition: Column, fragment: Column, scope: Column) -> Column:
    """Id of the artifact that a short fragment becomes, else null."""
    return F.when(disposition == "lexicon_atom", F.concat(F.lit("lexicon:"), slug(fragment))).when(disposition == "identifier_atom", F.concat(F.lit("identifier:"), slug(fragment))).when(disposition == "normative_value_atom", F.concat(F.lit("value:"), slug(F.when(is_blank(scope), "value").otherwise(scope)), F.lit(":"), slug(fragment)))


def _none(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _not_in(c: str, values: tuple) -> Column:
    return ~F.coalesce(F.col(c).isin(*values), F.lit(False))


def admission_code() -> Column:
    """First broken rule of a source (admission_status, atomization_status, exclusion_reason, source_role, format_support, derivative_of, units), else null."""
    out, reason, target = F.col("admission_status") != "admitted", is_blank(F.col("exclusion_reason")), is_blank(F.col("derivative_of"))
    how = F.col("atomization_status")
    return first_of([
        (_none("admission_status"), "SOURCE_NO_ADMISSION_STATUS"), (_not_in("admission_status", ADMISSIONS), "SOURCE_INVALID_ADMISSION_STATUS"), (_not_in("source_role", SOURCE_ROLES), "SOURCE_INVALID_ROLE"), (_not_in("format_support", FORMATS), "SOURCE_INVALID_FORMAT_SUPPORT"),
        (out & ~_none("atomization_status"), "SOURCE_INVALID_TRANSITION"), (out & reason, "SOURCE_NO_REASON"), (~out & _none("atomization_status"), "SOURCE_ADMITTED_NO_ATOMIZATION_STATUS"), (~out & _not_in("atomization_status", ATOMIZATIONS), "SOURCE_INVALID_ATOMIZATION_STATUS"),
        (~out & (how == "unsupported") & (F.col("format_support") == "supported"), "SOURCE_INVALID_TRANSITION"), (~out & how.isin("unsupported", "not_atomized", "coverage_only", "excluded") & reason, "SOURCE_NO_REASON"),
        (~out & ((how == "derivative") | (F.col("source_role") == "derivative")) & target, "SOURCE_NO_DERIVATIVE_TARGET"), (~out & (how == "atomized") & (F.col("units") == 0), "SOURCE_ATOMIZED_BUT_ZERO_UNITS"),
    ])


def default_admission(path: Column) -> Column:
    """Struct of what is assumed of a source at a path: templates and the like first, then by extension."""
    plain = F.translate(F.lower(path), "àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    made = lambda how, reason, role, support: F.struct(F.lit("admitted").alias("admission_status"), F.lit(how).alias("atomization_status"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("exclusion_reason"), F.lit(role).alias("source_role"), F.lit(support).alias("format_support"))
    return (
        F.when(plain.rlike("|".join(TEMPLATE_MARKS)), made("not_atomized", "reference/template/generated/archive/config source not atomized by default", "reference", "supported"))
        .when(ext.isin(".md", ".mdx", ".yaml", ".yml"), made("atomized", "", "canonical", "supported")).when(ext == ".json", made("not_atomized", "json metadata not atomized", "metadata", "partial"))
        .when(ext.isin(".pdf", ".docx", ".html", ".htm", ".doc", ".rtf", ".odt"), made("unsupported", "format not yet supported by canonical scanners", "reference", "unsupported"))
        .when(ext.isin(".xlsx", ".xls", ".csv", ".tsv", ".ods"), made("unsupported", "tabular format not yet supported by canonical scanners", "reference", "partial"))
        .when(F.substring(ext, 2, 10).isin(*OFFICE, *IMAGE), made("unsupported", "binary policy", "binary", "unsupported"))
        .otherwise(made("not_atomized", F.concat(F.lit('no canonical scanner registered for extension "'), ext, F.lit('"')), "reference", "unsupported"))
    )


def backfilled(sources: DataFrame, path: str) -> DataFrame:
    """Sources with their empty fields filled from the defaults of their path; what is stated stays, and a reason is only filled where one is needed."""
    d = sources.withColumn("d_", default_admission(F.col(path)))
    fill = lambda c: F.when(_none(c), F.col(f"d_.{c}")).otherwise(F.col(c))
    d = d.select(*sources.columns, "d_").withColumns({c: fill(c) for c in ("admission_status", "source_role", "format_support")})
    d = d.withColumn("atomization_status", F.when(F.col("admission_status") == "admitted", fill("atomization_status")).otherwise(F.col("atomization_status")))
    needs = F.coalesce(F.col("atomization_status").isin("unsupported", "not_atomized", "coverage_only", "excluded"), F.lit(False)) | (F.col("admission_status") != "admitted")
    return d.withColumn("exclusion_reason", F.when(needs, fill("exclusion_reason")).otherwise(F.col("exclusion_reason"))).select(*sources.columns)


def _bad_url(c: str) -> Column:
    return ~F.trim(c).rlike(r"^(?i:https?)://[^/?#\s]+[^\x00-\x1F\x7F]*$")


def web_source_code() -> Column:
    """First broken rule of a captured page, stricter for an admitted one, else null.

    Columns: canonical_url, fetched_url, parent_url, http_status, content_hash, normalized_hash, fetched_at (text), crawler_version, scope_policy, robots, licence, depth, admitted.
    """
    hashed = r"^(sha256|sha384|sha512):[0-9a-f]{64,128}$"
    at = F.trim("fetched_at")
    instant = at.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$") & F.try_to_timestamp(F.substring(at, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).isNotNull()
    given = lambda c: ~is_blank(F.col(c))
    admitted, undecided = F.coalesce("admitted", F.lit(False)), lambda c: F.col(c) == "undecided"
    return first_of([
        (~given("canonical_url"), "WEB_SOURCE_NO_CANONICAL_URL"), (_bad_url("canonical_url") | (given("fetched_url") & _bad_url("fetched_url")) | (given("parent_url") & _bad_url("parent_url")), "WEB_SOURCE_BAD_URL"),
        (~F.coalesce(F.col("http_status").between(100, 599), F.lit(False)), "WEB_SOURCE_BAD_HTTP_STATUS"), (~given("content_hash"), "WEB_SOURCE_NO_CONTENT_HASH"), (~F.trim("content_hash").rlike(hashed) | (given("normalized_hash") & ~F.trim("normalized_hash").rlike(hashed)), "WEB_SOURCE_UNSTABLE_HASH"),
        (~F.coalesce(instant, F.lit(False)), "WEB_SOURCE_NO_FETCHED_AT"), (~given("crawler_version"), "WEB_SOURCE_NO_CRAWLER_VERSION"), (_not_in("scope_policy", SCOPES), "WEB_SOURCE_BAD_SCOPE_POLICY"), (_not_in("robots", DECISIONS), "WEB_SOURCE_ROBOTS_UNDECIDED"),
        (_not_in("licence", DECISIONS), "WEB_SOURCE_LICENCE_UNDECIDED"), (F.col("depth") < 0, "WEB_SOURCE_NEGATIVE_DEPTH"), ((F.col("depth") > 0) & ~given("parent_url"), "WEB_SOURCE_DEPTH_WITHOUT_PARENT"), (admitted & undecided("robots"), "WEB_SOURCE_ROBOTS_UNDECIDED"),
        (admitted & undecided("licence"), "WEB_SOURCE_LICENCE_UNDECIDED"), (admitted & ((F.col("robots") == "disallowed") | (F.col("licence") == "disallowed")), "WEB_SOURCE_DISALLOWED_BUT_ADMITTED"), (admitted & (F.col("scope_policy") == "out_scope"), "WEB_SOURCE_OUT_OF_SCOPE_BUT_ADMITTED"),
    ])


def promotion_findings(bundles: DataFrame, atoms: DataFrame, certificates: DataFrame) -> DataFrame:
    """(bundle, code, target): everything that keeps atoms from promotion; nulls count as empty.

    ``bundles(bundle, source_id, access_policy, silo_id, exported)``, one row each; ``atoms(bundle, atom_id, review_state, provenance, trust_tier,
    confidentiality, certificate_id, source_id, silo_id, surfacing, shared_catalog)``, atoms of no bundle give nothing; ``certificates(bundle, certificate_id, revoked)``, unique.
    """
    same = lambda a, b: F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))
    isnt = lambda c, v: ~F.col(c).eqNullSafe(F.lit(v))
    rows = atoms.join(bundles.select("bundle", F.col("source_id").alias("source_"), F.col("silo_id").alias("silo_")), "bundle").join(certificates.select("bundle", "certificate_id", F.coalesce("revoked", F.lit(False)).alias("revoked")), ["bundle", "certificate_id"], "left")
    rules = {
        "review_state_must_be_approved": isnt("review_state", "approved"), "promoted_atom_requires_user_promoted_provenance": isnt("provenance", "user_promoted"), "user_promoted_cannot_be_certified": ~isnt("trust_tier", "certified"),
        "customer_confidential_atom_must_remain_siloed": ~isnt("confidentiality", "customer_confidential") & (isnt("surfacing", "silo_only") | isnt("shared_catalog", False)), "promotion_source_mismatch": ~same("source_id", "source_"), "promotion_silo_mismatch": ~same("silo_id", "silo_"),
        "certificate_required": F.col("revoked").isNull(), "certificate_revoked": F.col("revoked"),
    }
    found = F.array_compact(F.array(*(F.when(on, F.struct(F.lit(code).alias("code"), F.col("certificate_id" if code == "certificate_revoked" else "atom_id").alias("target"))) for code, on in rules.items())))
    exposed = bundles.where(~isnt("access_policy", "customer_confidential") & ~isnt("exported", True)).select("bundle", F.lit("customer_confidential_source_exposed").alias("code"), F.col("source_id").alias("target"))
    return rows.select("bundle", F.explode(found).alias("f")).select("bundle", "f.*").unionByName(exposed)
