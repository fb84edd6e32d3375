"""Ordered rules on cases with known answers; every code of every family occurs in its query."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import rules as ru
from ledgerline.plans import rules as plans
from tests.conftest import DATA


def test_every_code_occurs(spark):
    codes = lambda df, c="code": {r[c] for r in df.select(c).distinct().collect()}
    assert codes(plans.web_source_validation(spark, DATA)) == {c for *_, c in plans.FAULTS}
    assert len(codes(plans.source_admission(spark, DATA))) == 10
    assert len(codes(plans.canon_promotion(spark, DATA))) == 9
    assert codes(plans.short_critical_atoms(spark, DATA), "disposition") == {"non_semantic", "contextualized_in_parent", "lexicon_atom", "identifier_atom", "normative_value_atom", "requires_review"}
    assert codes(plans.semantic_roles(spark, DATA), "role") == {*ru.ROLE_PATTERNS, "structure", "unknown"}


@pytest.mark.parametrize(
    "kind, text, heading, role",
    [
        ("heading", "must", None, "structure"), ("code_block", "must", None, "example"), ("blockquote", None, None, "note"), ("table_cell", "shall", None, "reference"), ("html", "x", None, "note"),
        ("paragraph", "x must y", "Définitions", "definition"), ("paragraph", "x", "EXCLUSIONS", "exception"), ("paragraph", "x", "Étapes", "procedure"), ("paragraph", "sauf avis", None, "exception"), ("paragraph", "unless you must", "x", "rule"),
        ("paragraph", "Note: you must", None, "note"), ("paragraph", "mustard", None, "unknown"), ("paragraph", "see article 12", None, "reference"), ("paragraph", "Contract terms : the rest", None, "definition"), ("paragraph", "ÉTAPE 2", None, "unknown"), ("paragraph", "xétape 2", None, "procedure"),
        ("paragraph", "within 30 days", None, "rule"), (None, None, None, "unknown"), ("list_item", "d'abord", None, "procedure"), ("paragraph", "the term a\nmeans b", None, "unknown"), ("paragraph", "the term a means b", None, "definition"),
    ],
)
def test_roles(spark, kind, text, heading, role):
    """Boundaries are between ASCII characters, so an accent at a word's start only counts behind a letter."""
    row = spark.createDataFrame([(kind, text, heading)], "kind string, text string, heading string")
    assert row.select(ru.semantic_role(F.col("kind"), F.col("text"), F.col("heading")).alias("r")).first()["r"] == role


def test_short_fragments(spark):
    cases = {
        (" Yes ", None, None, False, False): "normative_value_atom", ("high", "Priority", None, False, False): "normative_value_atom", ("word", None, None, False, False): "requires_review", ("A1", "", None, False, False): "identifier_atom", ("RGPD", None, None, False, False): "lexicon_atom",
        ("A+", None, None, False, False): "requires_review", ("Ab+", None, None, False, False): "lexicon_atom", ("R-D", None, None, False, False): "lexicon_atom", ("R D", None, None, False, False): "requires_review", ("---", "status", None, False, False): "non_semantic", (":-- | --", None, None, False, False): "non_semantic",
        ("Status", None, None, True, False): "non_semantic", ("A1", None, None, False, True): "contextualized_in_parent", ("Type", None, None, False, False): "non_semantic", ("none", None, "scalar_null", False, False): "non_semantic", ("x", None, "scalar_bool", False, False): "normative_value_atom",
        ("elevenchars", None, None, False, False): None, ("", None, None, False, False): None, (None, "status", None, False, False): None, ("§", None, None, False, False): "requires_review", ("é1", None, None, None, None): "identifier_atom",
    }
    rows = spark.createDataFrame(list(cases), "t string, hint string, kind string, header boolean, embedded boolean")
    got = {tuple(r)[:5]: r["d"] for r in rows.withColumn("d", ru.short_disposition(*(F.col(c) for c in rows.columns))).collect()}
    assert got == cases


@pytest.mark.parametrize("fault", range(-1, len(plans.FAULTS)))
def test_captured_pages(spark, fault):
    """Each fault alone, of an admitted page and of one that is not."""
    page = plans.GOOD | ({plans.FAULTS[fault][0]: plans.FAULTS[fault][1]} if fault >= 0 else {})
    types = {"http_status": "int", "depth": "int"}
    rows = spark.createDataFrame([(*page.values(), True), (*page.values(), False), (*page.values(), None)], ", ".join(f"{c} {types.get(c, 'string')}" for c in page) + ", admitted boolean")
    code = plans.FAULTS[fault][2] if fault >= 0 else None
    other = code if fault < 16 else None
    assert [r["code"] for r in rows.select(ru.web_source_code().alias("code")).collect()] == [code, other, other]


def test_admission_of_nulls_and_paths(spark):
    schema = "admission_status string, atomization_status string, exclusion_reason string, source_role string, format_support string, derivative_of string, units long, path string"
    row = spark.createDataFrame([(None,) * 7 + ("Docs/Guide.MD",), (None,) * 7 + ("a/Café.schema/x.md",), ("blocked", None, None, None, None, None, None, "a.png"), ("admitted", None, None, None, None, None, 0, "b.yml"), (None,) * 8], schema)
    assert [r["c"] for r in row.select(ru.admission_code().alias("c")).collect()] == ["SOURCE_NO_ADMISSION_STATUS"] * 2 + ["SOURCE_INVALID_ROLE"] * 2 + ["SOURCE_NO_ADMISSION_STATUS"]
    got = [(r["atomization_status"], r["source_role"], r["exclusion_reason"], r["c"]) for r in ru.backfilled(row, "path").withColumn("c", ru.admission_code()).collect()]
    assert got[0] == ("atomized", "canonical", None, None) and got[1][:2] == ("not_atomized", "reference") and got[2] == (None, "binary", "binary policy", None) and got[3][3] == "SOURCE_ATOMIZED_BUT_ZERO_UNITS"
    assert got[4][:2] == ("not_atomized", "reference")
