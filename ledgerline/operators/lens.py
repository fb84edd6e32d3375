"""Facets and knowledge lenses, compiled to Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The closed vocabularies of the single-valued axes.
VOCABULARY = {
    "nature": ("rule", "definition", "obligation", "permission", "prohibition", "condition", "exception", "calculation", "evidence", "governance", "metier", "context"),
    "scope_level": ("source", "structure", "atom", "chunk", "domain", "product", "release"),
    "trust_tier": ("certified", "indicative", "unverified"),
    "provenance": ("source_backed", "derived", "inferred", "external_attested", "user_promoted"),
    "confidentiality": ("public", "internal", "restricted", "secret", "licensed_restricted", "customer_confidential"),
    "applicability": ("applicable", "partially_applicable", "not_applicable", "blocked", "unknown"),
}
LISTS = ("activity", "discipline_role", "risk_tier")


def selection(facets: dict[str, Column], chosen: dict[str, list[str]]) -> Column:
    """All named axes must meet; a selection without axes never matches."""
    tests = [F.coalesce(F.arrays_overlap(facets[a], F.array(*map(F.lit, v))) if a in LISTS else facets[a].isin(*v), F.lit(False)) for a, v in chosen.items() if v]
    out = F.lit(False) if not tests else tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def lens_reason(facets: dict[str, Column], lens: dict) -> Column:
    """Null where the lens includes the row, else the reason; exclusions come first and name their first axis by alphabet."""
    include, exclude = lens.get("include", {}), lens.get("exclude", {})
    out = F.when(F.lit(False), F.lit(""))
    for sel in exclude.get("any_of", []):
        if any(sel.values()):
            out = out.when(selection(facets, sel), F.lit(f"excluded_by_facets.{min(a for a, v in sel.items() if v)}"))
    for sel in include.get("all_of", []):
        out = out.when(~selection(facets, sel), F.lit("not_selected_by_lens"))
    if include.get("any_of"):
        out = out.when(~any_of([selection(facets, s) for s in include["any_of"]]), F.lit("not_selected_by_lens"))
    if include.get("none_of"):
        out = out.when(any_of([selection(facets, s) for s in include["none_of"]]), F.lit("not_selected_by_lens"))
    return out


def facet_errors(facets: dict[str, Column]) -> Column:
    """The first axis, in vocabulary order, whose value is not in its vocabulary, or whose list is empty or holds a blank; else null."""
    out = F.when(F.lit(False), F.lit(""))
    for axis, words in VOCABULARY.items():
        if axis in facets:
            out = out.when((F.coalesce(facets[axis], F.lit("")) != "") & ~facets[axis].isin(*words), F.lit(axis))
    for axis in LISTS:
        if axis in facets:
            out = out.when(facets[axis].isNotNull() & ((F.size(facets[axis]) == 0) | F.exists(facets[axis], lambda x: F.trim(x) == "")), F.lit(axis))
    return out


def merged(over: Column, base: Column) -> Column:
    """Single-valued override: a blank one leaves the base."""
    return F.coalesce(F.nullif(over, F.lit("")), base)


def merged_list(over: Column, base: Column) -> Column:
    return F.when(F.size(over) > 0, over).otherwise(base)


def derived_nature(kind: Column) -> Column:
    return F.when(kind.isin("rule", "clause", "list_item"), "rule").when(kind == "definition", "definition").when(kind.isin("code_block", "table"), "evidence").otherwise("context")
