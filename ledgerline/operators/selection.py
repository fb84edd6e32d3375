"""Predicates that choose chunks, scalars, units and atom texts; all are Columns, so they are pushed down where a source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import fold_latin, is_blank, once, semantic_tokens, word_count

from .integrity import is_junk_atom

#: Fixed values.
CONFIDENCE = {"high": 3, "medium": 2, "low": 1}
NON_SEMANTIC_DISPOSITIONS = ("coverage_only", "structure_only", "excluded_by_policy", "metadata")
NON_SEMANTIC_KINDS = ("blank", "decorative_separator", "table_separator", "metadata")
INLINE_REFERENCE = r"(!?)\[([^\]\n]*)\]\(([^)\n]*)\)"
CONTENTS_LINK = r"^\s*(?:\d+[.)]\s*)?\[[^\]\n]+\]\(\s*#[^)]+\)\s*$"
STRONG_LABEL = r"^\s*(?:\*\*|__)[^*_]{1,120}(?:\*\*|__)\s*:?\s*$"
PLACEHOLDER = r"^\s*(?:\*\*)?\[[^\]\n]+\](?:\*\*)?\s*(?:[-—–:])?\s*$"
CHAPTER_REFERENCE = r"(?i)^\s*(chapitre|chapter)\s+\d+\s*[-—–]"
PLACEHOLDER_PHRASES = ("section a completer", "a completer lors de la prochaine revision", "to be completed")


def with_tag(tags: Column, wanted: list[str]) -> Column:
    """Any of the tags, whatever its case."""
    return F.coalesce(F.arrays_overlap(F.transform(tags, F.lower), F.array(*(F.lit(t.lower()) for t in wanted))), F.lit(False))


def confidence_rank(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in CONFIDENCE.items() for x in kv))[c], F.lit(0))


def at_least(confidence: Column, least: str) -> Column:
    return confidence_rank(confidence) >= CONFIDENCE.get(least, 0)


def matching(criteria: dict[str, list], rows: DataFrame) -> DataFrame:
    """Rows whose columns hold one of the asked values each; an empty list asks nothing."""
    for column, values in criteria.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def text_candidate(value: Column) -> Column:
    """Enough of a text to be a unit: three words, twenty characters, not junk."""
    t = F.trim(value)
    return ~is_junk_atom(t) & (word_count(t) >= 3) & (F.length(t) >= 20)


def scalar_candidate(kind: Column, value: Column) -> Column:
    return (kind == "scalar_string") & text_candidate(value)


def extractable(admission: Column, atomization: Column) -> Column:
    return F.coalesce((admission == "admitted") & (atomization == "atomized"), F.lit(False))


def non_semantic(disposition: Column, kind: Column) -> Column:
    return F.coalesce(disposition.isin(*NON_SEMANTIC_DISPOSITIONS), F.lit(False)) | F.coalesce(kind.isin(*NON_SEMANTIC_KINDS), F.lit(False))


def inline_plain(c: Column) -> Column:
    """Inline references as their text, emphasis and code marks dropped, white space as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, INLINE_REFERENCE, "$2"), r"`|\*\*|__|\*|_", ""), r"(?U)\s+", " "))


def _folded(c: Column) -> Column:
    return fold_latin(F.trim(c))


def _placeholder(folded: Column) -> Column:
    out = F.lit(False)
    for phrase in PLACEHOLDER_PHRASES:
        out = out | folded.contains(phrase)
    return out


def _reference_only(folded: Column) -> Column:
    return once(F.regexp_replace(folded, r"^[-*+0-9.) ]+", ""), lambda f: f.startswith("statut :") | f.startswith("status :") | f.rlike(CHAPTER_REFERENCE))


def is_placeholder(c: Column) -> Column:
    return once(_folded(c), _placeholder)


def is_lead_in(c: Column) -> Column:
    return once(_folded(c), lambda f: f.endswith(":") & (semantic_tokens(f) >= 3))


def is_reference_only(c: Column) -> Column:
    return _reference_only(_folded(c))


def atom_rejection(raw: Column) -> Column:
    """Why a text makes no atom: the first of ten reasons, null for an atom. The trimmed, the plain and the folded text are each computed once."""
    by_words = lambda plain, f: F.when(_reference_only(f), "reference").when(_placeholder(f), "placeholder").when(f.endswith(":") & (semantic_tokens(f) >= 3), "lead_in").when(semantic_tokens(plain) <= 2, "few_tokens").when(is_junk_atom(plain), "junk")
    by_plain = lambda t, plain: F.when(is_blank(plain), "no_text").when(t.rlike(STRONG_LABEL), "label").otherwise(once(_folded(plain), lambda f: by_words(plain, f)))
    return once(F.trim(raw), lambda t: F.when(is_blank(t), "blank").when(t.rlike(CONTENTS_LINK), "contents_link").when(t.rlike(PLACEHOLDER), "bracketed").otherwise(once(inline_plain(t), lambda plain: by_plain(t, plain))))


def emitted(kind: Column, text: Column, level: Column, least_bytes: int, depth: int, kinds: tuple[str, ...]) -> Column:
    """Whether a unit becomes an atom under a profile: long enough, not too deep (0: any depth), of an asked kind."""
    shallow = F.lit(True) if depth <= 0 else level <= depth
    return (F.octet_length(F.trim(text)) >= least_bytes) & shallow & kind.isin(*kinds)
