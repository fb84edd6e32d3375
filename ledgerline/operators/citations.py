"""References that lines make: to annexes, to literature, and to other places of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import once

from .sizes import dealt

#: Patterns of references, and how the names of bodies that publish standards begin.
ANNEX = r"(?i)\b(annex[e]?|appendix|app\.)\s+([A-Z0-9][A-Z0-9.-]*)"
BRACKETS = r"\[([A-Za-z0-9][A-Za-z0-9 ._-]*)\]"
AUTHOR_YEAR = r"\(([A-Z][a-z]+(?:\s+(?:et\s+al\.|&\s+[A-Z][a-z]+))?),?\s*((?:19|20)\d{2})\)"
CUE = r"(?i)\b(see|cf\.|per|selon|voir|ref\.|as per)\s+(?:(?:section|article|clause|chapter|§|chapitre|titre|alinea)\s*)?([A-Z0-9][A-Z0-9._-]*)"
LINK = r"\[([^\]]+)\]\(([^)]+)\)"
PLACE = r"(?i)\b(section|article|clause|chapter|chapitre|titre|§)\s+([A-Z0-9][A-Z0-9._-]*)"
PUBLISHERS = ("RFC", "ISO", "IEEE", "NIST", "ICH", "GAMP")


#: Where a word of ASCII letters, digits and underscores begins or ends; what ``\b`` means beyond ASCII differs between Java's versions.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _all(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern.replace(r"\b", EDGE)), F.lit(0)))


def _part(raw: Column, pattern: str, group: int) -> Column:
    """A group of a match, matched again by itself; what stands before it is not known there, so no edge of a word is asked for."""
    return F.regexp_extract(raw, "^" + pattern.replace(r"\b", "", 1), group)


def _found(kind: str, raw: Column, target: Column, label: Column, confidence: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), raw.alias("raw"), target.alias("target"), label.alias("label"), confidence.alias("confidence"))


def unnested_places(raws: Column, places: Column) -> Column:
    """Places in order, without those that hold, or are held by, a reference found before them."""
    known = F.aggregate(places, raws, lambda acc, x: F.when(F.exists(acc, lambda e: e.contains(x) | x.contains(e)), acc).otherwise(F.array_append(acc, x)))
    return F.slice(known, F.size(raws) + 1, F.size(known) + 1)


def detected_references(lines: DataFrame) -> DataFrame:
    """``lines(document, line_no, text)`` to (document, line_no, kind, raw, target, label, confidence): each reference of a kind once a line.

    Brackets that open a link are none, judged where such brackets first stand in the line; a place is left out where it
    holds, or is held by, a reference with a cue, a link or an earlier place, so a line's different places are compared with
    each other. Null text has no references. A line takes far longer than its bytes to read, so lines are dealt out first.
    """
    return dealt(lines.where("text is not null"), "document", "line_no").select("document", "line_no", F.explode(once(F.col("text"), _references)).alias("f")).select("document", "line_no", "f.*")


def _references(t: Column) -> Column:
    high, none = F.lit("high"), F.lit("")
    annexes = F.transform(_all(t, ANNEX), lambda r: _found("annex", r, F.upper(_part(r, ANNEX, 2)), F.concat_ws(" ", _part(r, ANNEX, 1), _part(r, ANNEX, 2)), high))
    linked = lambda r: F.substring(t, F.position(r, t) + F.length(r), F.lit(1)) == "("
    inner = lambda r: _part(r, BRACKETS, 1)
    standard = lambda x: F.trim(x).rlike(r"^\d{1,3}$") | F.upper(F.trim(x)).rlike("^(" + "|".join(PUBLISHERS) + ")")
    brackets = F.filter(_all(t, BRACKETS), lambda r: ~linked(r) & ~F.lower(inner(r)).isin("x"))
    numbered = F.transform(brackets, lambda r: _found("bibliographic", r, inner(r), none, F.when(standard(inner(r)), "high").otherwise("medium")))
    authored = F.transform(_all(t, AUTHOR_YEAR), lambda r: _found("bibliographic", r, F.concat_ws(" ", _part(r, AUTHOR_YEAR, 1), _part(r, AUTHOR_YEAR, 2)), _part(r, AUTHOR_YEAR, 1), high))
    cross = lambda raws, pattern, sure: F.transform(raws, lambda r: _found("cross_reference", r, _part(r, pattern, 2), _part(r, pattern, 1), F.lit(sure)))
    first = F.struct(_all(t, CUE).alias("cues"), F.filter(_all(t, LINK), lambda r: _part(r, LINK, 2).rlike(r"^(#|\./|\.\./)")).alias("links"))
    placed = lambda x: cross(unnested_places(F.concat(x["cues"], x["links"]), _all(t, PLACE)), PLACE, "medium")
    return once(first, lambda x: F.array_distinct(F.concat(annexes, numbered, authored, cross(x["cues"], CUE, "high"), cross(x["links"], LINK, "high"), placed(x))))
