"""Text functions as Column expressions: hashes, token counts, normalisation, ids and prefixes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in groundedness checks.
STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "be", "for", "that", "this", "it", "as", "by", "on", "with", "must", "not", "no", "from", "its", "was", "were", "has", "have", "had", "but", "any", "all", "may")
SPACES = r"(?U)\s+"
#: Separators of context prefixes.
GROUP, HEADING, BODY = " · ", " › ", "\n\n"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row: a Column that ``f`` names several times, or that a filter is pushed below, is otherwise computed for each of them."""
    return F.transform(F.array(value), f)[0]


def raw_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def normalized_text(c: Column) -> Column:
    """Lines right-trimmed, inner white space as one space (a leading run too), blank lines at both ends dropped."""
    lines = F.transform(F.split(c, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+$", ""), SPACES, " "))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\n+|\n+$", "")


def normalized_hash(c: Column) -> Column:
    return raw_hash(normalized_text(c))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, SPACES), lambda x: x != "")).cast("long")


def tokens_by_chars(n_chars: Column, ratio: float = 4.0) -> Column:
    """Estimate for chunks: characters over a ratio, rounded half up."""
    return F.floor(n_chars / F.lit(ratio) + 0.5).cast("long")


def tokens_by_words(c: Column) -> Column:
    """Estimate for governed projections: words times 1.33, truncated, at least 1."""
    return F.greatest(F.floor(word_count(c) * F.lit(1.33)), F.lit(1)).cast("long")


def semantic_tokens(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.size(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).cast("long")


def content_tokens(c: Column) -> Column:
    """Lower-case ASCII words of at least three characters that are not stop words; accents split words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"[.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"^[\s]+|[\s]+$", ""))), lambda s: s != "")


def chunk_id(source: Column, locator: Column, content: Column) -> Column:
    return F.concat(F.lit("chunk-"), F.substring(raw_hash(F.concat_ws("\x00", source, locator, content)), 1, 16))


def short_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(raw_hash(F.concat_ws("\x00", *parts)), 1, length))


def fold_latin(c: Column) -> Column:
    return F.translate(F.lower(c), "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def slug(c: Column) -> Column:
    """ASCII letters and digits, lower-case, other runs as one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plain_markdown(c: Column) -> Column:
    """Inline markup removed: images, links, code, emphasis."""
    c = F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(c, r"[`*_~]+", ""))


def joined(sep: str, *parts: Column) -> Column:
    """Non-blank parts, trimmed, in order."""
    return F.concat_ws(sep, *(F.when(~is_blank(p), F.trim(p)) for p in parts))


def context_prefix(source: Column, role: Column, domain: Column, headings: Column, table_id: Column, row: Column, columns: Column, yaml_path: Column) -> Column:
    """``source · role · domain · h1 › h2 · table t row n · columns a, b · yaml p``, blank groups left out."""
    clean = lambda a: F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: ~is_blank(x))
    table = F.when(~is_blank(table_id), F.concat(F.lit("table "), F.trim(table_id), F.when(row > 0, F.concat(F.lit(" row "), row.cast("string"))).otherwise("")))
    cols = F.when(F.size(clean(columns)) > 0, F.concat(F.lit("columns "), F.array_join(clean(columns), ", ")))
    yaml = F.when(~is_blank(yaml_path), F.concat(F.lit("yaml "), F.trim(yaml_path)))
    heads = F.when(F.size(clean(headings)) > 0, F.array_join(clean(headings), HEADING))
    return joined(GROUP, source, role, domain, heads, table, cols, yaml)


def greedy_window(sizes: Column, budget: int) -> Column:
    """Positions (from 0) of the items that fit a budget in order; one that doesn't fit is skipped, and a full budget ends it."""
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<int>").alias("took"), F.lit(0).alias("at"))
    step = lambda a, x: F.struct(
        F.when((a["left"] > 0) & (x <= a["left"]), a["left"] - x).otherwise(a["left"]).alias("left"),
        F.when((a["left"] > 0) & (x <= a["left"]), F.array_append(a["took"], a["at"])).otherwise(a["took"]).alias("took"),
        (a["at"] + 1).alias("at"),
    )
    return F.aggregate(sizes, start, step, lambda a: a["took"])
