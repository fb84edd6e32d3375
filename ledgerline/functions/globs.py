"""Path patterns: ``*`` within a segment, ``dir/**``, ``**/suffix`` and ``dir/**/suffix``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The regular expression of a pattern; ``**`` may stand for any number of directories, none included."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            return f"^{out}(/.*)?$"
        if pattern.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def allowed(path: Column, allow: list[str], ignore: list[str]) -> Column:
    """Ignore wins; without allow patterns everything else is allowed."""
    return ~matches_any(path, ignore) & (matches_any(path, allow) if allow else F.lit(True))
