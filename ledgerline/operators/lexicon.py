"""Governed terms in texts: phrases of any number of words found by one automaton, longest first, each with its status.

Words are runs of letters and digits, case aside, so a phrase matches across other characters and line ends. From left to right the longest phrase
at a word wins, and the next search starts behind it. Of entries with one phrase a preferred term stands before a synonym, and that before a deprecated one.

The lexicon is broadcast in blocks of at most about ``BLOCK_BYTES``, dealt by a phrase's first word. With one block, which is the rule, a text is settled in its
task; with more, each block finds the longest phrase at each word, and the text's finds are swept once they are together.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8_000_000
#: Statuses, the one that stands first in front.
STATUSES = ("preferred", "synonym", "deprecated")
FOUND = "source string, phrase string, canonical string, status string, word_no int, words int, start int, end int"
_TYPES = [pa.string()] * 4 + [pa.int32()] * 4
_WORD = re.compile(r"[^\W_]+")
_automata: dict[str, object] = {}  # of the last block, in each Python worker


def phrase_key(text: str) -> str:
    return " ".join(_WORD.findall(text.lower()))


def _automaton(name: str, entries: list[tuple[str, str, str]]) -> object:
    if name not in _automata:
        import ahocorasick

        made = ahocorasick.Automaton()
        for key, canonical, status in entries:
            made.add_word(f" {key} ", (key, canonical, status))
        if entries:
            made.make_automaton()
        _automata.clear()
        _automata[name] = made
    return _automata[name]


def longest_at(automaton: object, text: str) -> dict[int, tuple[int, tuple]]:
    """For each word at which a phrase starts, how many words the longest has, and the phrase."""
    words = [m.group() for m in _WORD.finditer(text.lower())]
    joined, at, starts = f" {' '.join(words)} ", 0, {}
    for i, w in enumerate(words):
        starts[at] = i
        at += len(w) + 1
    best: dict[int, tuple[int, tuple]] = {}
    if words and len(automaton):
        for end, entry in automaton.iter(joined):
            i, n = starts[end - len(entry[0]) - 1], entry[0].count(" ") + 1
            if n > best.get(i, (0,))[0]:
                best[i] = (n, entry)
    return best


def swept(finds: Iterable[tuple[int, int]]) -> Iterator[int]:
    """Positions, in (word, number of words) sorted by word, of those that don't overlap an earlier one."""
    free = 0
    for k, (at, n) in enumerate(finds):
        if at >= free:
            yield k
            free = at + n


def resolved(lexicon: DataFrame) -> DataFrame:
    """(key, canonical, status): one entry a phrase of ``lexicon(term, canonical, status)``, by precedence, then the least canonical term."""
    key = F.array_join(F.regexp_extract_all(F.lower("term"), F.lit(r"([\p{L}\p{N}]+)"), 1), " ")
    order = F.struct(*(F.col("status") != s for s in STATUSES[:2]), F.col("canonical"))
    rows = lexicon.where(F.col("status").isin(*STATUSES)).select(key.alias("key"), "canonical", "status").where("key <> ''")
    return rows.groupBy("key").agg(F.min_by(F.struct("canonical", "status"), order).alias("x")).select("key", "x.canonical", "x.status")


def term_uses(docs: DataFrame, lexicon: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows ``FOUND`` of ``docs(source, text)`` for ``lexicon(term, canonical, status)``; start and end are characters of the text. Null text has none. Needs a checkpoint folder."""
    entries = resolved(lexicon).withColumn("first", F.substring_index("key", " ", 1)).checkpoint()
    size = entries.agg(F.sum(F.octet_length("key") + F.octet_length("canonical"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts, out = docs.select(F.col("source").cast("string"), "text"), None
    for b in range(blocks):
        own = entries.where(F.pmod(F.xxhash64("first"), F.lit(blocks)) == b).select("key", "canonical", "status").collect()
        shared, name = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in own]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared.value)
            for batch in batches:
                rows = []
                for source, text in zip(*(c.to_pylist() for c in batch.columns)):
                    best = sorted(longest_at(automaton, text or "").items())
                    spans = [m.span() for m in _WORD.finditer(text)] if best and len(text.lower()) == len(text) else [m.span() for m in _WORD.finditer((text or "").lower())]
                    keep = swept((i, n) for i, (n, _) in best) if blocks == 1 else range(len(best))
                    rows += [(source, *best[k][1][1], best[k][0], best[k][1][0], spans[best[k][0]][0], spans[best[k][0] + best[k][1][0] - 1][1]) for k in keep]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(_TYPES), _TYPES)], [x.split()[0] for x in FOUND.split(", ")])

        found = texts.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    if blocks == 1:
        return out

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("word_no", ignore_index=True)
        return pdf.iloc[list(swept(zip(pdf["word_no"], pdf["words"])))]

    return out.groupBy("source").applyInPandas(sweep, FOUND)  # one text's finds
