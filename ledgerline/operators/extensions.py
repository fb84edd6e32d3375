"""Extension points: scorers, rules, format adapters and profiles that a user brings. Spark deals the work; what is brought is a function of a batch, an expression, or a frame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.spans import with_bytes
from ledgerline.sources.files import extension

from .selection import emitted


def score_pairs(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """(id, score) of pairs (id, premise, hypothesis): the scorer sees one Arrow batch at a time; a score outside 0 to 1, or a batch of another length, is an error."""

    @F.pandas_udf("double")
    def run(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
        out = pd.Series(scorer(premise, hypothesis), dtype=float)
        if len(out) != len(premise) or not out.between(0, 1).all():
            raise ValueError("a scorer has to give one score from 0 to 1 for each pair")
        return out

    return pairs.select("id", run("premise", "hypothesis").alias("score"))


def score_faults(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """(id, fault) of scores (id, score) that came from outside: each pair has to have just one, from 0 to 1, and no other id may occur."""
    asked, given = pairs.select("id", F.lit(True).alias("asked")).distinct(), scores.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("stated"))
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("asked").isNull(), "unknown_id").when(F.col("n") > 1, "duplicate").when((F.col("stated") == 0) | (F.col("low") < 0) | (F.col("high") > 1), "out_of_range")
    return asked.join(given, "id", "full_outer").select("id", fault.alias("fault")).where("fault is not null")


def evaluate_rules(rows: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """(key, rule, holds, digest) of SQL conditions by name; a null condition does not hold. The digest binds rule, condition, key and outcome, and can be recomputed from these."""
    facts = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(condition).alias("condition"), F.coalesce(F.expr(condition), F.lit(False)).alias("holds")) for name, condition in rules.items())))
    out = rows.select(F.col(key), facts.alias("f")).select(key, "f.*")
    return out.select(key, "rule", "holds", F.sha2(F.concat_ws("\n", "rule", "condition", F.col(key).cast("string"), F.col("holds").cast("string")), 256).alias("digest"))


@dataclass
class Adapters:
    """Parsers by file extension. A parser takes files (path, text) and gives segments (path, kind, text, start_byte, end_byte)."""

    parsers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def register(self, ext: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        if ext in self.parsers:
            raise ValueError(f"there is a parser for .{ext}")
        self.parsers[ext] = parser

    def parse(self, files: DataFrame) -> DataFrame:
        """All segments; a file without a parser is one unsupported segment, so that its bytes stay accounted for."""
        ext = extension(F.col("path"))
        size = F.octet_length("text").cast("long")
        other = files.where(~ext.isin(*self.parsers) if self.parsers else F.lit(True)).select("path", F.lit("unsupported_block").alias("kind"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("start_byte"), size.alias("end_byte"))
        return reduce(DataFrame.unionByName, [parser(files.where(ext == e)) for e, parser in self.parsers.items()], other)


def contract_faults(segments: DataFrame, files: DataFrame) -> DataFrame:
    """(path, fault) of an adapter's segments: spans have to lie in the file, and texts to be the bytes at their spans."""
    rows = with_bytes(segments, files.select("path", F.col("text").alias("whole_")), "path", "whole_")
    fault = F.when(F.col("size_").isNull(), "unknown_file").when((F.col("start_byte") < 0) | (F.col("start_byte") > F.col("end_byte")) | (F.col("end_byte") > F.col("size_")), "span_outside").when(F.col("text").isNotNull() & (F.col("raw_") != F.col("text")), "bytes_differ")
    return rows.select("path", fault.alias("fault")).where("fault is not null").distinct()


@dataclass(frozen=True)
class AtomizationProfile:
    """Which units become atoms, and what they are then called."""

    types: dict[str, str]
    least_bytes: int = 1
    depth: int = 0

    def atoms(self, units: DataFrame) -> DataFrame:
        """(source, position, atom_type, text) of units (source, position, kind, level, text)."""
        names = F.create_map(*(F.lit(x) for kv in self.types.items() for x in kv))
        take = emitted(F.col("kind"), F.col("text"), F.col("level"), self.least_bytes, self.depth, tuple(self.types))
        return units.where(take).select("source", "position", names[F.col("kind")].alias("atom_type"), "text")


@dataclass(frozen=True)
class HierarchyProfile:
    """Levels by kind of heading, and the kinds that every source has to have."""

    levels: dict[str, int]
    required: tuple[str, ...] = ()

    def faults(self, headings: DataFrame) -> DataFrame:
        """(source, fault) of headings (source, kind): required kinds that are missing, and kinds without a level."""
        seen = headings.groupBy("source").agg(F.collect_set(F.when(F.col("kind").isin(*self.required), F.col("kind"))).alias("seen"), F.bool_or(~F.col("kind").isin(*self.levels)).alias("odd"))  # at most the required kinds
        missing = F.transform(F.array_except(F.array(*map(F.lit, self.required)), "seen"), lambda k: F.concat(F.lit("missing "), k))
        faults = F.concat(missing, F.when(F.col("odd"), F.array(F.lit("unknown kind"))).otherwise(F.array().cast("array<string>")))
        return seen.select("source", F.explode(faults).alias("fault"))
