"""The training-data pipeline over ``documents``: each stage's result is written as Parquet and reread by the next.

Stages: documents that the quality rules reject go; lines that an earlier document holds go, and with them documents
left without a word; of each group of near-duplicates the first stays; secrets are replaced by a mark; what is left is
packed into sequences. All but the last return the columns of ``documents``.

Defined cases: null text is empty to the quality rules, which reject it; null lang or source is a group of its own; documents
are ordered by doc_id, nulls first, and rows that share one by their text, so of equal ones the first stays; other columns pass
through all stages but the last; an empty table gives empty tables. Tables that a stage writes for itself go when it is done.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import documents, materialise, scratch
from ledgerline.llm.line_dedup import dedup_lines
from ledgerline.llm.ngram_join import one_of_each
from ledgerline.llm.packing import pack_documents
from ledgerline.llm.quality_rules import reject_outliers
from ledgerline.llm.secret_scans import redact, train_markov


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_outliers(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs, drop_emptied=True)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs, train_markov(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [(f.__name__, f) for f in (quality_rules, line_dedup, ngram_join, secret_scans, packing)]
#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with scratch(spark, name):
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", outer=True)
    return docs
