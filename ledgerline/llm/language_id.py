"""Language ID: segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece. A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words, and the languages compete with equal priors.
The piece probabilities are fitted by expectation maximisation on the word counts of at most about
``docs_per_language`` labelled documents per language: each iteration is a Spark job that adds up expected piece
counts, of which there are as many as languages times pieces.

Defined cases: null text, and text without a letter (``str.isalpha``: digits, fractions, superscripts and number letters are none), is ``und`` with score 0; so is every text if no labelled row is
there to learn from; rows with a null language train nothing; equal likelihoods go to the alphabetically first
language; repeated rows are predicted one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, sample_shares, sampled
from .lattice import by_chars, by_length, words_of
from .sentencepiece_coding import lattice, piece_file

#: Labelled documents per language, about; EM iterations; pseudo-count of each piece.
DOCS_PER_LANGUAGE, ITERATIONS, ALPHA = 2_000, 2, 0.05
#: Words a worker keeps, and their characters; characters of a piece of a long run in training.
WORDS_KEPT, CHARS_KEPT, LONGEST_KEPT = 200_000, 1 << 24, 64


@dataclass
class LanguageModel:
    languages: list[str]
    logp: np.ndarray  # (languages, pieces)
    model_file: str


def word_counts(labelled: DataFrame, docs_per_language: int) -> DataFrame:
    """(lang, word, n) over a sample of ``labelled(doc_id, text, lang)`` chosen by a hash of doc_id."""
    per = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not per:
        return labelled.sparkSession.createDataFrame([], "lang string, word string, n long")
    shares = {k: sample_shares(docs_per_language, n) for k, n in per.items()}
    coarse, fine = (F.create_map(*(F.lit(x) for k, own in shares.items() for x in (k, own[i])))[F.col("lang")] for i in (0, 1))
    sample = labelled.where(sampled(F.col("doc_id"), coarse, fine))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((lang, w[i : i + LONGEST_KEPT]) for w in words_of(text or "") for i in range(0, len(w), LONGEST_KEPT))  # long runs in pieces
            rows = [(k[0], k[1], n) for k, n in seen.items()]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["lang", "word", "n"]), pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), preserve_index=False)

    return sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, iterations: int = ITERATIONS, model_file: str | None = None) -> LanguageModel:
    model_file = model_file or piece_file()
    lat = lattice(model_file)
    words = materialise(word_counts(labelled.where("lang is not null"), docs_per_language), "lid-words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    usable = np.zeros(len(lat.pieces), bool)
    usable[lat.normal] = usable[lat.byte_ids] = True
    logp = np.tile(np.where(usable, -np.log(usable.sum()), -np.inf), (max(1, len(languages)), 1))
    for _ in range(iterations if languages else 0):
        given = words.sparkSession.sparkContext.broadcast(logp)  # languages * pieces numbers

        def expect(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            own = lattice(model_file)
            for batch in batches:
                pdf = batch.to_pandas()
                for lang, rows in pdf.groupby("lang"):
                    k, total = languages.index(lang), np.zeros(given.value.shape[1])
                    number = dict(zip(rows["word"], rows["n"]))
                    for part in by_length(list(number)):
                        total += own.expected(part, np.array([number[w] for w in part], float), given.value[k])
                    at = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at])], ["k", "piece", "n"])

        sums = words.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.where(usable, ALPHA, 0.0)[None].repeat(len(languages), 0)
        np.add.at(counts, (sums["k"].to_numpy(), sums["piece"].to_numpy()), sums["n"].to_numpy())
        with np.errstate(divide="ignore"):
            logp = np.log(counts / counts.sum(1, keepdims=True))
    return LanguageModel(languages, logp, model_file)


class WordScores:
    """Log-likelihood vectors of the words a Python worker saw last."""

    def __init__(self, model: LanguageModel):
        self.model, self.row, self.chars = model, {}, 0
        self.table = np.zeros((WORDS_KEPT * 2, len(model.languages)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        lacking = set().union(*texts) - self.row.keys()
        if len(self.row) + len(lacking) > len(self.table) or self.chars > CHARS_KEPT:
            self.row, lacking, self.chars = {}, set().union(*texts), 0
            if len(lacking) > len(self.table):
                self.table = np.zeros((len(lacking), self.table.shape[1]))
        self.chars += sum(map(len, lacking))
        for part in by_length(list(lacking)):
            first = len(self.row)
            self.row.update(zip(part, range(first, first + len(part))))
            self.table[first : first + len(part)] = lattice(self.model.model_file).forward(part, self.model.logp)[0].T
        return [self.table[list(map(self.row.__getitem__, own))].sum(0) for own in texts]


_scores: dict[str, WordScores] = {}


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (posterior of the predicted language) of every row of ``docs(doc_id, text)``."""
    import uuid

    tag, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _scores:
            _scores.clear()
            _scores[tag] = WordScores(shared.value)
        scores, words = _scores[tag], lattice(shared.value.model_file)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for own in by_chars(texts, 100):
                part = texts[own]
                known = [bool(t and shared.value.languages and any(map(str.isalpha, t))) for t in part]
                sums = iter(scores.of([words.words(t) for t, ok in zip(part, known) if ok]) if any(known) else [])
                lang, score = [], []
                for ok in known:
                    if not ok:
                        lang.append("und")
                        score.append(0.0)
                        continue
                    x = next(sums)
                    best = int(x.argmax())
                    lang.append(shared.value.languages[best])
                    score.append(float(1 / np.exp(np.minimum(x - x[best], 0)).sum()))
                yield pa.RecordBatch.from_arrays([ids.slice(own.start, len(part)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train(docs.where(~held).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", F.coalesce(held, F.lit(False)))
