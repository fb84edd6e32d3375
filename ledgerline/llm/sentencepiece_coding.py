"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

A text is encoded behind one space mark, spaces being marks. The best segmentation has the largest sum of piece
scores; a character that no piece starts or is costs the least score less ten and becomes its byte pieces. Decoding
joins pieces, reads byte runs as UTF-8 and turns marks into spaces, less the first. Each Python worker keeps the
segmentations of the words that it saw last. The scores are those of the file: tokenizers are not trained here.

Defined cases: a text that holds the space mark itself decodes to one with spaces there, so its ``round_trip`` is false; null text stays null in every result column; empty text has no pieces; texts of any length are
encoded whole; repeated rows are encoded one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents
from .lattice import MARK, PieceLattice, by_chars, by_length

#: Words that a worker keeps, and their characters.
WORDS_KEPT, CHARS_KEPT = 700_000, 1 << 24


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


_lattices: dict[str, PieceLattice] = {}  # one per Python worker


def lattice(model_file: str) -> PieceLattice:
    return _lattices.get(model_file) or _lattices.setdefault(model_file, PieceLattice(model_file))


class Encoder:
    """Segmentations of the words a Python worker saw last: a number for each word, and by number its ids, score and byte pieces."""

    def __init__(self, model_file: str):
        self.lattice = lattice(model_file)
        self.byte_of = {int(i): b for b, i in enumerate(self.lattice.byte_ids)}
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[bytes] = []
        self.facts, self.chars = np.zeros((0, 2)), 0

    def learn(self, texts: list[list[str]]) -> None:
        """Makes all words of these texts known."""
        lacking = set().union(*texts) - self.number.keys()
        if len(self.number) + len(lacking) > WORDS_KEPT or self.chars > CHARS_KEPT:
            self.forget()
            lacking = set().union(*texts)
        self.chars += sum(map(len, lacking))
        for own in by_length(list(lacking)):
            ids, cuts, scores, spelt = self.lattice.viterbi(own)
            raw, at = ids.tobytes(), (4 * cuts).tolist()
            first = len(self.number)
            self.number.update(zip(own, range(first, first + len(own))))
            self.ids += [raw[a:b] for a, b in zip(at, at[1:])]
            self.facts = np.concatenate([self.facts, np.column_stack([scores, spelt])])


def decode_word(raw: bytes, pieces: list[str], byte_of: dict[int, int]) -> str:
    """The word, space marks left in it, that little-endian ids spell."""
    ids = np.frombuffer(raw, "<i4").tolist()
    if not byte_of.keys() & ids:
        return "".join([pieces[i] for i in ids])
    out, run = [], bytearray()
    for i in ids:
        if i in byte_of:
            run.append(byte_of[i])
        else:
            out.append(run.decode("utf-8", "replace") + pieces[i])
            run.clear()
    return "".join(out) + run.decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def decode_ids(raw: bytes, pieces: list[str], byte_of: dict[int, int]) -> str:
    """The text of little-endian ids: marks become spaces, and the first one goes."""
    text = decode_word(raw, pieces, byte_of).replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model_file: str | None = None, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``n_bytes`` (byte pieces), ``score``, and ``ids``; with ``digest`` instead of ids ``ids_crc32`` (little-endian) and ``round_trip``: whether the ids decode to the whole text."""
    model_file = model_file or piece_file()
    schema = "doc_id long, n_pieces long, n_bytes long, score double, " + ("ids_crc32 long, round_trip boolean" if digest else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(model_file) or _encoders.setdefault(model_file, Encoder(model_file))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for own_rows in by_chars(texts):
                part = texts[own_rows]
                words = [encoder.lattice.words(t) if t else [] for t in part]
                encoder.learn(words)
                rows = []
                for text, own in zip(part, words):
                    if text is None:
                        rows.append((None,) * 5)
                        continue
                    at = list(map(encoder.number.__getitem__, own))
                    raw = b"".join([encoder.ids[i] for i in at])
                    score, spelt = encoder.facts[at].sum(0) if at else (0.0, 0)
                    rows.append((len(raw) // 4, int(spelt), float(score), *((zlib.crc32(raw), decode_ids(raw, encoder.lattice.pieces, encoder.byte_of) == text) if digest else (np.frombuffer(raw, "<i4"), None))))
                cols = list(zip(*rows)) if rows else [()] * 5
                arrays = [batch.column(0).slice(own_rows.start, len(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())]
                arrays += [pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.bool_())] if digest else [pa.array(cols[3], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_file: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of ``encoded(doc_id, ids)``; ids out of range are an error, null ids give null."""
    model_file = model_file or piece_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(model_file)
        byte_of = {int(i): b for b, i in enumerate(lat.byte_ids)}
        for batch in batches:
            texts = [None if ids is None else decode_ids(np.array(ids, "<i4").tobytes(), lat.pieces, byte_of) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digest=True)
