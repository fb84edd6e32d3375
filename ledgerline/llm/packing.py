"""Packing: shortest-pack-first over the length histogram.

Documents are tokenized and cut at the sequence length, so every piece but a document's last fills a sequence. The
histogram of piece lengths has at most ``capacity`` entries; on the driver, lengths are placed longest first into
the emptiest pattern that can take them, and pattern counts are split as they are used up. Patterns are then joined
back to the pieces by rank: the n-th piece of a length takes the n-th slot of that length. Ranks come from
counts per (length, salt), so a length that many documents share is ranked in many tasks.

Defined cases: null text is empty (one piece with the end id alone); repeated rows are packed one by one; an empty
table gives no rows; a text of any length is cut; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import broadcast_if_small, documents, materialise, tidy

CAPACITY, END_ID = 2048, 1
#: Pieces that one ranking group holds on average, at most, if all have one length.
RANK_ROWS = 50_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Recent(dict):
    """Values of the short keys seen last. When it is full, all it holds becomes ``older`` in place of what that held, so memory is bounded and frequent keys are not lost."""

    LIMIT, LONGEST = 131_072, 48

    def __init__(self):
        super().__init__()
        self.older: dict = {}

    def keep(self, key: str, value: bytes) -> bytes:
        if len(key) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class WordIds(Recent):
    """Little-endian token ids of a word (text between spaces or line feeds), kept for the words seen last.

    The vocabulary lower-cases, drops white space and never merges across it, so a text's ids are its words' ids
    in order. Plain words go straight to the merge model; any other goes through the whole tokenizer. Each task has its own.
    """

    _plain = re.compile("[!-;=-~À-ɏ]+")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model  # the same one, not a copy
        self.cut = regex.compile(json.loads(self.whole.pre_tokenizer.__getstate__())["pretokenizers"][0]["pattern"]["Regex"]).findall  # the vocabulary is not parsed again
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte-level alphabet writes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.runs = Recent()

    def merged(self, s: str) -> bytes:
        shown = s if s.isascii() else "".join(map(self.letters.__getitem__, s.encode()))
        return b"".join([x.id.to_bytes(4, "little") for x in self.bpe.tokenize(shown)])

    def run(self, s: str) -> bytes:
        """Ids of a piece of a word; a piece of plain letters is a word."""
        if s.isascii() and s.isalpha():
            return self[s]
        found = self.runs.get(s)
        if found is None:
            found = self.runs.older.get(s)
            found = self.runs.keep(s, self.merged(s) if found is None else found)
        return found

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        return self.keep(word, self.ids(word) if found is None else found)

    def ids(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.merged(word) if word.islower() else self[word.lower()]
        if not word:
            return b""
        if self._plain.fullmatch(word):
            low = word.lower() if word.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", word))
            return b"".join(map(self.run, self.cut(low)))
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def cut_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` (array of int) if asked for."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = words.text(text.as_py() or "") + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    own = raw[4 * start : 4 * (start + capacity)]
                    for col, x in zip(cols, (doc_id, start, len(own) // 4, zlib.crc32(own), n, np.frombuffer(own, "<u4").astype("i4") if with_ids else None)):
                        col.append(x)
            arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.list_(pa.int32()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(pieces), schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, count): how many sequences hold just these lengths. Longest lengths are placed first, each into the emptiest pattern."""
    room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max((s for s, x in room.items() if x), default=0)
            if space < length:
                room[capacity - length].append(([length], left))
                break
            lengths, count = room[space].pop()
            used = min(count, left)
            if count > used:
                room[space].append((lengths, count - used))
            room[space - length].append(([*lengths, length], used))
            left -= used
    return [x for own in room.values() for x in own]


def slots(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): ranks of a length in this range sit at this offset of consecutive sequences."""
    out, sequence, rank = [], 0, defaultdict(int)
    for lengths, count in sorted(patterns, reverse=True):
        at = 0
        for length in lengths:
            out.append((length, rank[length], rank[length] + count, sequence, at))
            rank[length] += count
            at += length
        sequence += count
    return out


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with a ``length`` of 1 to ``capacity``; ``pieces`` should be a written table, as it is read three times."""
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(1, -(-total // RANK_ROWS))
    salted = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = materialise(salted.groupBy("length", "salt_").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.createDataFrame(slots(shortest_pack_first(histogram, capacity)), T.StructType([T.StructField(x, T.LongType()) for x in ("length", "rank_from", "rank_to", "sequence_from", "offset")]))
    before = counts.select("length", "salt_", (F.sum("n").over(Window.partitionBy("length").orderBy("salt_")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt_").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(broadcast_if_small(before), ["length", "salt_"]).withColumn("rank", F.col("before") + F.col("nth") - 1)
    placed = ranked.join(broadcast_if_small(table), "length").where("rank >= rank_from and rank < rank_to")
    return placed.select(*pieces.columns, (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences (sequence_id, ids) of packed pieces that carry ``ids``."""
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"))


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack_pieces(materialise(cut_documents(docs), "packing-pieces"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
