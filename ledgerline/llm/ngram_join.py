"""N-gram Jaccard join: MinHash banding, verified on full n-gram sets.

Documents are sets of five-word shingles. Documents with equal sets form a class and are represented once. Bands of
MinHash values, in numbers chosen for a target recall at the threshold within a budget of hash values, are shuffled;
documents that share a band with others are linked into candidate groups, each of which receives its shingle sets once.
Within a group every pair is compared on the full sets. A group of more than ``BLOCK`` classes, or ``BLOCK_BYTES`` of sets, is
cut into blocks, those that share a band side by side, and two blocks meet, in a task of their own, only if a band is found in both;
so a long chain of small groups makes few tasks. Only counts and a spanning forest leave a block, never all pairs.

Shingles are compared by 64-bit hashes within pairs of documents: two texts of n shingles agree on one by chance with
a probability of about n * n / 2**64. Equal sets are told by 128 bits.

Defined cases: null and wordless texts have no shingles, no links and a class of their own; a text of one to four words is
one shingle; words are runs of other characters than white space, compared as they are; a class takes the smallest
doc_id of its connected documents; rows that share a doc_id are told apart by their text; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, connected_components, documents, keyed, materialise, nested, tidy, unnested
from .wordhash import hash_words, mix

WORDS, SIMILARITY, RECALL, HASHES, BLOCK, BLOCK_BYTES = 5, 0.8, 0.99995, 128, 512, 1 << 23
SIGNED = "row_id long, set_key string, size int, bands array<long>"


def bands_and_rows(similarity: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows such that a pair just at the threshold shares a band with at least the target probability: the most rows, and so fewest chance candidates, whose values stay within ``hashes``."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))
        if bands * rows <= hashes:
            return bands, rows
    return math.ceil(math.log(1 - recall) / math.log1p(-similarity)), 1


def shingles(text: bytes, words: int) -> np.ndarray:
    """Ascending distinct shingle hashes of a text."""
    h, _ = hash_words(text)
    if not len(h):
        return h
    k = min(words, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + h[i : len(h) - k + 1 + i]
    return np.unique(mix(out))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(row_id, set_key, size, bands) of every row of ``docs(row_id, text)``; no bands and a null key without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(7)
        factor = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        for batch in batches:
            keys, sizes, bandsets = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                own = shingles(text or b"", words)
                sizes.append(len(own))
                if not len(own):
                    keys.append(None)
                    bandsets.append(np.zeros(0, np.int64))
                    continue
                least = np.full(bands * rows, np.uint64(2**64 - 1))
                for k in range(0, len(own), 512):
                    np.minimum(least, (own[k : k + 512, None] * factor + shift).min(0), out=least)
                joined = np.zeros(bands, np.uint64)
                for r in least.reshape(bands, rows).T:
                    joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + r)
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest())
                bandsets.append(mix(joined + np.arange(bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(bandsets, pa.list_(pa.int64()))], [x.split()[0] for x in SIGNED.split(", ")])

    return docs.select("row_id", "text").mapInArrow(tidy(run), SIGNED)


def compare(similarity: float):
    """For one group of classes, or two blocks of one: each class's links and copies of partners, and its root in the group's forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid", ignore_index=True)
        sets, block = [np.frombuffer(x, np.uint64) for x in pdf["words"]], pdf["block"].to_numpy()
        n, size, weight = len(sets), np.array([len(x) for x in sets]), pdf["copies"].to_numpy(np.int64)
        across = pdf["first"].iloc[0] != pdf["second"].iloc[0]
        if n <= 12:
            shared = np.zeros((n, n), np.int64)
            for i in range(n):
                for j in range(i):
                    shared[i, j] = shared[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        else:
            words, of = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(n), size)
            often = np.bincount(of)[of] > 1  # a shingle of one class adds to no pair
            place = np.cumsum(np.bincount(of, minlength=len(words)) > 1) - 1
            col, owner, shared = place[of[often]], owner[often], np.zeros((n, n), np.float32)
            order = np.argsort(col, kind="stable")
            col, owner = col[order], owner[order]
            width = max(256, (1 << 23) // n)
            for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
                a, b = np.searchsorted(col, (c, c + width))
                part = np.zeros((n, width), np.float32)
                part[owner[a:b], col[a:b] - c] = 1
                shared += part @ part.T
        like = shared >= similarity * (size[:, None] + size[None] - shared) - 1e-6
        np.fill_diagonal(like, False)
        if across:
            like &= block[:, None] != block[None]
        root = np.arange(n)
        while True:  # the smallest member of each part of the group
            now = np.minimum(root, np.where(like, root[None], n).min(1))
            now = np.minimum(now, now[now])
            if (now == root).all():
                break
            root = now
        rid = pdf["rid"].to_numpy()
        return pd.DataFrame({"rid": rid, "linked": like.sum(1), "copies_linked": like @ weight, "root": rid[root], "whole": np.full(n, pdf["blocks"].iloc[0] == 1)})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(row_id, class_row, n_links, n_copies) of every row of ``docs(row_id, text)``; class_row is the smallest row_id of the class.

    ``n_links`` counts the other documents whose similarity reaches the threshold, ``n_copies`` those with an equal set.
    """
    bands, rows = bands_and_rows(similarity, recall)
    signed = materialise(signatures(docs, words, bands, rows), "ngram-signed")
    classes = signed.where("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("rid"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "ngram-classes")
    banded = signed.select("row_id", F.explode("bands").alias("band")).join(classes.select(F.col("rid").alias("row_id")), "row_id", "left_semi")
    shared = banded.groupBy("band").agg(F.min("row_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = banded.join(shared, "band").where("row_id <> head").select(F.col("row_id").alias("a"), F.col("head").alias("b")).distinct()
    groups = connected_components(edges, "ngram-candidates")
    known = classes.join(signed.select(F.col("row_id").alias("rid"), "size"), "rid").select(F.col("rid").alias("vertex"), "copies", "size")
    placed = materialise(groups.join(known, "vertex"), "ngram-placed")
    sizes = placed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    member_bands = banded.join(shared.select("band"), "band").select(F.col("row_id").alias("vertex"), "band")
    # Classes of one band stand together, by their lowest; those of a band that holds more than a block are dealt out.
    lowest = member_bands.groupBy("vertex").agg(F.min("band").alias("low"))
    crowd = lowest.groupBy("low").agg(F.count(F.lit(1)).alias("crowd"))
    near = lowest.join(crowd, "low").select("vertex", F.when(F.col("crowd") <= block, F.xxhash64("low")).otherwise(F.xxhash64("vertex")).alias("stand"))
    members = placed.join(sizes, "component").join(near, "vertex").select(F.col("vertex").alias("rid"), "component", "copies", "blocks", F.pmod("stand", "blocks").cast("int").alias("block"))
    members = materialise(members, "ngram-members")
    held = materialise(member_bands.join(members.where("blocks > 1").select(F.col("rid").alias("vertex"), "component", "block"), "vertex").select("band", "component", "block").distinct(), "ngram-blocks")
    across = held.join(held.select("band", "component", F.col("block").alias("other")), ["band", "component"]).where("block < other").select("component", F.col("block").alias("first"), F.col("other").alias("second"))
    within = members.select("component", F.col("block").alias("first"), F.col("block").alias("second"))
    tasks = across.unionByName(within).distinct().select("component", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"", words).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["rid", "words"])

    texts = docs.select(F.col("row_id").alias("rid"), "text").join(broadcast_if_small(members.select("rid")), "rid", "left_semi")
    loaded = texts.mapInArrow(tidy(load), "rid long, words binary").join(members, "rid")
    dealt = loaded.join(tasks, ["component", "block"]).select("rid", "words", "component", "copies", "blocks", "block", "first", "second")
    found = dealt.groupBy("component", "first", "second").applyInPandas(compare(similarity), "rid long, linked long, copies_linked long, root long, whole boolean")
    found = materialise(found, "ngram-found")
    links = found.groupBy("rid").agg(F.sum("linked").alias("linked"), F.sum("copies_linked").alias("copies_linked"))
    roots = found.where("whole").select("rid", "root")
    wide = materialise(found.where("not whole and rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")).distinct(), "ngram-wide")
    if wide.limit(1).count():
        roots = roots.unionByName(connected_components(wide, "ngram-classes-wide").select(F.col("vertex").alias("rid"), F.col("component").alias("root")))
    merged = classes.join(links, "rid", "left").join(roots, "rid", "left").select("set_key", "copies", F.coalesce("copies_linked", F.lit(0)).alias("copies_linked"), F.coalesce("root", "rid").alias("root"))
    out = signed.select("row_id", "set_key").join(merged, "set_key", "left")
    # Row ids follow the order of doc_id, so the root, a class's smallest row id, names the smallest doc_id.
    return out.select("row_id", F.coalesce("root", "row_id").alias("class_row"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("copies_linked", F.lit(0))).alias("n_links"), (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with only the first document, by doc_id, of each class."""
    rows = keyed(nested(docs, "doc_id", "text"))
    gone = materialise(near_duplicates(rows.select("row_id", "text"), **options).where("row_id <> class_row").select("row_id"), "ngram-gone")
    return unnested(rows.join(broadcast_if_small(gone), "row_id", "left_anti"), docs.columns)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(documents(spark, sf_dir).select("doc_id", "text"))
    found = near_duplicates(rows)
    ids = rows.select("row_id", "doc_id")
    named = found.join(ids, "row_id").join(ids.select(F.col("row_id").alias("class_row"), F.col("doc_id").alias("class_id")), "class_row")
    return named.select("doc_id", "class_id", "n_links", "n_copies")
