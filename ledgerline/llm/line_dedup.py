"""Line dedup: exact set-similarity join over the word sets of lines.

Lines of at least ``min_words`` words are sets of words. Words are ordered by rarity: by how often words of their
hash bucket occur, over all documents, then by bucket and hash, which is one order for all lines. If two sets have a Jaccard
similarity of at least t, their prefixes of n - ceil(t n) + 1 words share a word; so prefix words are shuffled. Each
word's group is sorted by size; a line looks through those whose sizes fit its own and the word's position in it, and meets the
earlier ones that pass the length filter, the positional filter and a bitmap filter (the parity of word hashes per bit never
differs more than the sets do). Surviving pairs are verified on the whole sets. A line is removed if an earlier line, by
document and line number, is as similar; copies are found by a hash of their words that needs no sorting (see ``set_keys``),
and sets so small that only equal ones are similar send no words. A line meets at most ``NEAR`` earlier ones per word in the
first round; those that had more and were not matched meet all in a second round, so nothing is lost and a group of like
lines does not make all its pairs.

Words are dealt to shelves, in numbers that follow the input. A shelf that a sample shows to be hot is cut into parts, and
each pair of parts meets in a task of its own. The sample steers the work only; no result depends on it.

Words are compared by 64-bit hashes. Two of the few words of two compared lines agree by chance with a probability
of about 1e-17 a pair of lines; equal sets are told by 128 bits.

Defined cases: null text stays null and has one empty line; lines without a word stay; documents are ordered by doc_id (nulls
first), and rows that share one by their text; lines without change keep their bytes; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, broadcast_if_small, documents, keyed, materialise, tidy, unnested
from .wordhash import hash_words, mix

#: Similarity as a fraction, least number of words of a line, and bits of a word's hash that choose its rarity bucket.
SIMILARITY, MIN_WORDS, BUCKET_BITS = (4, 5), 1, 19
NEAR = 4
#: Bytes of (row_id, line numbers) up to which they are broadcast instead of shuffling texts; slots of the second round's bitmap of words.
BROADCAST_BYTES, SLOTS = 48 << 20, 1 << 22
#: Bytes of text whose lines are taken at once, of entries whose words are, and sets that a task remembers to have sent.
PIECE, GROUP_BYTES, REMEMBERED = 1 << 18, 1 << 22, 1 << 16
#: Least number of shelves, words of all sets for each shelf, entry bytes of a part of a hot shelf, rows of the sample (one of so many).
SHELVES, SHELF_WORDS, HOT_BYTES, SAMPLE = 2048, 1 << 15, 1 << 23, 64
#: Parts of the bucket counts, words that a task counts at once, and entries that it sends at once.
PARTS, COUNTED, HELD = 64, 1 << 20, 150_000
LINES = "part int, counts binary, row_id long, line_no int, again boolean, h1 long, h2 long"
#: A prefix word of a line: the word, the line's place, its words, the word's position by rarity, whether the second round asks for the line, the parity of word hashes per bit.
ENTRY = np.dtype([("word", "<u8"), ("row", "<i8"), ("line", "<i4"), ("size", "<i4"), ("at", "<u2"), ("open", "?"), ("bits", "<u8", 3)])
#: A set that a task has sent: its hash and place, and whether the slot is taken.
SENT = np.dtype([("key", "<u8"), ("row", "<i8"), ("line", "<i4"), ("full", "?")])


def held_in(wanted: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether each word's slot is set in a bitmap."""
    slot = (word & np.uint64(SLOTS - 1)).astype(np.int64)
    return (wanted[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def by_rarity(word: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that sort words by rarity: the place of a word's bucket in that order above the hash bits that differ within a bucket; one to one."""
    low = np.uint64(65 - len(places).bit_length())
    return (places[(word >> low).astype(np.int64)].astype(np.uint64) << low) | (word & ((np.uint64(1) << low) - np.uint64(1)))


def line_words(batch: pa.RecordBatch, min_words: int, wanted: np.ndarray | None = None) -> Iterator[dict]:
    """Words of lines with enough of them, and with a ``wanted`` one if that bitmap is given, about ``PIECE`` bytes of (row_id, text) at a time.

    ``word``: hashes as they come in the text, repeats included; ``first``: where each line begins in it; ``size``, ``row_id``, ``line_no``: per line.
    """
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).cast(pa.binary())
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PIECE)))
        texts = [x or b"" for x in column.slice(at, end - at).to_pylist()]
        data = b"\n".join(texts)
        word, start = hash_words(data)
        bounds = np.concatenate(([0], np.searchsorted(start, np.flatnonzero(np.frombuffer(data, np.uint8) == 10)), [len(word)]))  # words before each line, and all
        n_lines = np.array([x.count(b"\n") + 1 for x in texts])
        first_line = np.cumsum(n_lines) - n_lines
        size = np.diff(bounds)
        enough = size >= max(min_words, 1)
        if wanted is not None:
            enough &= np.diff(np.concatenate(([0], np.cumsum(held_in(wanted, word))))[bounds]) > 0
        if enough.any():
            own = np.flatnonzero(enough)
            doc = np.searchsorted(first_line, own, side="right") - 1
            yield {"word": word if enough.all() else word[np.repeat(enough, size)], **placed(size[own]), "row_id": ids[at:end][doc].astype(np.int64), "line_no": (own - first_line[doc]).astype(np.int32)}
        at = end


def placed(size: np.ndarray) -> dict:
    return {"first": np.cumsum(size) - size, "size": size}


def chosen(s: dict, keep: np.ndarray) -> dict:
    """Some of the lines."""
    if keep.all():
        return s
    return {"word": s["word"][np.repeat(keep, s["size"])], **placed(s["size"][keep]), "row_id": s["row_id"][keep], "line_no": s["line_no"][keep]}


def word_sets(s: dict, places: np.ndarray | None = None) -> dict:
    """Each line's words once, ascending by hash, or by rarity if the buckets' ``places`` in that order are given."""
    word, size = s["word"], s["size"]
    line = np.repeat(np.arange(len(size)), size)
    rank, b = word if places is None else by_rarity(word, places), np.uint64(len(size).bit_length())
    key = (line.astype(np.uint64) << (np.uint64(64) - b)) | (rank >> b)  # one sort by line and the upper bits; should words of a line agree in these, they are sorted in full
    order = np.argsort(key)
    sorted_, key = word[order], key[order]
    alike = key[1:] == key[:-1]
    if (sorted_[1:][alike] != sorted_[:-1][alike]).any():
        order = np.argsort(rank)
        order = order[np.argsort(line[order], kind="stable")]
        sorted_ = word[order]
        alike = (sorted_[1:] == sorted_[:-1]) & (line[1:] == line[:-1])
    if not alike.any():
        return s | {"word": sorted_}
    new = np.append(True, ~alike)
    return s | {"word": sorted_[new], **placed(np.bincount(line[new], minlength=len(size)))}


def set_keys(s: dict, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each line's words.

    Lines of equal sets that repeat words differently may differ in them and are then found by their prefixes. Sets that send none have one hash: lines
    with so few words, by a count of bits that depends on the set only, are taken as sets.
    """
    salt = np.uint64(0xA24BAED4963EE407)
    hashed = lambda s: (mix(np.add.reduceat(mix(s["word"] ^ salt), s["first"]) + s["size"].astype(np.uint64)), mix(np.add.reduceat(mix(s["word"] + salt), s["first"])))
    h1, h2 = hashed(s)
    a, b = similarity
    few = np.bitwise_count(np.bitwise_or.reduceat(np.uint64(1) << (s["word"] & np.uint64(63)), s["first"])) <= ((a - 1) // (b - a) if b > a else 64)
    if few.any():
        h1[few], h2[few] = hashed(word_sets(chosen(s, few)))
    return h1, h2


def scan_lines(docs: DataFrame, similarity: tuple[int, int], min_words: int, bits: int) -> DataFrame:
    """Rows (row_id, line_no, again, h1, h2) of every line with enough words, and for each task rows (part, counts): words in each bucket of that part.

    ``again``: whether an earlier line of the same text has these hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, names = np.zeros(1 << bits, np.int64), [], [x.split()[0] for x in LINES.split(", ")]
        for batch in batches:
            for s in line_words(batch, min_words):
                held.append((s["word"] >> np.uint64(64 - bits)).astype(np.int32))
                if sum(map(len, held)) > COUNTED:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held.clear()
                h1, h2 = set_keys(s, similarity)
                order = np.lexsort((s["line_no"], h2, h1, s["row_id"]))
                again = np.zeros(len(h1), bool)
                again[order[1:]] = np.all([x[order[1:]] == x[order[:-1]] for x in (h1, h2, s["row_id"])], axis=0)
                none = [pa.nulls(len(h1), pa.int32()), pa.nulls(len(h1), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(s["row_id"]), pa.array(s["line_no"]), pa.array(again), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits)
        if counts.any():
            parts = [x.tobytes() for x in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary()), *(pa.nulls(PARTS, t) for t in (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()))], names)

    return docs.select("row_id", "text").mapInArrow(tidy(run), LINES)


def bucket_counts(scan: DataFrame, bits: int) -> np.ndarray:
    """The tasks' counts, added up part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])

    tasks = scan.where("part is not null").select("part", "counts").repartition("part").mapInArrow(tidy(add), "part int, counts binary")
    rows = tasks.collect()  # PARTS rows, 2**bits numbers
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows)]) if rows else np.zeros(1 << bits, np.int64)


def alone(size: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Whether a set of this size is similar to equal sets only."""
    a, b = similarity
    return (size * b // a <= size) & (-(-2 * a * size // (a + b)) >= size)


def prefixes(docs: DataFrame, rarity, similarity: tuple[int, int], min_words: int, bits: int, shelves: int, wanted=None, slots: bool = False) -> DataFrame:
    """Prefix words of every set as rows (shelf, entries): packed ``ENTRY`` rows of words on that shelf.

    Of equal sets those go that come after one that the task remembers to have sent, so the earliest of all always speaks.
    ``rarity`` is the broadcast place of each bucket in the order of rarity. A third column of ``docs``, if there, lists a row's open lines, which speak in
    any case and are marked; ``wanted``, a broadcast bitmap over hashed words, leaves out words that are not in it.
    With ``slots`` only that bitmap's slots of the open lines' words leave, in place of shelves, without entries.
    """
    a, b = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(REMEMBERED, SENT)  # in a slot the last set that was sent and its earliest place so far
        held: list[np.ndarray] = []

        def fresh_lines(s: dict) -> np.ndarray:
            key, row, line = set_keys(s, similarity)[0], s["row_id"], s["line_no"]
            order = np.lexsort((line, row, key))
            first = order[np.append(True, key[order[1:]] != key[order[:-1]])]
            own = np.empty(len(first), SENT)
            own["key"], own["row"], own["line"], own["full"] = key[first], row[first], line[first], True
            slot = (own["key"] % np.uint64(REMEMBERED)).astype(np.int64)
            known = sent[slot]
            before = (known["row"] < own["row"]) | ((known["row"] == own["row"]) & (known["line"] <= own["line"]))
            new = ~(known["full"] & (known["key"] == own["key"]) & before)
            sent[slot[new]] = own[new]
            fresh = np.zeros(len(key), bool)
            fresh[first[new]] = True
            return fresh

        def flush() -> pa.RecordBatch:
            rows = np.concatenate(held)
            held.clear()
            shelf = (rows["word"] % np.uint64(shelves)).astype(np.int64)
            order = np.argsort(shelf, kind="stable")
            names, at = np.unique(shelf[order], return_index=True)
            offsets = (np.append(at, len(rows)) * ENTRY.itemsize).astype(np.int32)
            entries = rows.view(f"V{ENTRY.itemsize}")[order]
            return pa.RecordBatch.from_arrays([pa.array(names), pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(entries.view(np.uint8))])], ["shelf", "entries"])

        for batch in batches:
            asked = {(r, n) for r, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) for n in own or ()} if batch.num_columns > 2 else set()
            asked_rows = np.array([*{r for r, _ in asked}], np.int64)
            for s in line_words(batch.select([0, 1]), min_words, None if wanted is None else wanted.value):
                opened = np.zeros(len(s["first"]), bool)
                if asked:
                    some = np.flatnonzero(np.isin(s["row_id"], asked_rows))
                    opened[some] = [x in asked for x in zip(s["row_id"][some].tolist(), s["line_no"][some].tolist())]
                speaks = opened if slots else fresh_lines(s) | opened
                if not speaks.any():
                    continue
                s, opened = word_sets(chosen(s, speaks), rarity.value), opened[speaks]
                many = ~alone(s["size"], similarity)
                if not many.any():
                    continue
                s, opened = chosen(s, many), opened[many]
                word, first, size = s["word"], s["first"], s["size"]
                n = size - -(-a * size // b) + 1
                own = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(own)) - placed(n)["first"][own]
                took = word[first[own] + at]
                if slots:
                    slot = np.unique(took & np.uint64(SLOTS - 1)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.nulls(len(slot), pa.binary())], ["shelf", "entries"])
                    continue
                if wanted is not None:
                    held_too = held_in(wanted.value, took)
                    own, at, took = own[held_too], at[held_too], took[held_too]
                    if not len(own):
                        continue
                plane, flag = ((word & np.uint64(0xFFFF)) * np.uint64(3)) >> np.uint64(16), np.uint64(1) << ((word >> np.uint64(16)) & np.uint64(63))
                rows = np.empty(len(own), ENTRY)
                rows["word"], rows["row"], rows["line"], rows["size"], rows["at"], rows["open"] = took, s["row_id"][own], s["line_no"][own], size[own], np.minimum(at, 65535), opened[own]  # a smaller position only weakens the filter
                for k in range(3):
                    rows["bits"][:, k] = np.bitwise_xor.reduceat(np.where(plane == k, flag, np.uint64(0)), first)[own]
                held.append(rows)
                if sum(map(len, held)) > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(tidy(run), "shelf long, entries binary")


#: A pair, whether the line had more partners, and how many bits the two sets' bitmaps differ in.
PAIRS = "row_a long, line_a int, row_b long, line_b int, more boolean, apart int"


def dealt(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """(cell, shelf, role, entries), sorted by cell within partitions: a shelf is a cell, but one of p parts makes a cell of each pair of them.

    In a cell of two parts the entries of one look for partners (role 1) among those of the other (role 2); else each does both (role 3).
    """
    part = F.pmod(F.xxhash64("entries"), F.col("parts"))
    cells = F.when(F.col("parts").isNull(), F.expr("array(named_struct('x', 0L, 'y', 0L, 'role', 3))")).otherwise(F.expr("""concat(
        transform(sequence(0L, parts - 1), k -> named_struct('x', part, 'y', k, 'role', if(k = part, 3, 1))),
        transform(filter(sequence(0L, parts - 1), k -> k <> part), k -> named_struct('x', k, 'y', part, 'role', 2)))"""))
    rows = entries.join(broadcast_if_small(hot), "shelf", "left").withColumn("part", part).select("shelf", "entries", F.explode(cells).alias("c"))
    return rows.select(F.xxhash64("shelf", "c.x", "c.y").alias("cell"), "shelf", "c.x", "c.y", "c.role", "entries").repartition("cell").sortWithinPartitions("cell", "shelf", "x", "y").select("shelf", "x", "y", "role", "entries")


def meet(similarity: tuple[int, int], near: int | None):
    """For the entries of whole cells: each line's earlier partners under a word that pass the filters, at most ``near``; all of them for open lines only, if that is None."""
    a, b = similarity

    def group(blobs: list[bytes], roles: list[int]) -> pa.RecordBatch:
        rows = np.frombuffer(b"".join(blobs), ENTRY)
        role = np.repeat(np.array(roles, np.int8), [len(x) // ENTRY.itemsize for x in blobs])
        word = np.ascontiguousarray(rows["word"])
        order = np.argsort(word)
        sorted_ = word[order]
        alike = sorted_[1:] == sorted_[:-1]
        pick = np.append(False, alike) | np.append(alike, False)  # a word of one line has no pair
        order, group_of = order[pick], np.cumsum(np.append(True, ~alike)[pick])
        # Within a word lines ascend by size and, nearly, by place: the partners that sizes and positions allow lie together, early lines first.
        row = rows["row"][order]
        low, high = (int(row.min()), int(row.max())) if len(row) else (0, 0)
        place = (row - low).astype(np.uint64) >> np.uint64(max(0, (high - low).bit_length() - 24))  # of 24 bits; a difference beyond 63 bits wraps to the right number
        key = (group_of << 40) | (np.minimum(rows["size"][order], 65535).astype(np.int64) << 24) | place.astype(np.int64)
        again = np.argsort(key)
        order, key = order[again], key[again] >> 24
        rows, role = rows.view(f"V{ENTRY.itemsize}")[order].view(ENTRY), role[order]
        row, line, size, at = (np.ascontiguousarray(rows[k]) for k in ("row", "line", "size", "at"))
        size, at, bits = size.astype(np.int64), at.astype(np.int64), np.ascontiguousarray(rows["bits"].T)
        asks, answers = (role & 1 == 1) & (rows["open"] if near is None else True), role & 2 == 2
        active = np.flatnonzero(asks)
        least, most_ = -(-a * size[active] // b), ((a + b) * (size[active] - at[active]) - a * size[active]) // a
        word_key = key[active] >> 16 << 16
        start = np.searchsorted(key, word_key | np.minimum(least, 65535))
        stop = np.searchsorted(key, word_key | np.clip(most_, 0, 65535), side="right")
        # A line begins with those just before it and goes on from the other end, so the lines of a group have different partners.
        begin, room, seen = np.clip(active, start, stop) - 1, stop - start, 0
        begin, start, active, room = (z[room > 0] for z in (begin, start, active, room))
        found, count = [], np.zeros(len(rows), np.int32)
        while len(active):
            step = min(64, max(1, 65536 // len(active)))  # partners that each line looks at at once
            i, k = np.nonzero(seen + np.arange(step) < room[:, None])
            x, y = active[i], begin[i] - seen - k
            y += np.where(y < start[i], room[i], 0)
            nx, ny = size[x], size[y]
            need = -(-a * (nx + ny) // (a + b))
            ok = answers[y] & (b * np.minimum(nx, ny) >= a * np.maximum(nx, ny)) & (np.minimum(nx - at[x], ny - at[y]) >= need)
            ok &= (row[y] < row[x]) | ((row[y] == row[x]) & (line[y] < line[x]))
            x, y, most, left = x[ok], y[ok], (nx + ny - 2 * need)[ok], (seen + k + 1 < room[i])[ok]
            apart = np.zeros(len(x), np.int64)
            for q in bits:
                apart += np.bitwise_count(q[x] ^ q[y])
            ok = apart <= most
            x, y, apart, left = x[ok], y[ok], apart[ok], left[ok]
            if len(x):  # pairs of a line follow each other
                new = np.append(True, x[1:] != x[:-1])
                nth = np.arange(len(x)) - np.flatnonzero(new)[np.cumsum(new) - 1] + count[x] + 1
                ok = nth <= near if near else np.ones(len(x), bool)
                found.append((y[ok], x[ok], ((nth == near) & left)[ok] if near else np.zeros(len(x), bool), apart[ok].astype(np.int32)))
                count += np.bincount(x[ok], minlength=len(count)).astype(np.int32)
            seen += step
            go = (seen < room) & ((count[active] < near) if near else True)
            begin, start, active, room = begin[go], start[go], active[go], room[go]
        y, x, more, apart = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(z) for z in (row[y], line[y], row[x], line[x], more, apart)], [q.split()[0] for q in PAIRS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, roles, total, last, split = [], [], 0, None, False
        for batch in batches:  # whole cells, one after the other
            for shelf, x, y, role, entries in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                cell = (shelf, x, y)
                # Cells of one shelf must not be joined, as they hold the same entries in other roles.
                if cell != last and blobs and (total > GROUP_BYTES or split or role != 3):
                    yield group(blobs, roles)
                    blobs, roles, total, split = [], [], 0, False
                if cell != last:
                    split = False
                split = split or role != 3 or x != 0 or y != 0
                blobs.append(entries.as_py())
                roles.append(role)
                total, last = total + len(blobs[-1]), cell
        if blobs:
            yield group(blobs, roles)

    return run


def listed(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """``docs(row_id, text)`` with ``lines``, the line numbers of (row_id, line_no); these are broadcast within ``BROADCAST_BYTES``, else texts are shuffled."""
    lists = materialise(places.groupBy("row_id").agg(F.collect_list("line_no").alias("lines")), "lines-wanted")
    if (lists.agg(F.sum(40 + 4 * F.size("lines"))).first()[0] or 0) <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    return docs.select("row_id", "text").join(lists, "row_id", how).select("row_id", "text", "lines")


def sets_of(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(row_id, line_no, words) of the wanted (row_id, line_no)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = [sorted(own) for own in batch.column(2).to_pylist()]
            texts = [b"\n".join(map((t or b"").split(b"\n").__getitem__, own)) for t, own in zip(batch.column(1).cast(pa.binary()).to_pylist(), asked)]  # no more than the wanted lines are hashed
            few = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.binary())], ["at", "text"])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for s in map(word_sets, line_words(few, min_words)):
                at = s["row_id"].tolist()
                numbers = [asked[i][n] for i, n in zip(at, s["line_no"].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.append(s["first"], len(s["word"])), pa.int32()), pa.array(s["word"].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(numbers, pa.int32()), lists], ["row_id", "line_no", "words"])

    return listed(docs, wanted, "inner").mapInArrow(tidy(run), "row_id long, line_no int, words array<long>")


def matched(docs: DataFrame, pairs: DataFrame, similarity: tuple[int, int], min_words: int) -> DataFrame:
    """(row_id, line_no) of the later lines of pairs whose Jaccard similarity reaches the threshold.

    A line goes by its first match. So each is verified against its closest partner first, by bitmap, and only those that
    this does not settle meet their other partners; few sets are shuffled more than once.
    """
    a, b = similarity
    wanted = pairs.select(F.col("row_a").alias("row_id"), F.col("line_a").alias("line_no")).unionByName(pairs.select(F.col("row_b").alias("row_id"), F.col("line_b").alias("line_no"))).distinct()
    sets = materialise(sets_of(docs, wanted, min_words), "lines-sets")
    side = lambda x: sets.select(F.col("row_id").alias(f"row_{x}"), F.col("line_no").alias(f"line_{x}"), F.col("words").alias(f"set_{x}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    same = b * shared >= a * (F.size("set_a") + F.size("set_b") - shared)
    verified = lambda some, label: materialise(some.join(side("a"), ["row_a", "line_a"]).join(side("b"), ["row_b", "line_b"]).where(same).select(F.col("row_b").alias("row_id"), F.col("line_b").alias("line_no")).distinct(), label)
    # The order's low bits are a hash of the partner, so both columns come from one pair; were two hashes equal, the line would be left to the second step.
    order = F.shiftleft(F.col("apart").cast("long"), 54).bitwiseOR(F.shiftrightunsigned(F.xxhash64("row_a", "line_a"), 10))
    closest = pairs.groupBy("row_b", "line_b").agg(F.min_by("row_a", order).alias("row_a"), F.min_by("line_a", order).alias("line_a"))
    first = verified(closest, "lines-first")
    left = pairs.join(first.withColumnsRenamed({"row_id": "row_b", "line_no": "line_b"}), ["row_b", "line_b"], "left_anti").select("row_a", "line_a", "row_b", "line_b")
    return first.unionByName(verified(left, "lines-other"))


def later_copies(lines: DataFrame) -> DataFrame:
    """(row_id, line_no) of all but the first line of each set. Sets of very many lines, of which there are few, are broadcast; the others are joined by a shuffle."""
    alike, lines = lines.where("again").select("row_id", "line_no"), lines.where("not again")  # so a set has one line of a text, and its first line that of the first text
    sets = materialise(lines.groupBy("h1", "h2").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "lines-firsts")
    many = max(1_000, lines.count() // (BROADCAST_ROWS // 2))  # at most BROADCAST_ROWS / 2 sets have more lines
    hot = F.broadcast(sets.where(F.col("n") > many).select("h1", "h2", F.col("first").alias("hot")))
    split = lines.join(hot, ["h1", "h2"], "left")
    few = split.where("hot is null").join(sets.where(F.col("n") <= many), ["h1", "h2"]).select("row_id", "line_no", "first")
    both = few.unionByName(split.where("hot is not null").select("row_id", "line_no", F.col("hot").alias("first")))
    return both.where("row_id <> first").select("row_id", "line_no").unionByName(alike)


def removed_lines(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, min_words: int = MIN_WORDS, bits: int = BUCKET_BITS) -> DataFrame:
    """(row_id, line_no) of every removed line of ``docs(row_id, text)``."""
    share = docs.sparkSession.sparkContext.broadcast
    scan = materialise(scan_lines(docs, similarity, min_words, bits), "lines-scan")
    lines = scan.where("part is null").select("row_id", "line_no", "again", "h1", "h2")
    counts = bucket_counts(scan, bits)
    shelves, rarity = max(SHELVES, int(counts.sum()) // SHELF_WORDS), share(np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.uint32))
    copies = materialise(later_copies(lines), "lines-copies")
    words = lambda rows, *more: prefixes(rows, rarity, similarity, min_words, bits, shelves, *more)
    sampled = words(docs.where(F.pmod(F.xxhash64("row_id"), F.lit(SAMPLE)) == 0).select("row_id", "text")).groupBy("shelf").agg(F.sum(F.octet_length("entries")).alias("bytes"))
    hot = materialise(sampled.select("shelf", F.ceil(F.col("bytes") * SAMPLE / HOT_BYTES).alias("parts")).where("parts > 1"), "lines-hot")

    def candidates(entries: DataFrame, near: int | None, label: str) -> DataFrame:
        met = dealt(entries, hot).mapInArrow(tidy(meet(similarity, near)), PAIRS)
        return materialise(met.groupBy("row_a", "line_a", "row_b", "line_b").agg(F.max("more").alias("more"), F.min("apart").alias("apart")), label)

    pairs = candidates(words(docs.select("row_id", "text")), NEAR, "lines-pairs")
    near = matched(docs, pairs, similarity, min_words)
    more = pairs.where("more").select(F.col("row_b").alias("row_id"), F.col("line_b").alias("line_no")).distinct()
    open_ = materialise(more.join(near, ["row_id", "line_no"], "left_anti").join(copies, ["row_id", "line_no"], "left_anti"), "lines-open")
    if open_.limit(1).count():  # lines that had more partners than the first round looks at
        slots = words(listed(docs, open_, "inner"), None, True).select("shelf").distinct().toPandas()["shelf"].to_numpy()  # at most SLOTS numbers
        wanted = np.zeros(SLOTS, bool)
        wanted[slots] = True
        wanted = share(np.packbits(wanted, bitorder="little"))
        near = near.unionByName(matched(docs, candidates(words(listed(docs, open_, "left"), wanted), None, "lines-rest"), similarity, min_words))
        wanted.unpersist()
    rarity.unpersist()
    return near.unionByName(copies).distinct()


def dedup_lines(docs: DataFrame, drop_emptied: bool = False, **options) -> DataFrame:
    """``docs`` without the removed lines; other texts are unchanged, and ``n_chars`` follows the text where it exists.

    ``drop_emptied`` also leaves out documents that lost lines and have no word left.
    """
    rows = keyed(docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("keep_")))
    gone = materialise(removed_lines(rows.select("row_id", "text"), **options).groupBy("row_id").agg(F.sort_array(F.collect_list("line_no")).alias("gone")), "lines-removed")
    if (gone.agg(F.sum(40 + 4 * F.size("gone"))).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)  # else texts are shuffled
    cut = F.col("gone").isNotNull()
    runs = "transform(sequence(0, size(gone)), i -> slice(x, if(i = 0, 1, gone[i - 1] + 2), if(i = size(gone), size(x), gone[i]) - if(i = 0, 0, gone[i - 1] + 1)))"  # of lines that stay, between removed ones
    kept = F.expr(f"transform(array(split(text, '\\n')), x -> array_join(flatten({runs}), '\\n'))[0]")
    out = rows.join(gone, "row_id", "left").withColumn("text", F.when(cut, kept).otherwise(F.col("text"))).select("text", "keep_", cut.alias("cut"))
    if drop_emptied:
        out = out.where(~(F.col("cut") & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")))
    return unnested(out, docs.columns, text=F.col("text"), **({"n_chars": F.when(F.col("cut"), F.length("text").cast("long")).otherwise(F.col("keep_.n_chars"))} if "n_chars" in docs.columns else {}))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    rows = keyed(docs)
    gone = removed_lines(rows.select("row_id", "text")).groupBy("row_id").agg(F.sort_array(F.collect_list("line_no")).alias("gone"))
    out = rows.select("row_id", "doc_id", n_lines.alias("n_lines")).join(gone, "row_id", "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed"))
