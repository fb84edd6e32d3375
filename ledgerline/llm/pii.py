r"""PII: bootstrapped contextual extraction.

Entities that the base rules find (email, ip, card, phone) are seeds. The one and two words before a seed are
lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern's confidence is the share of its
occurrences in the corpus that precede a believed instance, an instance is believed as far as its patterns are, and seeds
are believed fully. Patterns of high confidence and enough different seeds then discover identifiers that no base
rule finds, as spans of kind ``context``: words with a digit behind any of them; groups of words with digits, written
with single spaces, behind those that have seeds of digits; dotted words behind those that have emails.

Spans are code points, end exclusive. Every pass reads whole texts; what leaves them are spans, contexts and counts.

Defined cases: null text is empty and has no spans; rows are scanned one by one, rows that share a doc_id too; contexts at
a text's start are marked; words of over a hundred characters stand in patterns by their digest; of equal spans one is kept; base
spans of one start follow each other by kind; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, keyed, materialise

KINDS = ("email", "ip", "card", "phone", "context")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match takes all digits that follow, so no later one starts inside a run of digits.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A word with a digit or an at sign, and the words with a digit that follow it behind single spaces.
_LIKE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+(?:\x20[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+)*+")
#: A word of dotted parts without any.
_DOTTED = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@.]++(?:\.[^\x20\x09-\x0D0-9@.]++)++[^\x20\x09-\x0D0-9@]*+(?![^\x20\x09-\x0D])")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WHITE = "\x20\t\n\v\f\r"
#: Characters of a word that stands in patterns as it is, and how far back two such words are looked for.
LONG, REACH = 100, 202
EDGES, LEAST = ".,;:!?()[]{}<>\"'", 6
#: Shapes of instances: mail-like, groups of digits, and words with a digit, which any pattern may discover.
MAIL, DIGITS, ANY = 0, 1, 2
#: Different seeds that a pattern needs, its least confidence, rounds, and how many patterns, about, are counted in one pass over the texts.
SUPPORT, CONFIDENCE, ROUNDS, PATTERNS = 5, 0.6, 3, 100_000


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in even)) % 10 == 0


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base rules' spans, sorted."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Contexts:
    """Patterns of one and of two words before places of a text; ``^`` stands before the text.

    Mostly the nearest characters hold both words. Where they do not, the text's words are listed once, and the digest of a
    long word grows from one place to the next, so places in ascending order cost time in proportion to them and the text.
    """

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.digests = text, None, None, {}

    def before(self, start: int) -> tuple[str, str]:
        left = max(0, start - REACH)
        near = self.text[left:start]
        words = _WORD.findall(near)
        if left and near[0] not in WHITE:
            words = words[1:]  # perhaps cut through
        words = self.far(start) if left and len(words) < 2 else list(map(shortened, words[-2:]))
        one, two = ["^", "^", *words][-1:-3:-1]
        return one, f"{two} {one}"

    def far(self, start: int) -> list[str]:
        if self.starts is None:
            places = [m.span() for m in _WORD.finditer(self.text)]
            self.starts, self.ends = (array("q", x) for x in (zip(*places) if places else ((), ())))
        k = bisect.bisect_left(self.starts, start)
        return [self.word(self.starts[j], min(self.ends[j], start)) for j in range(max(0, k - 2), k)]

    def word(self, start: int, end: int) -> str:
        if end - start <= LONG:
            return shortened(self.text[start:end])
        read, digest = self.digests.get(start, (end + 1, None))
        if read > end:
            read, digest = start, hashlib.sha1()
        digest.update(folded(self.text[read:end]))
        self.digests[start] = end, digest
        return "#" + digest.hexdigest()


def contexts(text: str, start: int) -> tuple[str, str]:
    """Patterns of one and of two words before one place."""
    return Contexts(text).before(start)


def folded(word: str) -> bytes:
    """Without case, each character by itself, so that parts of a word may be folded one after another."""
    return word.casefold().encode("utf-8", "replace")


def shortened(word: str) -> str:
    """How a word stands in patterns: in lower case, or by its digest."""
    return word.lower() if len(word) <= LONG else "#" + hashlib.sha1(folded(word)).hexdigest()


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(start of the first word, start, end, shape) of identifier-like words and groups that meet no base span."""
    for m in _LIKE.finditer(text):
        whole = m[0].strip(EDGES)
        first = m[0].split(" ", 1)[0].strip(EDGES)
        shape = ANY if len(first) >= LEAST and any(c.isdigit() for c in first) else DIGITS
        if shape == DIGITS and (" " not in m[0] or sum(c.isdigit() for c in whole) < LEAST):
            continue
        yield m.start(), m.start() + m[0].find(whole), m.start() + m[0].find(whole) + len(whole), shape
    for m in _DOTTED.finditer(text):
        whole = m[0].strip(EDGES)
        if len(whole) >= LEAST and "." in whole:
            yield m.start(), m.start() + m[0].find(whole), m.start() + m[0].find(whole) + len(whole), MAIL


SEEN = "row_id long, base array<struct<start:int,rank:int,end:int>>, seen array<struct<start:int,end:int,seed:boolean,shape:int,instance:string,one:string,two:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans of every row of ``docs(row_id, text)``, and with their contexts all seeds and identifier-like words."""
    types = [pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("shape", pa.int32()), ("instance", pa.string()), ("one", pa.string()), ("two", pa.string())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, seens = [], []
            for text in batch.column(1).to_pylist():
                base, seen, patterns = base_entities(text or ""), [], Contexts(text or "")
                reach = [0, *itertools.accumulate((z for _, _, z in base), max)]
                for a, k, z in base:
                    one, two = patterns.before(a)
                    seen.append({"start": a, "end": z, "seed": True, "shape": DIGITS if k else MAIL, "instance": text[a:z], "one": one, "two": two})
                for at, a, z, shape in candidates(text or "", base):
                    if a >= reach[bisect.bisect_left(base, (z,))]:  # the last end of base spans that start before z
                        one, two = patterns.before(at)
                        seen.append({"start": a, "end": z, "seed": False, "shape": shape, "instance": text[a:z], "one": one, "two": two})
                bases.append([{"start": a, "rank": k, "end": z} for a, k, z in base])
                seens.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, types[0]), pa.array(seens, types[1])], ["row_id", "base", "seen"])

    return docs.select("row_id", "text").mapInArrow(run, SEEN)


def occurrences(docs: DataFrame, patterns: frozenset[str]) -> DataFrame:
    """(pattern, n): how often the patterns' words stand in the corpus before another word."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = list(map(shortened, _WORD.findall(text or "")))
                ones, twos = Counter(words[:-1]), Counter(zip(["^", "^", *words][:-1], ["^", *words][:-1]))
                total.update({w: n for w, n in ones.items() if w in shared.value})
                total.update({p: n for (a, b), n in twos.items() if (p := f"{a} {b}") in shared.value})
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pattern", "n"])

    return docs.select("text").mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def trusted_patterns(docs: DataFrame, found: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, block: int = PATTERNS) -> DataFrame:
    """(pattern, confidence, mail, digits) of the patterns that may discover identifiers; the last two say which seeds they have."""
    edges = found.select(F.explode("seen").alias("x")).select("x.seed", "x.shape", "x.instance", F.explode(F.array("x.one", "x.two")).alias("pattern")).where("trim(pattern) <> ''")
    edges = materialise(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.min(F.when(F.col("seed"), F.col("shape"))).alias("shape"), F.count(F.lit(1)).alias("n")), "pii-edges")
    backed = materialise(edges.where("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"), F.max(F.col("shape") == MAIL).alias("mail"), F.max(F.col("shape") == DIGITS).alias("digits")).where(F.col("seeds") >= support), "pii-backed")
    blocks, totals = max(1, -(-backed.count() // block)), []
    for k in range(blocks):  # a bounded number of patterns at a time
        own = [r["pattern"] for r in backed.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).select("pattern").collect()]  # about `block`
        totals.append(materialise(occurrences(docs, frozenset(own)), "pii-totals"))
    totals = broadcast_if_small(reduce(DataFrame.unionByName, totals))
    graph = materialise(edges.join(totals, "pattern").join(broadcast_if_small(backed), "pattern"), "pii-graph")
    belief = graph.select("instance", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("belief")).groupBy("instance").agg(F.max("belief").alias("belief"))
    for _ in range(rounds):
        trust = materialise(graph.join(belief, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("belief")) / (F.greatest(F.first("total"), F.sum("n")) + 1)).alias("confidence")), "pii-trust")
        held = graph.join(broadcast_if_small(trust), "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))).alias("doubt"))
        belief = materialise(held.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("belief")), "pii-belief")
    return trust.where(F.col("confidence") >= confidence).join(broadcast_if_small(backed), "pattern").select("pattern", "confidence", "mail", "digits")


def with_spans(docs: DataFrame, **options) -> DataFrame:
    """``docs(row_id, text, ...)`` less the text, with ``base`` and ``spans`` (arrays of start, rank, end; sorted)."""
    found = materialise(scan(docs), "pii-scan")
    trusted = trusted_patterns(docs, found, **options)
    unknown = found.select("row_id", F.explode(F.filter("seen", lambda x: ~x["seed"])).alias("x")).select("row_id", "x.start", "x.end", "x.shape", F.explode(F.array("x.one", "x.two")).alias("pattern"))
    fits = (F.col("shape") == ANY) | (F.col("mail") & (F.col("shape") == MAIL)) | (F.col("digits") & (F.col("shape") == DIGITS))
    new = unknown.join(broadcast_if_small(materialise(trusted, "pii-trusted")), "pattern").where(fits).select("row_id", F.struct("start", F.lit(4).alias("rank"), "end").alias("span")).distinct()
    more = new.groupBy("row_id").agg(F.collect_list("span").alias("more"))
    out = docs.drop("text").join(found.select("row_id", "base"), "row_id").join(more, "row_id", "left")
    return out.withColumn("spans", F.sort_array(F.concat("base", F.coalesce("more", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))))).drop("more")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", kinds[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["rank"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return with_spans(rows).select("doc_id", *map(count, range(4)), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
