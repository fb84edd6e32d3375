"""Source divergence audit: how far the vocabularies of a language's sources lie apart, in exact integers.

Terms are runs of letters and of characters beyond ASCII; only A to Z are lower-cased. A first pass counts, for each
language, the documents that hold a term, and keeps the terms in at least ``LEAST_DOCS`` of them. A second pass runs an
automaton over whole texts whose keys are the kept terms between two delimiters, so that a key matches whole terms only and
neighbours may share a delimiter; it counts occurrences by language, source and term.

The automaton's terms are broadcast in blocks of about ``BLOCK_BYTES``, a pass over the texts of the languages in it for each
block; a vocabulary of any size is so counted in bounded memory. Both passes add up within tasks before anything is shuffled.

With p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), a term that a group lacks has the group's constant share a. The
distance of two groups is the sum of abs(p - q) over all kept terms; it is put together from sparse postings:
V * abs(a - b), what each group's own terms change against the other's constant (by the distinct shares of a group), and what terms of both change
(by the postings of a term). The cost of a term is the square of the number of sources that have it, never of V.

Defined cases: null text, language and source count as empty strings; a text without terms counts for no term, but its group is there; a
language without kept terms has V = 0 and all its distances are 0; copies and repeated rows each count as a document; ties in a
rank go by the item's UTF-8 bytes; a source alone in its language has no pair; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, documents, materialise, text_or_empty

#: Documents of its language that a term has to be in; ranks kept of part `term`.
LEAST_DOCS, TERM_RANKS = 30, 50
#: Bytes of terms in one automaton (a node takes up to about 80 bytes); bytes of counted terms that a task holds before it sends them on.
BLOCK_BYTES, HELD_BYTES = 4_000_000, 16_000_000
#: Added to every count, and the whole that shares are parts of.
ADDED, WHOLE = 5, 1_000_000_000

_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Of UTF-8 bytes: letters in lower case, bytes of characters beyond ASCII as they are, all else a space.
_FOLD = bytes(b if b >= 128 or b in _LETTERS.lower() else b + 32 if b in _LETTERS else 32 for b in range(256))
_automata: dict[str, dict[str, object]] = {}  # of the last block, in each Python worker


def folded(raw: bytes) -> bytes:
    """The text with its delimiters as spaces and A to Z in lower case; ``split()`` gives its terms."""
    return raw.translate(_FOLD)


def _tallied(batches: Iterator[pa.RecordBatch], terms: Callable[[str, bytes], Iterable[bytes]], keys: int) -> Iterator[pa.RecordBatch]:
    """Counts of terms by the first ``keys`` columns, the last column being the text; sent on whenever they come to ``HELD_BYTES``."""
    tally: dict[tuple, Counter] = defaultdict(Counter)
    held = 0

    def sent() -> pa.RecordBatch:
        rows = [(*key, term, n) for key, own in tally.items() for term, n in own.items()]
        *names, found, n = list(zip(*rows)) or [()] * (keys + 2)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in names), pa.array(found, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], [f"k{i}" for i in range(keys)] + ["term", "n"])

    for batch in batches:
        names = [batch.column(i).to_pylist() for i in range(keys)]
        for i, text in enumerate(batch.column(keys).cast(pa.binary())):
            key = tuple(x[i] for x in names)
            own, before = tally[key], len(tally[key])
            own.update(terms(key[0], raw := text.as_py() or b""))
            if len(own) > before:
                held += len(raw) + 100 * (len(own) - before)
            if held > HELD_BYTES:
                yield sent()
                tally.clear()
                held = 0
    if tally:
        yield sent()


def term_documents(docs: DataFrame) -> DataFrame:
    """(lang, term, n): in how many documents of ``docs(lang, source, text)`` each term is. First pass, exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _tallied(batches, lambda _, raw: set(folded(raw).split()), 1)

    found = docs.select("lang", "text").mapInArrow(count, "k0 string, term string, n long")
    return found.groupBy(F.col("k0").alias("lang"), "term").agg(F.sum("n").alias("n"))


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, term, bytes, block), written: languages one after the other, a language's terms spread over its blocks by hash."""
    size = F.octet_length("term") + 2
    kept = materialise(term_documents(docs).where(F.col("n") >= least).select("lang", "term", size.cast("long").alias("bytes")), "divergence-kept")
    langs = kept.groupBy("lang").agg(F.sum("bytes").alias("all"))
    before = F.sum("all").over(Window.orderBy("lang")) - F.col("all")  # a row a language
    at = F.col("before") + F.pmod(F.xxhash64("term"), F.col("all"))
    return kept.join(broadcast_if_small(langs.withColumn("before", before)), "lang").select("lang", "term", "bytes", F.floor(at / block_bytes).cast("int").alias("block"))


def automata(name: str, terms: list[tuple[str, str]]) -> dict[str, object]:
    """An automaton for each language, its keys between two delimiters; kept until another block comes."""
    if name not in _automata:
        import ahocorasick

        made: dict[str, object] = defaultdict(ahocorasick.Automaton)
        for lang, term in terms:
            made[lang].add_word(f" {term} ", term.encode())
        for a in made.values():
            a.make_automaton()
        _automata.clear()
        _automata[name] = dict(made)
    return _automata[name]


def recounted(docs: DataFrame, block: DataFrame) -> DataFrame:
    """(lang, source, term, n): occurrences of one block's kept terms (lang, term) in ``docs``. Second pass, exact; ``block`` is bounded."""
    shared = docs.sparkSession.sparkContext.broadcast(sorted((r["lang"], r["term"]) for r in block.select("lang", "term").collect()))
    name = uuid.uuid4().hex

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automata(name, shared.value)

        def terms(lang: str, raw: bytes) -> Iterable[bytes]:
            a = own.get(lang)
            return map(itemgetter(1), a.iter(f" {folded(raw).decode()} ")) if a is not None else ()

        return _tallied(batches, terms, 2)

    langs = sorted({lang for lang, _ in shared.value})
    mine = docs.where(F.col("lang").isin(langs)) if len(langs) <= 1000 else docs
    found = mine.select("lang", "source", "text").mapInArrow(count, "k0 string, k1 string, term string, n long")
    return found.groupBy(F.col("k0").alias("lang"), F.col("k1").alias("source"), "term").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n), written: a table for each block of the vocabulary."""
    blocks = [r["block"] for r in kept.select("block").distinct().orderBy("block").collect()]
    tables = [materialise(recounted(docs, kept.where(F.col("block") == b)), "divergence-counts") for b in blocks]
    out = tables[0] if tables else docs.sparkSession.createDataFrame([], "lang string, source string, term string, n long")
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)) in decimals, which hold every step exactly."""
    return F.call_function("div", (count + ADDED).cast("decimal(20,0)") * F.lit(WHOLE).cast("decimal(10,0)"), (total + ADDED * terms).cast("decimal(20,0)")) + 1


def shares(groups: DataFrame, kept: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, v, a) with the number of kept terms and the share of a missing one; postings (lang, source, term, p, q, a), q the language's share."""
    v = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = groups.join(broadcast_if_small(v), "lang", "left").join(broadcast_if_small(totals), ["lang", "source"], "left")
    g = g.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("total", F.lit(0)).alias("total"))
    g = materialise(g.withColumn("a", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v")))), "divergence-groups")
    langs = g.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("posts"))  # a term's list has at most a place a source
    each = whole.select("lang", "term", "lang_n", F.explode("posts").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    rows = each.join(broadcast_if_small(g.join(langs, "lang")), ["lang", "source"])
    return g, materialise(rows.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"), "a"), "divergence-postings")


def distances(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, in both directions."""
    near = groups.select("lang", F.col("source").alias("other"), F.col("a").alias("b"))
    low, high, gap = F.least("source", "other").alias("low"), F.greatest("source", "other").alias("high"), F.abs(F.col("a") - F.col("b"))
    base = groups.join(broadcast_if_small(near), "lang").where("source < other").select("lang", low, high, (F.col("v") * F.coalesce(gap, F.lit(0))).alias("value"))
    alike = postings.groupBy("lang", "source", "p", "a").agg(F.count(F.lit(1)).alias("m"))  # distinct shares of a group
    alone = alike.join(broadcast_if_small(near), "lang").where("source <> other").select("lang", low, high, (F.col("m") * (F.abs(F.col("p") - F.col("b")) - gap)).alias("value"))
    posts = postings.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "a"))).alias("posts"))
    first = posts.select("lang", "posts", F.posexplode("posts").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.expr("slice(posts, i + 2, size(posts))")).alias("y"))
    change = F.abs(F.col("x.p") - F.col("y.p")) - F.abs(F.col("x.p") - F.col("y.a")) - F.abs(F.col("y.p") - F.col("x.a")) + F.abs(F.col("x.a") - F.col("y.a"))
    shared = both.select("lang", F.col("x.source").alias("low"), F.col("y.source").alias("high"), change.alias("value"))
    pairs = base.unionByName(alone).unionByName(shared).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("low").alias("source"), F.col("high").alias("item")), F.struct(F.col("high").alias("source"), F.col("low").alias("item")))).alias("w")
    return pairs.select("lang", "value", ways).select("lang", "w.source", "w.item", "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = TERM_RANKS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs(text, lang, source)``."""
    rows = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty().alias("text"))
    kept = materialise(kept_terms(rows, least, block_bytes), "divergence-terms")
    counts = occurrences(rows, kept)
    groups, postings = shares(rows.select("lang", "source").distinct(), kept, counts)
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = terms.withColumn("rank", rank).where(F.col("rank") <= ranks)
    pairs = distances(groups, postings).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    return pairs.unionByName(top)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


ORACLE_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) o JOIN df ON df.lang = o.lang AND df.term = o.term GROUP BY o.lang, o.source, o.term),
v AS (SELECT lang, count(*) AS v FROM df GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
lt AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, df.term, coalesce(c.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (lc.n + 5)) // (lt.total + 5 * v.v)::HUGEINT AS q
      FROM g JOIN df ON df.lang = g.lang JOIN v ON v.lang = g.lang JOIN lt ON lt.lang = g.lang JOIN lc ON lc.lang = g.lang AND lc.term = df.term
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = df.term),
gap AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(gap.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gap ON gap.lang = a.lang AND gap.source = a.source AND gap.item = b.source),
tops AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM tops))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""
