r"""Secret scans: character Markov models of random strings and ordinary identifiers, compared by log-likelihood ratio.

Two first-order character chains are trained from labelled samples: random strings (values that the base rules
find, and digests written in several alphabets) and ordinary identifiers (word-like tokens that no base rule
finds). In every run of key characters the segment with the highest summed log-likelihood ratio is sought; one whose
sum and whose mean per transition exceed the thresholds becomes, with the letters and digits that adjoin it, a span
of kind ``markov``, unless a base span already covers part of it. So a key is found behind a path or a name, and
the shorter it is, the clearer it has to be. Only DataFrame and SQL functions run.

Spans are code points, end exclusive. ``split`` and ``regexp_extract_all`` walk a text with the same matcher, so the
gaps and the matches of one pattern add up to the positions. All folds keep a state of bounded size.

Defined cases: null text is empty and has no spans; an empty table gives no rows (and a model from the digests
alone); repeated rows are scanned one by one; long texts are scanned whole; of equally good segments the first is taken;
other columns pass through, but ``with_spans`` replaces columns named as its own two.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.arrays import running, running_sums

from .common import documents, nested, sample_shares, sampled, unnested

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group of the value, least length of the value. A run of hex digits, or AKIA with what follows it,
#: is taken whole, so asking for the length inside the pattern finds the same spans as filtering afterwards.
BASE = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]{16,}", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24))
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the chains score, and their least length; runs below ``LONG`` characters need a digit beside a letter or an inner capital.
CANDIDATE, LEAST, LONG = "[A-Za-z0-9+/_=-]{8,}", 8, 20
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Documents read for labelled samples, digests added to the random ones; mean and sum of log-likelihood ratios that report a segment.
SAMPLE_DOCS, DIGESTS, THRESHOLD, TOTAL = 20_000, 4_000, 0.75, 20.0
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(text: str, pattern: str, group: int, least: int, kind: str) -> str:
    """SQL expression: the spans of ``pattern``, leftmost and non-overlapping, whose value is long enough."""
    p = quoted(pattern)
    starts = running_sums("transform(z.m, (x, i) -> length(x) + length(z.g[i]))")
    return f"""filter(if({text} rlike {p},
      transform(array(named_struct('g', split({text}, {p}, -1), 'm', regexp_extract_all({text}, {p}, 0), 'v', regexp_extract_all({text}, {p}, {group}))), z ->
        transform({starts}, (at, i) -> named_struct('start', cast(at as int) + length(z.g[i]), 'rank', {KINDS.index(kind)}, 'end', cast(at as int) + length(z.g[i]) + length(z.m[i]), 'kind', '{kind}', 'value', z.v[i])))[0],
      cast(array() as {SPAN})), x -> length(x.value) >= {least})"""


def base_spans(text: str) -> str:
    return "concat(" + ", ".join(spans_of(text, p, g, n, k) for k, p, g, n in BASE) + ")"


def train_markov(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each transition: a list indexed by ``from * len(ALPHABET) + to``.

    At most about ``sample_docs`` documents, chosen by a hash of the text, give labelled samples.
    """
    spark, size = docs.sparkSession, len(ALPHABET)
    t = "coalesce(text, '')"
    sample = docs.select("text").where(sampled(F.expr(t), *map(F.lit, sample_shares(sample_docs, docs.count()))))
    labelled = sample.select(F.expr(f"transform({base_spans(t)}, x -> x.value)").alias("secret"), F.expr(f"regexp_extract_all(regexp_replace({t}, '[0-9a-f]{{16,}}|AKIA[A-Z0-9]+', ' '), '[A-Za-z_][A-Za-z0-9_-]{{5,}}', 0)").alias("plain"))
    digest = spark.range(DIGESTS).select(F.explode(F.expr("array(sha2(cast(id as string), 256), upper(sha2(concat('u', id), 256)), base64(unhex(sha2(concat('b', id), 256))), translate(base64(unhex(sha2(concat('c', id), 256))), '+/=', ''))")).alias("s")).select(F.lit(1).alias("random"), "s")
    rows = labelled.select(F.lit(1).alias("random"), F.explode("secret").alias("s")).unionByName(labelled.select(F.lit(0).alias("random"), F.explode("plain").alias("s"))).unionByName(digest)
    counts = rows.where("length(s) > 1").select("random", F.explode(F.expr("transform(sequence(1, length(s) - 1), i -> substr(s, i, 2))")).alias("pair")).groupBy("random", "pair").count().collect()  # at most 2 * 68 * 68 rows
    table = [[[0.5] * size for _ in range(size)] for _ in range(2)]
    for r in counts:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1:])
        if a >= 0 <= b:
            table[r["random"]][a][b] += r["count"]
    log = [[[math.log(x / sum(row)) for x in row] for row in one] for one in table]
    return [log[1][a][b] - log[0][a][b] for a in range(size) for b in range(size)]


def markov_spans(text: str, model: list[float], threshold: float, total: float = TOTAL) -> str:
    """SQL expression: the best segment of each candidate run, where its log-likelihood ratios exceed the thresholds."""
    ratios, size = "cast(split('" + ",".join(f"{x:.5f}" for x in model) + "', ',') as array<double>)", len(ALPHABET)
    runs = f"filter({spans_of(text, CANDIDATE, 0, LEAST, 'markov')}, x -> length(x.value) >= {LONG} or x.value rlike '[0-9][A-Za-z]|[A-Za-z][0-9]|[a-z][A-Z]')"
    # The best segment so far and the best one that ends here; positions are characters of the run.
    best = f"""transform(array(transform(split(x.value, ''), c -> locate(c, '{ALPHABET}') - 1)), k ->
        aggregate(sequence(1, size(k) - 1), named_struct('sum', 0D, 'a', 0, 'z', 1, 'here', 0D, 'from', 0), (s, i) ->
          transform(array(named_struct('r', {ratios}[k[i - 1] * {size} + k[i]], 'on', s.here > 0D)), y ->
            transform(array(named_struct('here', if(y.on, s.here, 0D) + y.r, 'from', if(y.on, s.from, i - 1))), h ->
              if(h.here > s.sum, named_struct('sum', h.here, 'a', h.from, 'z', i + 1, 'here', h.here, 'from', h.from), named_struct('sum', s.sum, 'a', s.a, 'z', s.z, 'here', h.here, 'from', h.from)))[0])[0]))[0]"""
    scored = f"transform({runs}, x -> named_struct('x', x, 'b', {best}))"
    clear = f"filter({scored}, q -> q.b.sum > {total} and q.b.sum / (q.b.z - q.b.a - 1) > {threshold})"
    left = "length(regexp_extract(reverse(substr(q.x.value, 1, q.b.a)), '^[A-Za-z0-9]*', 0))"
    right = "length(regexp_extract(substr(q.x.value, q.b.z + 1), '^[A-Za-z0-9]*=*', 0))"
    return f"""transform({clear}, q -> transform(array(named_struct('a', q.b.a - {left}, 'z', q.b.z + {right})), e ->
        named_struct('start', q.x.start + e.a, 'rank', q.x.rank, 'end', q.x.start + e.z, 'kind', q.x.kind, 'value', substr(q.x.value, e.a + 1, e.z - e.a)))[0])"""


def with_spans(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``secret_base`` and ``secret_spans`` (base and Markov), each sorted by start, then kind."""
    t, far = "coalesce(text, '')", 2**31 - 1
    # All spans by start: a Markov span is free if no earlier base span reaches into it and the next one starts behind it.
    reach = running("transform(s, x -> if(x.rank < 3, x.end, -1))", "-1", "greatest({0}, {1})")
    following = running(f"reverse(transform(s, x -> if(x.rank < 3, x.start, {far})))", str(far), "least({0}, {1})")
    free = f"""transform(array({markov_spans(t, model, threshold)}), m -> if(size(m) = 0 or size(secret_base) = 0, m, transform(array(sort_array(concat(secret_base, m))), s ->
        transform(array(named_struct('before', {reach}, 'after', reverse({following}))), r -> filter(s, (x, i) -> x.rank = 3 and x.start >= r.before[i] and x.end <= r.after[i]))[0])[0]))[0]"""
    return docs.withColumn("secret_base", F.expr(f"sort_array({base_spans(t)})")).withColumn("secret_spans", F.expr(f"sort_array(concat(secret_base, {free}))"))


def listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')")


def redact(docs: DataFrame, model: list[float], mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; ``n_chars`` follows the text where it exists. Null text stays null."""
    one = f"""aggregate(b, named_struct('pos', at[k], 'out', ''), (a, x) -> named_struct('pos', greatest(a.pos, x.end),
        'out', concat(a.out, if(x.start >= a.pos, concat(substr(t, a.pos - at[k] + 1, x.start - a.pos), '{mark}'), ''))), a -> a.out)"""
    # Spans in blocks of about the root of their number, each with the text from the end of those before it to its own.
    cut = F.expr(f"""transform(array(greatest(64, cast(ceil(sqrt(size(secret_spans))) as int))), w ->
        transform(array(transform(sequence(0, greatest(size(secret_spans) - 1, 0) div w), k -> slice(secret_spans, k * w + 1, w))), blocks ->
          transform(array(aggregate(blocks, named_struct('pos', 0, 'out', array(0)), (a, b) -> transform(array(greatest(a.pos, coalesce(array_max(transform(b, x -> x.end)), 0))), e ->
              named_struct('pos', e, 'out', array_append(a.out, e)))[0], a -> a.out)), at ->
            concat(array_join(transform(blocks, (b, k) -> transform(array(substr(text, at[k] + 1, at[k + 1] - at[k])), t -> {one})[0]), ''), substr(text, at[size(blocks)] + 1)))[0])[0])[0]""")
    found = with_spans(nested(docs, "text"), model)
    hit = F.size("secret_spans") > 0
    new = found.select("keep_", F.when(hit, cut).otherwise(F.col("text")).alias("text"), hit.alias("hit"))
    return unnested(new, docs.columns, text=F.col("text"), **({"n_chars": F.when(F.col("hit"), F.length("text").cast("long")).otherwise(F.col("keep_.n_chars"))} if "n_chars" in docs.columns else {}))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = with_spans(docs, train_markov(docs))
    count = lambda kind: F.expr(f"cast(size(filter(secret_base, x -> x.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(listed("secret_base"), 256).alias("base_sha256"), listed("secret_spans").alias("spans"))
