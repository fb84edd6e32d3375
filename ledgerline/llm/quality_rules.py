"""Quality rules: robust multivariate outliers per language and source.

Each document becomes a vector of transformed text statistics. For every (lang, source) group a
minimum-covariance-determinant estimate is fitted: from three starts (median and MAD; mean and covariance of all rows;
the same of rows drawn in to two MADs from the median) concentration steps keep the ``support`` share of rows with the
smallest distances and take their mean and covariance, until the determinant falls no more; the start that ends with the
least determinant is taken. A document whose Mahalanobis distance from its group's estimate exceeds the cutoff is
rejected. Everything is DataFrame and SQL functions; group parameters are mergeable sums and quantile sketches (of a
rank error of one in 10,000), so a group holding most rows is aggregated on the map side and never gathered in one task.

Groups are blended with all documents by size: to a group's sums come those of ``blend`` rows of the pooled mean, so a
group of few rows is judged by the pooled estimate and a large one by its own.

Defined cases: null text counts as empty text (no words, so the base rule rejects it); null lang or source is a
group value of its own; a group without fitting rows has no estimate, and all its
rows fall to the base rule; of starts with equal determinants the first is taken; an empty table returns no rows; repeated
rows are judged one by one, also where they share a doc_id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, keyed, materialise, nested, text_or_empty, unnested

SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("x0", "x1", "x2", "x3", "x4")
P = len(FEATURES)
#: Median of the chi-squared distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515
#: Smallest standard deviation per feature, in the transformed units: constant features must not make rejections.
FLOOR = (0.30, 0.06, 0.04, 0.20, 0.15)
SUPPORT, STEPS, BLEND = 0.75, 20, 100.0
#: A step that lowers no group's log determinant by more than this is the last one; rank accuracy of quantiles.
SETTLED, ACCURACY = 0.01, 10_000
#: Squared distance above which a document is rejected: chi-squared's 0.9999 quantile with five degrees of freedom.
CUTOFF = 25.74


WINDOW_HASH = "xxhash64(h[i], h[i + 1], h[i + 2])"


def repeat_statistics(words: str) -> Column:
    """struct(n_words, n_repeat_words) of an array of words, given as a SQL expression.

    Every 3-word window is a pair of its 64-bit hash and its position. Sorted, equal windows are neighbours, and the
    covered words follow from the sorted positions.
    """
    return F.expr(f"""
    transform(array(transform({words}, w -> xxhash64(w))), h ->
      named_struct('n_words', cast(size(h) as bigint), 'n_repeat_words', if(size(h) < 3, 0L,
        transform(array(sort_array(transform(sequence(0, greatest(size(h) - 3, 0)), i -> named_struct('k', {WINDOW_HASH}, 'i', i)))), s ->
          aggregate(
            sort_array(transform(
              filter(s, (x, i) -> if(i > 0, x.k = s[greatest(i - 1, 0)].k, false) or if(i < size(s) - 1, x.k = s[least(i + 1, size(s) - 1)].k, false)),
              x -> x.i)),
            named_struct('last', -3, 'covered', 0L),
            (a, x) -> named_struct('last', x, 'covered', a.covered + least(3, x - a.last)),
            a -> a.covered))[0])))[0]""")


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the base statistics, n_lines (lines with a word) and n_chars_all (code points)."""
    t = text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    first = docs.select(
        *keep,
        F.length(t).cast("long").alias("n_chars_all"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))[0].alias("lines_"),
        repeat_statistics(f"filter(split(coalesce(`{text}`, ''), r'{SPACE}'), w -> w <> '')").alias("words_"),
    )
    return first.select(*keep, "n_chars_all", "word_chars", "n_symbols", "lines_.n_lines", "lines_.n_dup_lines", "words_.n_words", "words_.n_repeat_words")


def vectors(stats: DataFrame) -> DataFrame:
    """Adds the base verdict, the group key and the transformed statistics."""
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return stats.withColumns({
        "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
        "gkey": F.concat_ws("\x01", F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))),
        "x0": F.log1p("n_words"),
        "x1": F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
        "x2": share("n_symbols", "n_chars_all"),
        "x3": share("n_dup_lines", "n_lines"),
        "x4": share("n_repeat_words", "n_words"),
    })


PARAMETERS = (*(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i in range(P) for j in range(i + 1)))


def moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(f).alias(f"s_{f}") for f in FEATURES), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1))]


def estimates(sums: DataFrame, blend: float = BLEND) -> DataFrame:
    """(gkey, m_i, l_ij, logdet): location and Cholesky factor of the scatter from per-group sums, each blended with ``blend`` rows of the pooled mean; also by ``start``, if there."""
    names = ["n", *(f"s_{f}" for f in FEATURES), *(f"q{i}{j}" for i in range(P) for j in range(i + 1))]
    by = [c for c in ("start",) if c in sums.columns]
    pooled = sums.groupBy(*by).agg(*(F.sum(c).cast("double").alias(f"p_{c}") for c in names))  # a row of 21 numbers for each start
    out = sums.join(F.broadcast(pooled), by) if by else sums.crossJoin(F.broadcast(pooled))
    part = F.lit(blend) / F.greatest(F.col("p_n"), F.lit(1.0))
    out = out.select(*by, "gkey", *((F.col(c) + part * F.coalesce(f"p_{c}", F.lit(0.0))).alias(c) for c in names))
    n = F.greatest(F.col("n"), F.lit(1.0))
    out = out.select(*by, "gkey", *((F.col(f"s_{f}") / n).alias(f"m{i}") for i, f in enumerate(FEATURES)), *((F.col(f"q{i}{j}") / n - F.col(f"s_{FEATURES[i]}") / n * F.col(f"s_{FEATURES[j]}") / n + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    for j in range(P):
        spent = lambda i, j: sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - spent(j, j), F.lit(FLOOR[j] ** 2 / 4))))
        out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - spent(i, j)) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    return out.select(*by, "gkey", *PARAMETERS, (2 * sum(F.log(f"l{j}{j}") for j in range(P))).alias("logdet"))


def with_distance(rows: DataFrame, fitted: DataFrame, by: tuple[str, ...] = ("gkey",)) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution; the estimates, a row a group, are broadcast within a bound."""
    out = rows.join(broadcast_if_small(fitted), list(by), "left")
    for i in range(P):
        out = out.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))).drop(*(f"z{i}" for i in range(P)), *PARAMETERS, "logdet")


def starts(rows: DataFrame, blend: float) -> DataFrame:
    """Estimates (gkey, start, ...) that the concentration steps begin with."""
    median = lambda c: F.percentile_approx(c, 0.5, ACCURACY)
    half = materialise(rows.groupBy("gkey").agg(*(median(f).alias(f"c_{f}") for f in FEATURES)), "mcd-medians")
    off = rows.join(broadcast_if_small(half), "gkey").select("gkey", *(F.abs(F.col(f) - F.col(f"c_{f}")).alias(f"a_{f}") for f in FEATURES))
    mad = off.groupBy("gkey").agg(*(median(f"a_{f}").alias(f"w_{f}") for f in FEATURES))
    width = [F.greatest(F.col(f"w_{f}") * 1.4826, F.lit(FLOOR[i])) for i, f in enumerate(FEATURES)]
    half = materialise(half.join(mad, "gkey").select("gkey", *(f"c_{f}" for f in FEATURES), *(w.alias(f"w_{f}") for w, f in zip(width, FEATURES))), "mcd-scales")
    plain = half.select("gkey", F.lit(0).alias("start"), *(F.col(f"c_{f}").alias(f"m{i}") for i, f in enumerate(FEATURES)), *((F.col(f"w_{FEATURES[i]}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1)))
    near = rows.join(broadcast_if_small(half), "gkey").select("gkey", *(F.greatest(F.least(F.col(f), F.col(f"c_{f}") + 2 * F.col(f"w_{f}")), F.col(f"c_{f}") - 2 * F.col(f"w_{f}")).alias(f) for f in FEATURES))
    own = rows.select("gkey", *FEATURES).withColumn("start", F.lit(1)).unionByName(near.withColumn("start", F.lit(2)))
    return plain.withColumn("logdet", F.lit(0.0)).unionByName(estimates(materialise(own.groupBy("gkey", "start").agg(*moments()), "mcd-sums"), blend))


def fit_mcd(rows: DataFrame, support: float = SUPPORT, steps: int = STEPS, blend: float = BLEND) -> DataFrame:
    """Per gkey: location, Cholesky factor, log determinant, and ``scale``, which brings a median squared distance above chi-squared's down to it."""
    every = rows.select("gkey", *FEATURES, F.explode(F.array(*map(F.lit, range(3)))).alias("start"))
    by = ("gkey", "start")
    fitted, first = materialise(starts(rows, blend), "mcd-start"), True
    for _ in range(steps):
        d = with_distance(every, fitted, by)
        cut = materialise(d.groupBy(*by).agg(F.percentile_approx("d2", support, ACCURACY).alias("cut")), "mcd-cut")
        sums = d.join(broadcast_if_small(cut), list(by)).where("d2 <= cut").groupBy(*by).agg(*moments())
        now = materialise(estimates(materialise(sums, "mcd-sums"), blend), "mcd-fit")
        fallen = now.join(fitted.select(*by, F.col("logdet").alias("was")), list(by)).where(F.col("logdet") < F.col("was") - SETTLED)
        settled, fitted, first = not first and not fallen.limit(1).count(), now, False
        if settled:
            break
    best = materialise(fitted.groupBy("gkey").agg(F.min_by(F.struct(*PARAMETERS, "logdet"), F.struct("logdet", "start")).alias("b")).select("gkey", "b.*"), "mcd-best")
    scale = with_distance(rows.select("gkey", *FEATURES), best).groupBy("gkey").agg((F.lit(CHI2_MEDIAN) / F.greatest(F.percentile_approx("d2", 0.5, ACCURACY), F.lit(CHI2_MEDIAN))).alias("scale"))
    return materialise(best.join(scale, "gkey"), "mcd-scaled")


def quality_verdicts(docs: DataFrame, cutoff: float = CUTOFF, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs(text, lang, source, ...)``: the ``keep`` columns, statistics, distance2, base_failed and kept."""
    rows = materialise(vectors(text_statistics(docs, [*keep, "lang", "source"])), "quality-stats")
    fitting = rows.where("not base_failed").select("gkey", *FEATURES)
    fitted = fit_mcd(fitting)
    # A group whose documents all fail the base rule has no estimate; its rows are rejected already.
    scored = with_distance(rows, fitted)
    return scored.withColumn("distance2", F.col("d2") * F.col("scale")).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance2", F.lit(0.0)) <= cutoff)).drop("gkey", "scale", "d2")


def reject_outliers(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents; rows that share a doc_id, or have none, are judged one by one."""
    rows = keyed(nested(docs, "doc_id", "text", "lang", "source"))
    rejected = materialise(quality_verdicts(rows, keep=("row_id",)).where("not kept").select("row_id"), "quality-rejected")
    return unnested(rows.join(broadcast_if_small(rejected), "row_id", "left_anti"), docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2"))
