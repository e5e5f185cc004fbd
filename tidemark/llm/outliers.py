"""Robust multivariate outliers: minimum-covariance-determinant estimates for each
language and source, and rejection by Mahalanobis distance.

Each text gives four counts; their transformed ratios (mean word length, symbol
density, share of repeated lines, share of repeated words) form its vector. Within
each group of language and source the estimate starts from medians and median
deviations and from the plain mean and covariance. Concentration steps follow:
distances to the current estimate, the closest `SHARE` of the rows, their mean and
covariance; after each step's end the start with the smaller determinant stays.

A step is one pass over the rows with map-side combination: rows are binned by the
logarithm of their squared distance, 32 bins for a doubling, and the sums of each
(group, bin) suffice to find the bin in which the share is reached and the moments
up to it, so no group meets in one task. The subset is thus whole bins.

Covariances get `FLOOR` on their diagonal (the regularised estimate), as some
statistics are zero for most texts. A group's mean, covariance and scale are drawn
towards its language's, and those towards the whole table's, with the weight of
`PRIOR` rows: n / (n + PRIOR) is its own, for any n, so that no verdict jumps with a
group's size. A null language or source is a group of its own.

Defined cases: a null text has no words and fails the base rules. Ties in distance
share a bin. Repeated rows count each. Very long texts are counted whole. An empty
table gives no rows. Columns other than doc_id, text, lang and source are ignored,
whatever their names; a missing lang or source is null."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small, stored

SHARE, PRIOR, STEPS = 0.75, 200, 6
#: Smallest variance of each statistic, in its own units squared.
FLOOR = (0.08**2, 0.03**2, 0.15**2, 0.15**2)
#: Squared distance beyond which a text is rejected: the chi-squared quantile at
#: 1 - 1e-6 with four degrees of freedom.
CUTOFF = 33.38
BINS = 32
STATS = ("log_word_length", "symbols", "dup_lines", "repeats")
P = len(STATS)
PAIRS = list(combinations_with_replacement(range(P), 2))
_SPACE, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times: dict[tuple, int] = {}
        for w in windows:
            times[w] = times.get(w, 0) + 1
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, len(text) - sum(map(text.count, _SPACE)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines)


def _counted(documents: DataFrame) -> DataFrame:
    columns = [c for c in ("doc_id", "lang", "source") if c in documents.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts(t) for t in batch.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(rows[:, i]) for i in range(len(COUNTS)))], names=[*columns, *COUNTS])

    schema = T.StructType([*(documents.schema[c] for c in columns), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return documents.select(*columns, "text").mapInArrow(run, schema)


def _vector() -> list[Column]:
    n, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    return [F.log(chars / n), F.sqrt(F.col("n_symbols") / chars), F.col("n_dup_lines") / lines, F.sqrt(F.col("n_repeat_words") / n)]


_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]
_ESTIMATE = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i, j in PAIRS] + ["logdet"]


def _mean_cov(b: pa.RecordBatch, tail: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (with its floor) of each row's sums."""
    n = np.asarray(b.column("n" + tail), dtype=float)
    mean = np.stack([np.asarray(b.column(f"s{i}{tail}")) / n for i in range(P)], axis=1)
    cov = np.zeros((len(n), P, P))
    for i, j in PAIRS:
        cov[:, i, j] = cov[:, j, i] = np.asarray(b.column(f"q{i}{j}{tail}")) / n - mean[:, i] * mean[:, j]
    cov[:, range(P), range(P)] = np.maximum(cov[:, range(P), range(P)], 0)
    return mean, cov + np.diag(FLOOR)


def _estimate(b: pa.RecordBatch, keys: list[str], mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    """The keys with mean, inverse covariance (off-diagonal doubled), log determinant."""
    inv, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
    out = [mean[:, i] for i in range(P)] + [inv[:, i, j] * (1 if i == j else 2) for i, j in PAIRS] + [logdet]
    return pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *map(pa.array, out)], names=[*keys, *_ESTIMATE])


def _mapped(sums: DataFrame, keys: list[str], of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _estimate(b, keys, *of(b))

    return sums.mapInArrow(run, T.StructType([*(sums.schema[k] for k in keys), *(T.StructField(c, T.DoubleType()) for c in _ESTIMATE)]))


def _estimates(sums: DataFrame) -> DataFrame:
    """The estimate of each (fit, start) from its sums."""
    return _mapped(sums, ["fit", "start"], _mean_cov)


def _blended(groups: DataFrame, sums: DataFrame) -> DataFrame:
    """The estimate of each group, drawn towards its language's and that towards all
    rows'. groups: own, lang_fit, all_fit (keys); sums: fit, sums over the chosen rows, and
    `many`, the number of all rows."""
    at = lambda tail: sums.select(F.col("fit").alias(f"fit{tail}"), *(F.col(c).alias(c + tail) for c in [*_SUMS, "many"]))
    rows = groups.join(at("_g"), F.col("own") == F.col("fit_g")).join(at("_l"), F.col("lang_fit") == F.col("fit_l")).join(at("_a"), F.col("all_fit") == F.col("fit_a"))

    def of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        mean, cov = _mean_cov(b, "_a")
        for tail in ("_l", "_g"):
            m, c = _mean_cov(b, tail)
            w = _weight(np.asarray(b.column("many" + tail), dtype=float))
            mean, cov = w[:, None] * m + (1 - w[:, None]) * mean, w[:, None, None] * c + (1 - w[:, None, None]) * cov
        return mean, cov

    return _mapped(rows, ["own"], of)


def _weight(n):  # noqa: ANN001, ANN202  # a column or an array
    """How much of a group's estimate is its own."""
    return n / (n + PRIOR)


def _distance() -> Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.col(f"c{i}{j}") * d[i] * d[j]
    return F.greatest(total, F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i, j in PAIRS)]


def _named(*columns: str) -> Column:
    """A key of a group, null kept apart from text."""
    return F.to_json(F.array(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")) for c in columns)))


_OWN, _LANG = "own", "lang_fit"


def scored(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, distance (squared; null without words),
    base_failed and kept."""
    rows = _counted(documents)
    for c in ("lang", "source"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.select("doc_id", "lang", "source", *COUNTS, *(x.alias(f"x{i}") for i, x in enumerate(_vector())))
    rows = stored(rows.withColumn(_OWN, _named("lang", "source")).withColumn(_LANG, _named("lang")), "stats")
    worded = rows.filter("n_words > 0")
    groups = stored(worded.groupBy(_OWN, _LANG).count().select(_OWN, _LANG, F.lit("all").alias("all_fit")), "groups")
    n_groups, key_bytes = groups.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(_OWN)), F.lit(0))).first()
    est_bytes = 4 * (key_bytes + 200 * n_groups) + 1000
    xs = [f"x{i}" for i in range(P)]
    members = stored(worded.select(F.explode(F.array(_OWN, _LANG, F.lit("all"))).alias("fit"), *xs), "members")

    mid = members.groupBy("fit").agg(F.count("*").alias("n"), *(F.percentile_approx(x, F.lit([0.25, 0.5, 0.75]), 10000).alias(f"p{i}") for i, x in enumerate(xs)))
    mid = stored(mid, "quartiles")
    spread = [F.pow(F.greatest(F.abs(F.col(f"p{i}")[2] - F.col(f"p{i}")[0]), F.lit(1e-9)) * 0.7413, F.lit(2.0)) for i in range(P)]
    centre = [F.col(f"p{i}")[1] for i in range(P)]
    robust = mid.select(
        "fit", F.lit("median").alias("start"), "n", *((centre[i] * F.col("n")).alias(f"s{i}") for i in range(P)), *((((spread[i] if i == j else F.lit(0.0)) + centre[i] * centre[j]) * F.col("n")).alias(f"q{i}{j}") for i, j in PAIRS)
    )
    plain = members.groupBy("fit").agg(*_moments()).withColumn("start", F.lit("mean"))
    est = stored(_estimates(robust.unionByName(plain)), "estimate")
    for step in range(STEPS):
        near = members.join(small(est, est_bytes), "fit")
        d2 = _distance()
        binned = near.withColumn("bin", F.floor(F.log2(d2 + 1e-6) * BINS).cast("int")).groupBy("fit", "start", "bin").agg(*_moments())
        w = Window.partitionBy("fit", "start")
        upto = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        inside = binned.withColumn("_upto", upto).withColumn("_n", F.sum("n").over(w)).filter(F.col("_upto") < F.col("_n") * SHARE)
        sums = inside.groupBy("fit", "start").agg(*(F.sum(c).alias(c) for c in _SUMS))
        if step in (1, STEPS - 1):
            # two steps from either start, then the better one alone
            sums = stored(sums, "sums")
            best = _estimates(sums).withColumn("_r", F.row_number().over(Window.partitionBy("fit").orderBy("logdet", "start"))).filter("_r = 1")
            sums = sums.join(best.select("fit", "start"), ["fit", "start"])
        est = stored(_estimates(sums), "estimate") if step < STEPS - 1 else _blended(groups, stored(sums.join(mid.select("fit", F.col("n").alias("many")), "fit"), "sums"))
    est = stored(est, "estimate")
    # the share's covariance is too small for the whole; it is scaled so that the
    # distances' median is that of a chi-squared variable with P degrees of freedom
    near = worded.join(small(est, est_bytes), _OWN).select(_OWN, _LANG, _distance().alias("d2"))
    near = near.select(F.explode(F.array(_OWN, _LANG, F.lit("all"))).alias("fit"), "d2")
    half = near.groupBy("fit").agg(F.percentile_approx("d2", 0.5, 10000).alias("d50"), F.count("*").alias("n"))
    half = stored(half.select("fit", "n", (F.greatest("d50", F.lit(3.357)) / 3.357).alias("k")), "scale")
    at = lambda tail: half.select(F.col("fit").alias(f"fit{tail}"), F.col("n").alias(f"n{tail}"), F.col("k").alias(f"k{tail}"))
    scale = groups.join(at("_g"), F.col(_OWN) == F.col("fit_g")).join(at("_l"), F.col(_LANG) == F.col("fit_l")).join(at("_a"), F.col("all_fit") == F.col("fit_a"))
    towards = lambda tail, base: _weight(F.col(f"n{tail}")) * F.col(f"k{tail}") + (1 - _weight(F.col(f"n{tail}"))) * base
    est = stored(est.join(scale.select(_OWN, towards("_g", towards("_l", F.col("k_a"))).alias("scale")), _OWN), "estimate")
    out = rows.join(small(est, est_bytes), _OWN, "left")
    out = out.withColumn("distance", F.when(F.col("n_words") > 0, _distance() / F.col("scale")))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "lang", "source", *COUNTS, "distance", base.alias("base_failed"), (~base & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"))
