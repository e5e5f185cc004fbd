"""Models that go through a series' days in turn, and through a matrix's cells, as folds
over arrays: they run in the JVM beside the aggregation that collects a group's bounded
array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import interpolated, let
from ..registry import BY_NAME, FORECAST_METRICS
from .frame import long_frame

#: The smoother's weights, its season, days it needs, and two quantiles.
ALPHA, BETA, GAMMA, SEASON, LEAST_DAYS = 0.3, 0.05, 0.3, 7, 21
QUANTILES = ((80, 1.2816), (95, 1.96))


def _mean(values: Column) -> Column:
    """The mean of an array's known values; null if it has none."""
    known = F.filter(values, lambda v: v.isNotNull())
    return let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda s, v: s + v) / F.size(k)))


def _begun(x: Column) -> Column:
    """The state before the first day: level, slope, season, errors and their squares."""
    slope = F.coalesce((_mean(F.slice(x, SEASON + 1, SEASON)) - _mean(F.slice(x, 1, SEASON))) / SEASON, F.lit(0.0))

    def season(level: Column) -> Column:
        every = lambda i: F.filter(x, lambda _, t: t % SEASON == i)
        return F.transform(F.sequence(F.lit(0), F.lit(SEASON - 1)), lambda i: F.coalesce(_mean(every(i)) - level, F.lit(0.0)))

    return let(_mean(F.slice(x, 1, 2 * SEASON)), lambda level: F.struct(level.alias("level"), slope.alias("slope"), season(level).alias("season"), F.lit(0).alias("n"), F.lit(0.0).alias("squares")))


def _day(s: Column, v: Column, t: Column) -> Column:
    """The state after day t with value v; an unknown value moves the level alone."""
    at = (t % SEASON).cast("int")
    own = F.get(s["season"], at)
    unknown = F.struct((s["level"] + s["slope"]).alias("level"), s["slope"].alias("slope"), s["season"].alias("season"), s["n"].alias("n"), s["squares"].alias("squares"))

    def known(level: Column) -> Column:
        slope = BETA * (level - s["level"]) + (1 - BETA) * s["slope"]
        season = F.transform(s["season"], lambda x, i: F.when(i == at, GAMMA * (v - level) + (1 - GAMMA) * x).otherwise(x))
        error = v - (s["level"] + s["slope"] + own)
        return F.struct(level.alias("level"), slope.alias("slope"), season.alias("season"), (s["n"] + 1).alias("n"), (s["squares"] + error * error).alias("squares"))

    return F.when(v.isNull(), unknown).otherwise(let(ALPHA * (v - own) + (1 - ALPHA) * (s["level"] + s["slope"]), known))


def smoothed(x: Column) -> Column:
    """The weekly additive smoother's last state over an ordered array of doubles that
    begins with a known one: level, slope, season, n, squares."""
    days = lambda x: F.transform(x, lambda v, t: F.struct(v.alias("v"), t.alias("t")))
    return let(x, lambda x: F.aggregate(days(x), _begun(x), lambda s, d: _day(s, d["v"], d["t"])))


def forecasts(frame: DataFrame, metrics: tuple[str, ...] = FORECAST_METRICS, horizon: int = 7) -> DataFrame:
    """entity_id, metric, day, value, bounds and rmse: days ahead of each metric with
    enough known days."""
    rows = interpolated(long_frame(frame, metrics), ["entity_id", "metric"], "idx", "value", 3)
    series = rows.groupBy("entity_id", "metric").agg(F.array_sort(F.collect_list(F.struct("idx", "filled"))).alias("days"), F.count("filled").alias("known"), F.min(F.when(F.col("filled").isNotNull(), F.col("idx"))).alias("first"))
    series = series.filter(F.col("known") >= LEAST_DAYS)
    x = F.transform(F.filter("days", lambda d: d["idx"] >= F.col("first")), lambda d: d["filled"])
    series = series.select("entity_id", "metric", x.alias("x")).withColumn("s", smoothed(F.col("x"))).withColumn("rmse", F.sqrt(F.col("s.squares") / F.col("s.n")))
    h = F.col("day")
    rows = series.select("entity_id", "metric", F.size("x").alias("size"), "s", "rmse", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day"))
    season = F.get(F.col("s.season"), ((F.col("size") + h - 1) % SEASON).cast("int"))
    floored = F.col("metric").isin(*(m for m in metrics if BY_NAME[m].non_negative))
    floor = lambda c: F.when(floored, F.greatest(F.lit(0.0), c)).otherwise(c)
    rows = rows.withColumn("value", floor(F.col("s.level") + h * F.col("s.slope") + season)).withColumn("spread", F.col("rmse") * F.sqrt(h))
    low = [floor(F.col("value") - q * F.col("spread")).alias(f"lower{p}") for p, q in QUANTILES]
    high = [(F.col("value") + q * F.col("spread")).alias(f"upper{p}") for p, q in QUANTILES]
    return rows.select("entity_id", "metric", "day", "value", *low, *high, "rmse")


# --- moments and axes --------------------------------------------------------

#: Rounds of rotations; the off-diagonal falls quadratically, so a few suffice.
SWEEPS = 10


def covariances(frame: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """entity_id, a, b, covariance, correlation, n: every pair of metrics (a <= b) over
    the days that have all of them, by one aggregation of moments."""
    rows = frame.select("entity_id", *(F.col(m).cast("double").alias(m) for m in metrics)).dropna()
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i:]]
    g = rows.groupBy("entity_id").agg(F.count("*").alias("n"), *(f(a, b).alias(f"{f.__name__}:{a}:{b}") for a, b in pairs for f in (F.covar_samp, F.corr)))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"covar_samp:{a}:{b}").alias("covariance"), F.col(f"corr:{a}:{b}").alias("correlation")) for a, b in pairs))
    return g.select("entity_id", F.explode(each).alias("p"), "n").select("entity_id", "p.*", "n")


def eigen(matrix: Column, k: int) -> Column:
    """The eigenvalues and vectors of a symmetric k x k matrix, an array by rows: structs
    (value, vector), the largest value first, each vector's largest entry positive. By
    Jacobi's rotations, folded over the cells above the diagonal."""
    cells = F.sequence(F.lit(0), F.lit(k * k - 1))
    get = lambda m, i, j: F.get(m, (i * k + j).cast("int"))
    at = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for _ in range(SWEEPS) for p in range(k) for q in range(p + 1, k)))

    def turned(s: Column, x: Column) -> Column:
        m, v, p, q = s["m"], s["v"], x["p"], x["q"]

        def by(t: Column) -> Column:
            c = 1 / F.sqrt(t * t + 1)
            sine = t * c

            def mixed(of: Column, axis: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
                # rows or columns p and q become c p - s q and s p + c q
                def cell(n: Column) -> Column:
                    i, j = F.floor(n / k), n % k
                    line, other = axis(i, j)
                    pick = lambda z: get(of, *axis(z, other))
                    return F.when(line == p, c * pick(p) - sine * pick(q)).when(line == q, sine * pick(p) + c * pick(q)).otherwise(F.get(of, n))

                return F.transform(cells, cell)

            rows, columns = (lambda i, j: (i, j)), (lambda i, j: (j, i))
            return F.struct(let(mixed(m, columns), lambda half: mixed(half, rows)).alias("m"), mixed(v, columns).alias("v"))

        theta = (get(m, q, q) - get(m, p, p)) / (2 * get(m, p, q))
        t = F.when(theta >= 0, 1.0).otherwise(-1.0) / (F.abs(theta) + F.sqrt(theta * theta + 1))
        return F.when(F.abs(get(m, p, q)) < 1e-300, s).otherwise(let(t, by))

    one = F.transform(cells, lambda n: F.when(F.floor(n / k) == n % k, 1.0).otherwise(0.0))

    def pairs(s: Column) -> Column:
        vector = lambda j: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: get(s["v"], i, j))
        signed = lambda v: let(F.element_at(F.array_sort(F.transform(v, lambda x: F.struct(F.abs(x), x.alias("x")))), -1)["x"], lambda big: F.transform(v, lambda x: F.when(big < 0, -x).otherwise(x)))
        every = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.struct(get(s["m"], j, j).alias("value"), let(vector(j), signed).alias("vector")))
        return F.reverse(F.array_sort(every))

    return let(F.aggregate(at, F.struct(matrix.alias("m"), one.alias("v")), turned), pairs)


def axes(frame: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """entity_id, n, matrix, axis (from 1), value, vector: the principal axes of the
    metrics' correlations."""
    k, at = len(metrics), {m: i for i, m in enumerate(metrics)}
    place = F.create_map(*(F.lit(x) for m, i in at.items() for x in (m, i)))
    found = covariances(frame, metrics).withColumn("i", place[F.col("a")]).withColumn("j", place[F.col("b")])
    cells = F.array(F.struct((F.col("i") * k + F.col("j")).alias("n"), "correlation"), F.struct((F.col("j") * k + F.col("i")).alias("n"), "correlation"))
    cells = found.groupBy("entity_id", "n").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(cells)))).alias("cells"))
    rows = cells.withColumn("matrix", F.transform("cells", lambda c: c["correlation"])).filter(F.size("matrix") == k * k).filter(~F.exists("matrix", lambda x: x.isNull()))
    return rows.select("entity_id", "n", "matrix", F.posexplode(eigen(F.col("matrix"), k)).alias("axis", "pair")).select("entity_id", "n", "matrix", (F.col("axis") + 1).alias("axis"), "pair.value", "pair.vector")
