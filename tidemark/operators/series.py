"""Layers that are plain relational work: baseline, anomaly, readiness, load,
decomposition, correlations. Each takes a day frame and gives nothing for an
entity whose history is too short."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clamp, ewma, interpolated, let, mad, sorted_mad, sorted_median, squash
from ..registry import ANOMALY_METRICS, BASELINE_METRICS, BY_NAME
from .frame import long_frame


def _labels(rows: DataFrame) -> DataFrame:
    m = F.create_map(*(x for k, v in BY_NAME.items() for x in (F.lit(k), F.struct(F.lit(v.label).alias("label"), F.lit(v.unit).alias("unit"), F.lit(v.higher_is_better).alias("up")))))
    return rows.withColumn("_m", m[F.col("metric")])


def baseline(frame: DataFrame, metrics: tuple[str, ...] = BASELINE_METRICS) -> DataFrame:
    """entity_id, metric, n, mean, stdev, median, mad, ewma_fast, ewma_slow, latest.
    At least three values."""
    rows = long_frame(frame, metrics).filter("value IS NOT NULL")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"])
    g = rows.groupBy("entity_id", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"), ordered.alias("v"))
    g = g.filter("n >= 3").withColumn("a", F.array_sort("v"))
    return g.select("entity_id", "metric", "n", "mean", "stdev", sorted_median(F.col("a")).alias("median"), sorted_mad(F.col("a")).alias("mad"), ewma(F.col("v"), 7).alias("ewma_fast"), ewma(F.col("v"), 28).alias("ewma_slow"), F.element_at("v", -1).alias("latest"))


def anomalies(frame: DataFrame, metrics: tuple[str, ...] = ANOMALY_METRICS) -> DataFrame:
    """Days that leave the trailing 28 rows' median by two deviations or more."""
    w = Window.partitionBy("entity_id", "metric").orderBy("idx").rowsBetween(-28, -1)
    rows = long_frame(frame, metrics).withColumn("a", F.collect_list("value").over(w)).withColumn("expected", F.percentile("value", 0.5).over(w))
    # the median is the window's own column, which the deviations only refer to
    rows = rows.filter("value IS NOT NULL AND size(a) >= 10").withColumn("_s", let(mad(F.col("a"), F.col("expected")), lambda s: F.when(s > 0, (F.col("value") - F.col("expected")) / s)))
    rows = _labels(rows.withColumnRenamed("_s", "z").filter("abs(z) >= 2"))
    severity = F.when(F.abs("z") >= 4, "extreme").when(F.abs("z") >= 3, "notable").otherwise("watch")
    above = F.col("z") > 0
    return rows.select("entity_id", "metric", "date", "value", "expected", "z", severity.alias("severity"), F.when(above, "above").otherwise("below").alias("direction"), (above != F.col("_m.up")).alias("concerning"))


def recent_anomalies(found: DataFrame, as_of: str, days: int = 30, most: int = 8) -> DataFrame:
    """The largest deviations of the last days for each entity, the newest first."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(F.abs("z")), F.desc("date"), "metric")
    rows = found.filter(F.col("date") >= F.date_sub(F.to_date(F.lit(as_of)), days)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return rows.drop("_r").orderBy("entity_id", F.desc("date"), F.desc(F.abs("z")), "metric")


def training_load(frame: DataFrame) -> DataFrame:
    """entity_id, acute, chronic, ratio, verdict: effort of 7 days over 28."""
    effort = F.when(F.col("active_minutes").isNotNull() | F.col("calories").isNotNull(), F.coalesce("active_minutes", F.lit(0.0)) + F.coalesce("calories", F.lit(0.0)) / 10)
    back = F.max("idx").over(Window.partitionBy("entity_id")) - F.col("idx")
    rows = frame.select("entity_id", effort.alias("e"), back.alias("back"))
    in7, in28 = F.when(F.col("back") < 7, F.col("e")), F.when(F.col("back") < 28, F.col("e"))
    g = rows.groupBy("entity_id").agg(F.avg(in7).alias("acute"), F.count(in7).alias("n7"), F.avg(in28).alias("chronic"), F.count(in28).alias("n28"))
    g = g.filter("n7 >= 3 AND n28 >= 10 AND chronic <> 0").withColumn("ratio", F.col("acute") / F.col("chronic"))
    r = F.col("ratio")
    verdict = F.when(r < 0.8, "Detraining").when(r > 1.5, "Spiking").when(r > 1.3, "Ramping hard").otherwise("In the sweet spot")
    return g.select("entity_id", "acute", "chronic", "ratio", verdict.alias("verdict"))


def sleep_consistency(frame: DataFrame) -> DataFrame:
    """entity_id, cv, score: spread of the last fortnight's nights, five at least."""
    back = F.max("idx").over(Window.partitionBy("entity_id")) - F.col("idx")
    rows = frame.select("entity_id", F.when(back < 14, F.col("sleep_minutes")).alias("s"))
    g = rows.groupBy("entity_id").agg(F.count("s").alias("n"), F.avg("s").alias("m"), F.stddev_pop("s").alias("sd")).filter("n >= 5 AND m <> 0")
    cv = F.col("sd") / F.col("m")
    return g.select("entity_id", cv.alias("cv"), clamp(100 * (1 - cv / 0.35), 0, 100).alias("score"))


#: The weights of readiness.
WEIGHTS = (("hrv", 0.3), ("resting_heart_rate", 0.25), ("sleep_duration", 0.25), ("sleep_consistency", 0.1), ("load", 0.1))


def readiness_components(frame: DataFrame) -> DataFrame:
    """entity_id, component, weight, score (null if not available)."""
    entities = frame.select("entity_id").distinct()
    b = baseline(frame, ("hrv", "resting_heart_rate", "sleep_minutes"))
    z = (F.col("latest") - F.col("median")) / F.col("mad")
    own = F.when(F.col("mad") > 0, squash(F.when(F.col("metric") == "resting_heart_rate", -z).otherwise(z)))
    target = clamp(100 * F.col("latest") / 450.0, 0, 100)
    score = F.when(F.col("metric") == "sleep_minutes", F.coalesce(0.5 * target + 0.5 * own, target)).otherwise(own)
    parts = b.select("entity_id", F.when(F.col("metric") == "sleep_minutes", "sleep_duration").otherwise(F.col("metric")).alias("component"), score.alias("score"))
    parts = parts.unionByName(sleep_consistency(frame).select("entity_id", F.lit("sleep_consistency").alias("component"), "score"))
    load = training_load(frame).select("entity_id", F.lit("load").alias("component"), clamp(100 - F.abs(F.col("ratio") - 1.05) * 180, 0, 100).alias("score"))
    weights = F.array(*(F.struct(F.lit(k).alias("component"), F.lit(w).alias("weight")) for k, w in WEIGHTS))
    every = entities.select("entity_id", F.inline(weights))
    return every.join(parts.unionByName(load), ["entity_id", "component"], "left")


def readiness(frame: DataFrame) -> DataFrame:
    """entity_id, score, band, coverage: the weighted mean of what is available."""
    usable = F.when(F.col("score").isNotNull(), F.col("weight"))
    g = readiness_components(frame).groupBy("entity_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum(usable)).alias("score"), F.coalesce(F.sum(usable), F.lit(0.0)).alias("coverage"))
    s = F.col("score")
    band = F.when(s.isNull() | (s < 35), "rest").when(s < 55, "easy").when(s < 75, "steady").otherwise("push")
    return g.select("entity_id", "score", band.alias("band"), "coverage")


def decomposed(frame: DataFrame, metric: str) -> DataFrame:
    """entity_id, idx, weekday, value, trend, seasonal, residual for one metric."""
    rows = long_frame(frame, (metric,))
    rows = interpolated(rows, ["entity_id", "metric"], "idx", "value", 3)
    w7 = Window.partitionBy("entity_id").orderBy("idx").rowsBetween(-3, 3)
    rows = rows.withColumn("trend", F.when(F.count("filled").over(w7) == 7, F.avg("filled").over(w7)))
    rows = rows.withColumn("n", F.count("filled").over(Window.partitionBy("entity_id"))).filter("n >= 21")
    rows = rows.withColumn("detr", F.col("filled") - F.col("trend"))
    raw = rows.groupBy("entity_id", "weekday").agg(F.coalesce(F.avg("detr"), F.lit(0.0)).alias("effect"))
    centred = raw.withColumn("seasonal", F.col("effect") - F.sum("effect").over(Window.partitionBy("entity_id")) / 7).drop("effect")
    rows = rows.join(centred, ["entity_id", "weekday"])
    return rows.select("entity_id", "date", "idx", "weekday", F.col("filled").alias("value"), "trend", "seasonal", (F.col("detr") - F.col("seasonal")).alias("residual"), "detr")


def weekday_effects(frame: DataFrame, metric: str) -> DataFrame:
    return decomposed(frame, metric).groupBy("entity_id", "weekday").agg(F.max("seasonal").alias("effect"))


def seasonal_strength(frame: DataFrame, metric: str) -> DataFrame:
    """entity_id, strength, strongest and weakest weekday with their effects."""
    rows = decomposed(frame, metric)
    g = rows.groupBy("entity_id").agg(
        F.var_pop("detr").alias("vd"), F.var_pop("residual").alias("vr"), F.max_by("weekday", F.struct("seasonal", -F.col("weekday"))).alias("strongest"), F.max("seasonal").alias("strongest_effect"),
        F.min_by("weekday", F.struct("seasonal", "weekday")).alias("weakest"), F.min("seasonal").alias("weakest_effect"),
    )
    strength = F.when(F.col("vd") > 0, F.greatest(F.lit(0.0), 1 - F.col("vr") / F.col("vd"))).otherwise(0.0)
    return g.select("entity_id", strength.alias("strength"), "strongest", "strongest_effect", "weakest", "weakest_effect")


def correlations(frame: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """entity_id, a, b, r for each pair of metrics over days that have both."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]
    g = frame.groupBy("entity_id").agg(*(F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"{a}|{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs))
    return g.select("entity_id", F.inline(rows))


def simple_fit(frame: DataFrame, y: str, x: str) -> DataFrame:
    """entity_id, slope, intercept, r2 of a straight line; r2 is 0 if degenerate."""
    g = frame.groupBy("entity_id").agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.coalesce(F.regr_r2(y, x), F.lit(0.0)).alias("r2"))
    return g
