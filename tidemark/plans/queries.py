"""The registered queries: each operator over the readings made of test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stats import interpolated, sorted_quantile
from ..operators import folds, models, reads, series
from ..operators.frame import daily, daily_by_window, day_frame, days_with_data, local_day, long_frame, scoped, start_of_local_day
from ..registry import FACTOR_METRICS
from ..sources.adapters import HISTORY_DAYS, HISTORY_UNTIL, from_events, from_history, from_lines, from_orders
from ..sources.demo import demo
from ..sources.readings import READING_SCHEMA, body_name, normalised, work_path, write_table
from ..streaming import attempts
from ..streaming.frame_table import changed, frame_rows, refresh
from ..streaming.ingest import last_of_batch, load, new_rows, sync_state
from ..streaming.marks import marks
from .insights import Insights

TZ = "Europe/London"
#: The last days of the events and of the orders.
EVENTS_UNTIL, ORDERS_UNTIL, DEMO_UNTIL = "2024-01-30", "2001-08-01", "2024-06-30"
EVENT_DAYS, ORDER_DAYS = 30, 365
DRIVERS = ("steps", "active_minutes", "sleep_minutes", "resting_heart_rate")
SINCE, UNTIL = "2024-01-08 00:00:00", "2024-01-22 00:00:00"


def _r(c: str | Column, digits: int = 4) -> Column:
    """Rounded, a hair above: an exact half, which sums in another order put on
    either side, goes up always."""
    name = c if isinstance(c, str) else None
    out = F.round((F.col(c) if name else c) + 10.0 ** -(digits + 5), digits)
    return out.alias(name) if name else out


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes))


def _events(spark: SparkSession, d: str, entities: int = 1) -> DataFrame:
    return from_events(spark, d, entities)


def _frame(spark: SparkSession, d: str, entities: int = 1) -> DataFrame:
    return day_frame(_events(spark, d, entities), EVENTS_UNTIL, EVENT_DAYS, TZ)


def _long(spark: SparkSession, d: str) -> DataFrame:
    return day_frame(from_orders(spark, d), ORDERS_UNTIL, ORDER_DAYS, TZ)


def _holes(spark: SparkSession, d: str) -> DataFrame:
    """The events' frame with planted gaps of one to four days in its steps."""
    f = _frame(spark, d).select("entity_id", "date", "idx", F.col("steps").alias("value"))
    return f.withColumn("value", F.when(~F.col("idx").isin(0, 4, 8, 9, 13, 14, 15, 19, 20, 21, 22, 29), F.col("value")))


def frame_daily(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily(_events(spark, d), TZ), 8)


def frame_daily_window(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily_by_window(_events(spark, d), TZ), 8)


def frame_entities(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily(_events(spark, d, 7), TZ), 8)


def frame_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The day frame's table after three loads, of which the second comes late: each
    refreshes the days that it touched."""
    e = last_of_batch(_events(spark, d, 7).withColumn("seq", F.struct("value", "raw")))
    cut = lambda low, high: e.filter((F.col("start_time") >= F.lit(low).cast("timestamp_ntz")) & (F.col("start_time") < F.lit(high).cast("timestamp_ntz")))
    table, frame = work_path(spark, "readings"), work_path(spark, "frame")
    for low, high in (("2024-01-01", "2024-01-12 07:00:00"), ("2024-01-20", "2025-01-01"), ("2024-01-12 07:00:00", "2024-01-20")):
        batch = cut(low, high)
        write_table(batch.select(*READING_SCHEMA.names), table)
        refresh(spark, table, frame, changed(batch, TZ), TZ)
    return _rounded(frame_rows(spark, frame), 8)


def frame_wide(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_frame(spark, d, 3), 8)


def frame_days_with_data(spark: SparkSession, d: str) -> DataFrame:
    return days_with_data(_frame(spark, d, 3))


def frame_long_history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_long(spark, d).select("entity_id", "date", "idx", "weekday", "hrv", "resting_heart_rate", "sleep_minutes", "active_minutes", "steps"))


def end_anchor_day(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(daily(from_lines(spark, d), TZ), 8)


def source_preferred_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.deduped(_events(spark, d, 7).filter(F.col("data_type") == "steps"), ["entity_id"])
    return rows.groupBy("entity_id", "source").agg(F.count("*").alias("n"), _r(F.sum("value"), 4).alias("total"))


def source_exists(spark: SparkSession, d: str) -> DataFrame:
    e = reads.in_range(_events(spark, d, 7), SINCE, UNTIL)
    return e.groupBy("data_type").agg(F.bool_or(F.col("source") == "PRIMARY").alias("has_preferred"))


def bucket_hour_sum(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reads.buckets(_events(spark, d), "steps", "hour", SINCE, UNTIL))


def bucket_day_avg(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reads.buckets(_events(spark, d), "heart-rate-variability", "day"))


def bucket_hour_preferred(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reads.buckets(_events(spark, d, 7), "active-minutes", "hour", SINCE, UNTIL, dedupe=True))


def summary_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(reads.summary(_events(spark, d, 7), SINCE, UNTIL))


def points_page(spark: SparkSession, d: str) -> DataFrame:
    return reads.points(_events(spark, d), "steps", SINCE, UNTIL, page=2, limit=50, raw=True).select("entity_id", "start_time", "value", "source", "raw")


def points_deep(spark: SparkSession, d: str) -> DataFrame:
    """A page that many readings come before, with its rows' ranks."""
    page = reads.points(_events(spark, d), "steps", page=7, limit=25)
    rank = F.row_number().over(Window.orderBy(*reads.order())) + 175  # of a page's rows
    return page.select(rank.cast("long").alias("rank"), "entity_id", "start_time", "source", "value")


def points_cursor(spark: SparkSession, d: str) -> DataFrame:
    """The page that follows another by its last row, with its rows' ranks."""
    e = _events(spark, d, 7)
    last = reads.points_after(e, "steps", None, SINCE, UNTIL, limit=30).tail(1)
    cursor = (last[0]["start_time"], last[0]["entity_id"], last[0]["source"]) if last else None
    page = reads.points_after(e, "steps", cursor, SINCE, UNTIL, limit=40)
    return page.select((F.row_number().over(Window.orderBy(*reads.order())) + 30).cast("long").alias("rank"), "entity_id", "start_time", "source", "value")


def points_count(spark: SparkSession, d: str) -> DataFrame:
    return reads.points_total(_events(spark, d), "steps", SINCE, UNTIL)


def artifact_flags(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).filter(F.col("data_type") == "heart-rate-variability")
    return e.select("start_time", "value", (F.col("value") < 70).alias("artifact"), _r(F.col("value") / 1000, 6).alias("thousands"))


def interpolate_gap2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(interpolated(_holes(spark, d), ["entity_id"], "idx", "value", 2))


def interpolate_gap3(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(interpolated(_holes(spark, d), ["entity_id"], "idx", "value", 3))


def baseline(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.baseline(_frame(spark, d, 3)))


def anomaly_days(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.anomalies(_long(spark, d)))


def anomaly_recent_top8(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.recent_anomalies(series.anomalies(_long(spark, d)), ORDERS_UNTIL))


def training_load(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.training_load(_frame(spark, d, 3)))


def sleep_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.sleep_consistency(_long(spark, d)))


def readiness_parts(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.readiness_components(_long(spark, d)))


def readiness(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.readiness(_long(spark, d)))


def decompose_days(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.decomposed(_long(spark, d), "steps").drop("detr"), 3)


def decompose_weekdays(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.weekday_effects(_long(spark, d), "steps"), 3)


def decompose_strength(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.seasonal_strength(_long(spark, d), "steps"), 3)


def correlation_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.correlations(_long(spark, d), ("steps", "active_minutes", "sleep_minutes", "hrv")), 6)


def line_fit(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(series.simple_fit(_long(spark, d), "steps", "hrv"), 5)


def ridge_two(spark: SparkSession, d: str) -> DataFrame:
    out = models.attribution(_long(spark, d), "hrv", ("steps", "sleep_minutes"), 1)
    return _rounded(out.select("entity_id", "driver", "beta", "share", "r2", "n"), 6)


def ridge_drivers(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.attribution(_long(spark, d), "hrv", DRIVERS, 1), 6)


def next_day_pairs(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("idx")
    rows = _long(spark, d).select("entity_id", "date", F.col("steps").alias("today"), F.lead("hrv", 1).over(w).alias("tomorrow")).dropna()
    return _rounded(rows)


def persistence_error(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("entity_id").orderBy("idx")
    rows = _long(spark, d).select("entity_id", (F.lead("hrv", 1).over(w) - F.col("hrv")).alias("e"))
    return rows.groupBy("entity_id").agg(_r(F.sqrt(F.avg(F.pow("e", F.lit(2.0)))), 4).alias("rmse"), F.count("e").alias("n"))


def complete_cases(spark: SparkSession, d: str) -> DataFrame:
    cols = ["steps", "active_minutes", "sleep_minutes", "resting_heart_rate", "hrv"]
    f = _long(spark, d)
    known = reduce(Column.__add__, (F.col(c).isNotNull().cast("int") for c in cols))
    return f.groupBy("entity_id").agg(F.count_if(known == len(cols)).alias("complete"), F.count_if(known >= 3).alias("usable"))


def weekday_mix(spark: SparkSession, d: str) -> DataFrame:
    f = _long(spark, d).filter("steps IS NOT NULL").withColumn("high", F.col("steps") > 500_000)
    return f.groupBy("high").pivot("weekday", list(range(7))).count().fillna(0).select("high", *(F.col(str(i)).alias(f"d{i}") for i in range(7)))


def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = scoped(_events(spark, d), TZ).groupBy("data_type").agg(F.sum("value").alias("total"))
    return g.select("data_type", _r(F.col("total") / F.sum("total").over(Window.partitionBy()), 8).alias("share"))


def anomalies_anti_join(spark: SparkSession, d: str) -> DataFrame:
    a = series.anomalies(_long(spark, d))
    steps, rest = a.filter("metric = 'steps'"), a.filter("metric <> 'steps' AND concerning")
    return _rounded(steps.join(rest.select("entity_id", "date"), ["entity_id", "date"], "left_anti").select("entity_id", "date", "z"))


def history_union(spark: SparkSession, d: str) -> DataFrame:
    f = _frame(spark, d).select("entity_id", "date", "idx", "steps")
    past = f.filter("idx < 23").select("entity_id", "date", F.col("steps").alias("history"))
    ahead = f.filter("idx >= 22").select("entity_id", "date", F.col("steps").alias("projection"))
    return _rounded(past.unionByName(ahead, allowMissingColumns=True))


def json_extract(spark: SparkSession, d: str) -> DataFrame:
    n = F.get_json_object("raw", "$.k").try_cast("double")
    return _events(spark, d).groupBy("data_type").agg(F.count(n).alias("parsed"), _r(F.sum(n), 4).alias("total"), F.countDistinct(n).alias("kinds"))


#: The kinds of point that json_readings writes: type, fields of its body as SQL over n,
#: and what is read from them (in SQL too), with its unit. The last five types have no
#: fields of their own, but those that any type may have.
POINTS = (
    ("heart-rate", "n % 100 AS beatsPerMinute", "n % 100", "bpm"),
    ("daily-resting-heart-rate", "CAST(n % 90 AS STRING) AS beatsPerMinute", "n % 90", "bpm"),
    ("heart-rate-variability", "n % 80 + 0.5D AS rootMeanSquareOfSuccessiveDifferencesMilliseconds", "n % 80 + 0.5", "ms"),
    ("daily-heart-rate-variability", "n % 70 AS rootMeanSquareOfSuccessiveDifferencesMilliseconds", "n % 70", "ms"),
    ("oxygen-saturation", "n % 100 AS percentage", "n % 100", "%"),
    ("daily-oxygen-saturation", "CAST(n % 99 AS STRING) AS percentage", "n % 99", "%"),
    ("steps", "CAST(n AS STRING) AS count", "n", "count"),
    ("distance", "CAST(n AS STRING) AS millimeters", "n / 1000.0", "m"),
    ("height", "n % 2000 AS heightMillimeters", "n % 2000 / 1000.0", "m"),
    ("weight", "CASE WHEN n % 2 = 0 THEN n % 150 END AS weightKilograms, n % 140 AS kilograms", "CASE WHEN n % 2 = 0 THEN n % 150 ELSE n % 140 END", "kg"),
    ("body-fat", "n % 40 AS percentage", "n % 40", "%"),
    ("active-energy-burned", "n % 900 AS kcal", "n % 900", "kcal"),
    ("active-zone-minutes", "CAST(n % 60 AS STRING) AS activeZoneMinutes", "n % 60", "min"),
    ("swim-lengths-data", "n % 50 AS strokeCount", "n % 50", "count"),
    ("sleep", "struct(CAST(n % 600 AS STRING) AS minutesAsleep) AS summary", "n % 600", "min"),
    ("exercise", "struct(n % 800 AS caloriesKcal) AS metricsSummary", "n % 800", "kcal"),
    ("active-minutes", "array(struct(CAST(n % 7 AS STRING) AS activeMinutes), struct(CAST(NULL AS STRING) AS activeMinutes), struct('2' AS activeMinutes)) AS activeMinutesByActivityLevel", "n % 7 + 2", "min"),
    ("sedentary-period", "1 AS other", "CASE WHEN form IN (0, 3, 4) THEN 30 END", "min"),
    ("time-in-heart-rate-zone", "1 AS other", "CASE WHEN form IN (0, 3, 4) THEN 30 END", "min"),
    ("altitude", "n % 500 AS meters", "n % 500", "m"),
    ("vo2-max", "'no number' AS percentage, n % 190 AS beatsPerMinute", "n % 190", "bpm"),
    ("hydration-log", "CAST(n % 12 AS STRING) AS count", "n % 12", "count"),
    ("nutrition-log", "n % 3 AS kilograms", "n % 3", "kg"),
    ("blood-glucose", "n % 77 AS percentage, n AS meters", "n % 77", "%"),
)


def json_points(spark: SparkSession, d: str) -> DataFrame:
    """data_type, point: the events as points that the interface would send, in turn of
    each kind, with their times in each of five forms and with or without a source."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"), "ts", F.floor(F.col("event_id") / len(POINTS) % 5).alias("form"))
    at = lambda t: f"date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
    start, end = at("ts"), at("ts + INTERVAL '30' MINUTE")
    span = lambda form: f"CASE WHEN form = {form} THEN struct({start} AS startTime, {end} AS endTime) END AS interval"
    inner = f"{span(0)}, CASE WHEN form = 1 THEN struct({start} AS physicalTime) END AS sampleTime, CASE WHEN form = 2 THEN struct(year(ts) AS year, month(ts) AS month, day(ts) AS day) END AS date"
    outer = f"{span(3)}, CASE WHEN form = 4 THEN {start} END AS startTime, CASE WHEN form = 4 THEN {end} END AS endTime, CASE WHEN n % 3 = 0 THEN struct('PRIMARY' AS platform) END AS dataSource"
    pick = lambda of: F.expr(f"CASE n % {len(POINTS)} " + " ".join(f"WHEN {i} THEN {of(*p)}" for i, p in enumerate(POINTS)) + " END")
    point = pick(lambda t, fields, *_: f"to_json(struct(struct({fields}, {inner}) AS {body_name(t)}, {outer}))")
    return e.select(pick(lambda t, *_: f"'{t}'").alias("data_type"), point.alias("point"))


def json_readings(spark: SparkSession, d: str) -> DataFrame:
    """Points of every type with an extractor, and of those that share generic fields."""
    return normalised(json_points(spark, d)).select("data_type", "start_time", "end_time", "value", "unit", "source")


def in_batch_last(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.lit("e").alias("entity_id"), F.col("event_type").alias("data_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start_time"), F.lit("PHONE").alias("source"), "value", F.col("event_id").alias("seq"))
    return _rounded(last_of_batch(rows).select("data_type", "start_time", "value"))


def incremental_load(spark: SparkSession, d: str) -> DataFrame:
    """What a second load adds when it overlaps the first by a week."""
    e = last_of_batch(_events(spark, d).withColumn("seq", F.struct("value", "raw")))
    first, second = e.filter(F.col("start_time") < F.lit(UNTIL).cast("timestamp_ntz")), e.filter(F.col("start_time") >= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return new_rows(second, first).groupBy("data_type").agg(F.count("*").alias("added"))


def sync_marks(spark: SparkSession, d: str) -> DataFrame:
    """Where the next load of each type starts, after a run on each day with events."""
    runs = _events(spark, d).select("data_type", F.date_trunc("day", "start_time").cast("timestamp_ntz").alias("last_synced_at"))
    return sync_state(runs, SINCE)


LOADS = ((datetime(2024, 1, 22), ("sleep",)), (datetime(2024, 1, 31), ("weight",)))


def _loaded(spark: SparkSession, d: str) -> tuple[list[dict[str, dict]], DataFrame]:
    """Reports and marks of two loads of the events that overlap by a week, each with a
    type that has no points; events of each hour's minute 7 have no time that can be used."""
    e = _events(spark, d).withColumn("seq", F.col("raw"))
    lost = F.minute("start_time") == 7
    e = e.withColumn("at", F.col("start_time")).withColumn("start_time", F.when(~lost, F.col("start_time")))
    bound = lambda t: F.lit(t).cast("timestamp_ntz")
    parts = e.filter(F.col("at") < bound(UNTIL)).drop("at"), e.filter(F.col("at") >= bound("2024-01-15 00:00:00")).drop("at")
    path, state = work_path(spark, "loaded"), work_path(spark, "marks")
    reports = [load(p, path, state, at, types, f"run{i}") for i, (p, (at, types)) in enumerate(zip(parts, LOADS, strict=True))]
    load(parts[1], path, state, datetime(2024, 2, 9), ("weight",), "run1")  # a batch that runs again
    return reports, marks(spark, state)


def load_report(spark: SparkSession, d: str) -> DataFrame:
    """What each load wrote of each type."""
    reports, _ = _loaded(spark, d)
    rows = [(i, t, r["written"], r["skipped"]) for i, report in enumerate(reports) for t, r in report.items()]
    return spark.createDataFrame(rows, "run int, data_type string, written long, skipped long")


def load_marks(spark: SparkSession, d: str) -> DataFrame:
    """Where the next load of each type starts after these loads."""
    return sync_state(_loaded(spark, d)[1], SINCE)


def attempts_limited(spark: SparkSession, d: str) -> DataFrame:
    """The events as attempts of their types: a stream in which ten are allowed in the
    six hours that the first one opens."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", attempts.PROVIDER)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    at = F.timestamp_diff("MICROSECOND", F.lit(datetime(1970, 1, 1)).cast("timestamp_ntz"), F.col("ts"))
    rows = attempts.limited(e.select(F.col("event_type").alias("key"), F.col("event_id").alias("id"), at.alias("at_us")), 6 * 3600)
    out = work_path(spark, "attempts")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_path(spark, "attempts-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).drop("at_us")


def data_type_list(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("data_type").distinct()


def local_days(spark: SparkSession, d: str) -> DataFrame:
    """Civil days east and west of Greenwich, daylight saving included."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, 23, 30, 0)")).alias("t"))
    return o.select("o_orderkey", local_day(F.col("t"), TZ).alias("london"), local_day(F.col("t"), "America/New_York").alias("new_york"))


def local_midnights(spark: SparkSession, d: str) -> DataFrame:
    """When each order's civil day begins, in UTC."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.select("o_orderkey", start_of_local_day(F.col("day"), TZ).alias("london"), start_of_local_day(F.col("day"), "America/New_York").alias("new_york"))


def quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Linear quantiles of each metric's days, by sorted arrays."""
    g = long_frame(_frame(spark, d, 3), ("steps", "hrv", "active_minutes")).groupBy("entity_id", "metric").agg(F.array_sort(F.collect_list("value")).alias("a"))
    return g.select("entity_id", "metric", *(_r(sorted_quantile(F.col("a"), q)).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.75, 0.9)))


def forecast_tail(spark: SparkSession, d: str) -> DataFrame:
    """The last 42 known days that each metric's forecast follows."""
    return _rounded(models.gp_history(_long(spark, d)))


def forecast_holt_winters(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(folds.forecasts(_long(spark, d)), 3)


def covariance_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Covariances and correlations of the days that have all metrics."""
    return _rounded(folds.covariances(_history(spark, d), FACTOR_METRICS).withColumn("covariance", F.col("covariance") / 1e6), 5)


def principal_axes(spark: SparkSession, d: str) -> DataFrame:
    """What SQL can check of the axes: that the values add up to the matrix, their squares
    to its squares, that each vector is one (C v = value v), and that they are orthogonal."""
    k = len(FACTOR_METRICS)
    rows = folds.axes(_history(spark, d), FACTOR_METRICS)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    left = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.abs(dot(F.slice("matrix", i * k + 1, k), F.col("vector")) - F.col("value") * F.get("vector", i)))
    each = rows.select("entity_id", "n", "value", "vector", F.array_max(left).alias("left"))
    g = each.groupBy("entity_id", "n").agg(F.sum("value").alias("trace"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.max("left").alias("residual"), F.collect_list("vector").alias("v"))
    tilt = F.array_max(F.flatten(F.transform("v", lambda x, i: F.transform("v", lambda y, j: F.abs(dot(x, y) - F.when(i == j, 1.0).otherwise(0.0))))))
    return _rounded(g.select("entity_id", "n", "trace", "squares", "residual", tilt.alias("tilt")), 6)


# --- models, whose results SQL does not express -----------------------------


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return models.clusters(_long(spark, d))


def forest(spark: SparkSession, d: str) -> DataFrame:
    return models.forest(_long(spark, d))


def gaussian_process(spark: SparkSession, d: str) -> DataFrame:
    return models.gp_forecasts(_long(spark, d))


def hidden_states(spark: SparkSession, d: str) -> DataFrame:
    return models.states(_long(spark, d))


def network(spark: SparkSession, d: str) -> DataFrame:
    return models.network(_long(spark, d))


def _insights(spark: SparkSession, d: str) -> Insights:
    """All orders as histories of three entities."""
    return Insights(from_history(spark, d), HISTORY_UNTIL, TZ, 90, HISTORY_DAYS)


def _history(spark: SparkSession, d: str) -> DataFrame:
    return day_frame(from_history(spark, d), HISTORY_UNTIL, HISTORY_DAYS, TZ)


def factors(spark: SparkSession, d: str) -> DataFrame:
    return models.factors(day_frame(from_history(spark, d), HISTORY_UNTIL, HISTORY_DAYS, TZ))


def history_frame(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(day_frame(from_history(spark, d), HISTORY_UNTIL, HISTORY_DAYS, TZ))


def findings(spark: SparkSession, d: str) -> DataFrame:
    return _insights(spark, d).findings()


def findings_relational(spark: SparkSession, d: str) -> DataFrame:
    """The findings of the layers that are relational work: readiness, anomaly, load,
    trend, weekday, drivers and the forecast of sleep. The others' plans fall away."""
    return _insights(spark, d).findings().filter("ord <= 7").select("entity_id", "ord", "id", "headline", "tone")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return _insights(spark, d).documents()


def forecast_history(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_insights(spark, d).history_with_forecast(), 3)


def states_with_factors(spark: SparkSession, d: str) -> DataFrame:
    return _insights(spark, d).states_with_factors()


def demo_frame(spark: SparkSession, d: str) -> DataFrame:
    """The generated history, which reads no table."""
    return day_frame(demo(spark, DEMO_UNTIL, 120), DEMO_UNTIL, 120, TZ)


def cluster_weekdays(spark: SparkSession, d: str) -> DataFrame:
    found = models.cluster_weekdays(models.clusters(_long(spark, d)))
    return found.select("entity_id", "cluster", "name", *(F.col(str(i)).alias(f"d{i}") for i in range(7)))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The wide day frame with the number of anomalies of each day."""
    f = _frame(spark, d)
    n = series.anomalies(f).groupBy("entity_id", "date").agg(F.count("*").alias("n_anomalies"))
    return f.join(n, ["entity_id", "date"], "left").fillna(0, ["n_anomalies"]).drop("idx")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        frame_daily, frame_daily_window, frame_entities, frame_incremental, frame_wide, frame_days_with_data, frame_long_history, end_anchor_day, source_preferred_rows, source_exists,
        bucket_hour_sum, bucket_day_avg, bucket_hour_preferred, summary_metrics, points_page, points_deep, points_cursor, points_count, artifact_flags, interpolate_gap2, interpolate_gap3, baseline,
        anomaly_days, anomaly_recent_top8, training_load, sleep_consistency, readiness_parts, readiness, decompose_days, decompose_weekdays, decompose_strength,
        correlation_pairs, line_fit, ridge_two, ridge_drivers, next_day_pairs, persistence_error, complete_cases, weekday_mix, share_of_total, anomalies_anti_join,
        history_union, json_extract, json_readings, in_batch_last, incremental_load, load_report, load_marks, attempts_limited, sync_marks, data_type_list, local_days, local_midnights, quantiles, forecast_tail, forecast_holt_winters, covariance_matrix, principal_axes, clusters, factors,
        forest, gaussian_process, hidden_states, network, demo_frame, history_frame, findings, findings_relational, documents, forecast_history, states_with_factors, cluster_weekdays,
    )
}
