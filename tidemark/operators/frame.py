"""From tall readings to the day frame: source preference, local days, dense
calendar, one column a metric.

The preference for a source is decided for each (entity, type, day). It needs no
window: sums with and without the preferred source come from one aggregation,
which combines map-side, so that a hot day or entity moves a few rows a task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import END_ANCHORED, METRICS, PREFERRED_SOURCE, UNKNOWN_SOURCE


def known_source(source: Column) -> Column:
    return F.coalesce(source, F.lit(UNKNOWN_SOURCE))


def local_day(ts: Column, tz: str) -> Column:
    """The civil date at tz of a zone-less UTC time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def start_of_local_day(day: Column, tz: str) -> Column:
    """The zone-less UTC time at which a civil date begins at tz."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), day.cast("timestamp_ntz"))


def anchor() -> Column:
    """The time that places a reading in a day: sleep counts where it ends."""
    return F.when(F.col("data_type").isin(*END_ANCHORED), F.coalesce("end_time", "start_time")).otherwise(F.col("start_time"))


def scoped(readings: DataFrame, tz: str, types: list[str] | None = None) -> DataFrame:
    """entity_id, data_type, day, value, source of readings with a value."""
    rows = readings.filter(F.col("value").isNotNull())
    if types:
        rows = rows.filter(F.col("data_type").isin(*types))
    return rows.select("entity_id", "data_type", local_day(anchor(), tz).alias("day"), "value", known_source(F.col("source")).alias("source"))


def daily(readings: DataFrame, tz: str, types: list[str] | None = None, preferred: str = PREFERRED_SOURCE) -> DataFrame:
    """entity_id, data_type, day, total, avg, n by one aggregation."""
    mine = F.when(F.col("source") == preferred, F.col("value"))
    g = scoped(readings, tz, types).groupBy("entity_id", "data_type", "day")
    g = g.agg(F.sum("value").alias("s"), F.count("*").alias("c"), F.sum(mine).alias("ps"), F.count(mine).alias("pc"))
    total, n = F.when(F.col("pc") > 0, F.col("ps")).otherwise(F.col("s")), F.when(F.col("pc") > 0, F.col("pc")).otherwise(F.col("c"))
    return g.select("entity_id", "data_type", "day", total.alias("total"), (total / n).alias("avg"), n.alias("n"))


def daily_by_window(readings: DataFrame, tz: str, types: list[str] | None = None, preferred: str = PREFERRED_SOURCE) -> DataFrame:
    """The same by a window over each day; kept to check the other against."""
    w = Window.partitionBy("entity_id", "data_type", "day")
    rows = scoped(readings, tz, types).withColumn("has", F.bool_or(F.col("source") == preferred).over(w))
    rows = rows.filter(~F.col("has") | (F.col("source") == preferred))
    return rows.groupBy("entity_id", "data_type", "day").agg(F.sum("value").alias("total"), F.avg("value").alias("avg"), F.count("*").alias("n"))


def calendar(entities: DataFrame, until: str, days: int) -> DataFrame:
    """entity_id, date, idx, weekday (Monday 0): the days up to `until`, all there."""
    last = F.to_date(F.lit(until))
    rows = entities.select("entity_id", F.posexplode(F.sequence(F.date_sub(last, days - 1), last)).alias("idx", "date"))
    return rows.withColumn("weekday", F.weekday("date"))


def day_frame(readings: DataFrame, until: str, days: int, tz: str, preferred: str = PREFERRED_SOURCE) -> DataFrame:
    """entity_id, date, idx, weekday and a nullable column for each metric."""
    types = [m.data_type for m in METRICS]
    wide = daily(readings, tz, types, preferred).groupBy("entity_id", F.col("day").alias("date"))
    wide = wide.agg(*(F.max(F.when(F.col("data_type") == m.data_type, F.col("total" if m.agg == "total" else "avg"))).alias(m.name) for m in METRICS))
    entities = readings.select("entity_id").distinct()
    return calendar(entities, until, days).join(wide, ["entity_id", "date"], "left")


def long_frame(frame: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """entity_id, date, idx, weekday, metric, value: a row for each cell, nulls too."""
    return frame.unpivot(["entity_id", "date", "idx", "weekday"], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def days_with_data(frame: DataFrame) -> DataFrame:
    some = reduce(lambda a, b: a | b, (F.col(m.name).isNotNull() for m in METRICS))
    return frame.groupBy("entity_id").agg(F.count_if(some).alias("days"))
