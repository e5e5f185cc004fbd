"""The reading schema, tables of readings, and JSON pages turned into readings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import DATA_TYPES, UNKNOWN_SOURCE

READING_SCHEMA = T.StructType(
    [
        T.StructField("entity_id", T.StringType(), False),
        T.StructField("data_type", T.StringType(), False),
        T.StructField("start_time", T.TimestampNTZType(), False),
        T.StructField("end_time", T.TimestampNTZType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("raw", T.StringType()),
    ]
)
KEY = ("entity_id", "data_type", "start_time", "source")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir;
    where that's unset and all runs in one process, in a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{found.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table of readings; older rows without a source get the unknown one."""
    return spark.read.schema(READING_SCHEMA).parquet(path).withColumn("source", F.coalesce("source", F.lit(UNKNOWN_SOURCE)))


def write_table(readings: DataFrame, path: str, mode: str = "append", observed: Callable[[DataFrame], DataFrame] = lambda df: df, dynamic: bool = False) -> None:
    """Partitioned by type and sorted by time, so that both prune a scan. Ranges of
    type, time and entity are dealt out evenly, however many rows a type or day has.
    `observed` may count rows: after the ranges, which read theirs a first time. An
    overwrite that is dynamic leaves the partitions that it has no rows for."""
    rows = observed(readings.repartitionByRange("data_type", "start_time", "entity_id")).sortWithinPartitions("data_type", "start_time")
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy("data_type").parquet(path)


def replace_source(spark: SparkSession, path: str, source: str, rows: DataFrame, out: str) -> None:
    """The table at `path` without a source's rows, with `rows` instead, written to `out`."""
    write_table(read_table(spark, path).filter(F.col("source") != source).unionByName(rows), out, "overwrite")


def has_data(readings: DataFrame) -> bool:
    return not readings.isEmpty()


# --- JSON ------------------------------------------------------------------

#: Where the value of each type is, its unit, and a divisor.
EXTRACTORS = {
    "heart-rate": (("beatsPerMinute",), "bpm", 1.0),
    "daily-resting-heart-rate": (("beatsPerMinute",), "bpm", 1.0),
    "heart-rate-variability": (("rootMeanSquareOfSuccessiveDifferencesMilliseconds",), "ms", 1.0),
    "daily-heart-rate-variability": (("rootMeanSquareOfSuccessiveDifferencesMilliseconds",), "ms", 1.0),
    "oxygen-saturation": (("percentage",), "%", 1.0),
    "daily-oxygen-saturation": (("percentage",), "%", 1.0),
    "steps": (("count",), "count", 1.0),
    "distance": (("millimeters",), "m", 1000.0),
    "height": (("heightMillimeters",), "m", 1000.0),
    "weight": (("weightKilograms", "kilograms"), "kg", 1.0),
    "body-fat": (("percentage",), "%", 1.0),
    "active-energy-burned": (("kcal",), "kcal", 1.0),
    "active-zone-minutes": (("activeZoneMinutes",), "min", 1.0),
    "swim-lengths-data": (("strokeCount",), "count", 1.0),
    "sleep": (("summary.minutesAsleep",), "min", 1.0),
    "exercise": (("metricsSummary.caloriesKcal",), "kcal", 1.0),
}
#: Generic fields, tried in this order where the type gives nothing.
FALLBACKS = (("beatsPerMinute", "bpm"), ("count", "count"), ("kilograms", "kg"), ("percentage", "%"), ("meters", "m"))
INTERVAL_VALUED = ("sedentary-period", "time-in-heart-rate-zone")


def number(text: Column) -> Column:
    """A finite double, or null."""
    n = text.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n)


def body_name(data_type: str) -> str:
    head, *rest = data_type.split("-")
    return head + "".join(w.capitalize() for w in rest)


def instant(text: Column) -> Column:
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def normalised(points: DataFrame, column: str = "point", data_type: str = "data_type") -> DataFrame:
    """JSON points with their type as readings without an entity; start_time is null
    where none is usable. Run with the session's time zone set to UTC. A point is parsed
    once, to a variant from which all fields come.

    The first time that is there counts, in the order interval, sample, civil date,
    point interval, point start; one that can't be read is not replaced by a later."""
    kind = F.col(data_type)
    within = lambda v, path, to="string": F.try_variant_get(F.col(v), f"$.{path}", to)
    at = lambda path: within("_body", path)
    body = reduce(lambda c, t: c.when(kind == t, within("_point", body_name(t), "variant")), DATA_TYPES, F.when(F.lit(False), F.lit(None).cast("variant")))
    rows = points.withColumn("_point", F.try_parse_json(column)).withColumn("_body", body)
    date = F.when(at("date.year").isNotNull(), F.format_string("%04d-%02d-%02dT00:00:00Z", *(F.coalesce(at(f"date.{k}").try_cast("int"), F.lit(0)) for k in ("year", "month", "day"))))
    start = F.coalesce(at("interval.startTime"), at("sampleTime.physicalTime"), date, within("_point", "interval.startTime"), within("_point", "startTime"))
    end = F.coalesce(at("interval.endTime"), within("_point", "interval.endTime"), within("_point", "endTime"))
    rows = rows.withColumn("start_time", instant(start)).withColumn("end_time", instant(end))
    levels = within("_body", "activeMinutesByActivityLevel", "array<struct<activeMinutes:string>>")
    broken = F.exists(levels, lambda x: x["activeMinutes"].isNotNull() & number(x["activeMinutes"]).isNull())
    active = F.when((F.size(levels) > 0) & ~broken, F.aggregate(levels, F.lit(0.0), lambda s, x: s + F.coalesce(number(x["activeMinutes"]), F.lit(0.0))))
    minutes = F.timestamp_diff("SECOND", F.col("start_time"), F.col("end_time")) / 60.0
    value, unit = F.when(kind == "active-minutes", active).when(kind.isin(*INTERVAL_VALUED), minutes), F.when(kind.isin("active-minutes", *INTERVAL_VALUED), F.lit("min"))
    for t, (paths, u, by) in EXTRACTORS.items():
        value, unit = value.when(kind == t, F.coalesce(*(number(at(x)) for x in paths)) / by), unit.when(kind == t, F.lit(u))
    generic = F.coalesce(*(F.when(number(at(f)).isNotNull(), F.struct(number(at(f)).alias("v"), F.lit(u).alias("u"))) for f, u in FALLBACKS))
    rows = rows.withColumn("_value", value).withColumn("_unit", unit).withColumn("_generic", generic)
    typed = F.col("_value").isNotNull()
    source = F.coalesce(within("_point", "dataSource.platform"), F.lit(UNKNOWN_SOURCE))
    kept = [c for c in points.columns if c not in (column, data_type)]
    return rows.select(*kept, kind.alias("data_type"), "start_time", "end_time", F.when(typed, F.col("_value")).otherwise(F.col("_generic.v")).alias("value"), F.when(typed, F.col("_unit")).otherwise(F.col("_generic.u")).alias("unit"), source.alias("source"), F.col(column).alias("raw"))


def page_points(pages: DataFrame, body: str = "body", outer: bool = False) -> DataFrame:
    """A row for each point of JSON pages, with its place (seq); if outer, a row
    without a point for a page that has none."""
    points = F.from_json(F.get_json_object(F.col(body), "$.dataPoints"), "array<string>")
    kept = [c for c in pages.columns if c != body]
    return pages.select(*kept, (F.posexplode_outer if outer else F.posexplode)(points).alias("seq", "point"))


def split_usable(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings with a start time, and how many of each type had none."""
    return readings.filter("start_time IS NOT NULL"), readings.filter("start_time IS NULL").groupBy("data_type").agg(F.count("*").alias("skipped"))
