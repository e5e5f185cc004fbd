"""The read queries: summary, points and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import PREFERRED_SOURCE, RAW_ALWAYS_TYPES, SUM_TYPES, SUMMARY, checked_type, int_param
from .frame import known_source

MAX_ROWS = 20_000


def in_range(readings: DataFrame, since: str | None, until: str | None) -> DataFrame:
    """Half-open range of start times; without `since` there is no bound at all."""
    if since is None:
        return readings
    rows = readings.filter(F.col("start_time") >= F.lit(since).cast("timestamp_ntz"))
    return rows.filter(F.col("start_time") < F.lit(until).cast("timestamp_ntz")) if until else rows


def deduped(rows: DataFrame, keys: list[str], preferred: str = PREFERRED_SOURCE) -> DataFrame:
    """Rows of the preferred source where a group of keys has any, else all. The
    groups come from one aggregation, a row for each, and the join splits hot ones."""
    mine = known_source(F.col("source")) == preferred
    has = rows.filter(mine).select(*keys).distinct().withColumn("_has", F.lit(True))
    return rows.join(has, keys, "left").filter(mine | F.col("_has").isNull()).drop("_has")


def buckets(readings: DataFrame, data_type: str, unit: str, since: str | None = None, until: str | None = None, dedupe: bool = False) -> DataFrame:
    """entity_id, bucket, value: sums or means for each UTC hour or day that has rows."""
    checked_type(data_type)
    if unit not in ("hour", "day") or data_type in RAW_ALWAYS_TYPES:
        raise ValueError(f"no {unit!r} buckets for {data_type}")
    rows = in_range(readings.filter(F.col("data_type") == data_type), since, until)
    agg = F.sum if data_type in SUM_TYPES else F.avg
    mine = known_source(F.col("source")) == PREFERRED_SOURCE
    g = rows.groupBy("entity_id", F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("bucket"))
    g = g.agg(agg("value").alias("value"), agg(F.when(mine, F.col("value"))).alias("_mine"), F.count_if(mine).alias("_n"))
    if dedupe:  # decided over all of an entity's buckets, which are few
        has = F.max("_n").over(Window.partitionBy("entity_id")) > 0
        g = g.withColumn("_has", has).filter(~F.col("_has") | (F.col("_n") > 0)).withColumn("value", F.when(F.col("_has"), F.col("_mine")).otherwise(F.col("value")))
    return g.select("entity_id", "bucket", "value")


def _points(readings: DataFrame, data_type: str, since: str | None, until: str | None, dedupe: bool) -> DataFrame:
    rows = in_range(readings.filter(F.col("data_type") == checked_type(data_type)), since, until)
    return deduped(rows, ["entity_id"]) if dedupe else rows



def order() -> tuple[Column, ...]:
    """The order of readings, newest first; the key makes it total but for repeated rows."""
    return F.desc("start_time"), F.asc("entity_id"), F.asc("source"), F.desc_nulls_last("value")


#: Ranges of time in which a deep page is looked for, one within the other, and how many
#: rows more than a page needs no finer look.
RANGES, SPARE = ("month", "day", "hour", "minute"), 50_000


def _narrowed(rows: DataFrame, skip: int, limit: int) -> tuple[DataFrame, int]:
    """The rows among which a page lies that begins after `skip` rows, and how many of
    those come before it. Counts of ever finer ranges of time, each within the last,
    lead there; only its own ranges are read for the page."""
    within = rows
    for unit in RANGES:
        n = within.groupBy(F.date_trunc(unit, "start_time").cast("timestamp_ntz").alias("at")).agg(F.count("*").alias("n"))
        # a row for each range that the last step left: months, then days of some, ...
        n = n.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("at"))))
        hit = n.filter((F.col("upto") > skip) & (F.col("upto") - F.col("n") < skip + limit))
        low, high, before, held = hit.agg(F.min("at"), F.max("at"), F.min(F.col("upto") - F.col("n")), F.sum("n")).first()
        if low is None:
            return rows.filter("false"), 0
        step = F.expr(f"INTERVAL '1' {unit}")
        within = within.filter((F.col("start_time") >= F.lit(low)) & (F.col("start_time") < F.lit(high) + step))
        skip -= before
        if held <= limit + SPARE:
            break
    return within, skip


def _columns(raw: bool) -> list[str]:
    return ["entity_id", "data_type", "start_time", "end_time", "value", "unit", "source"] + ["raw"] * raw


def points(readings: DataFrame, data_type: str, since: str | None = None, until: str | None = None, page: object = 0, limit: object = 100, raw: bool = False, dedupe: bool = False) -> DataFrame:
    """One page of readings, the newest first; ties by entity and source. Pages but the
    first are looked up by counts, so that no task sorts what comes before them."""
    limit, page = int_param(limit, 100, 1, MAX_ROWS), int_param(page, 0, 0, 10_000)
    rows, skip = _points(readings, data_type, since, until, dedupe), page * limit
    if skip:
        rows, skip = _narrowed(rows, skip, limit)
    rows = rows.select(*_columns(raw)).orderBy(*order())
    return (rows.offset(skip) if skip else rows).limit(limit)


def points_after(readings: DataFrame, data_type: str, cursor: tuple | None = None, since: str | None = None, until: str | None = None, limit: object = 100, raw: bool = False, dedupe: bool = False) -> DataFrame:
    """The readings that follow a cursor, the (start_time, entity_id, source) of the last
    one seen; the first ones without one. The cursor bounds the scan, so any page costs
    as much as the first."""
    rows = _points(readings, data_type, since, until, dedupe)
    if cursor:
        at, entity, source = (F.lit(x) for x in cursor)
        tie = (F.col("entity_id") > entity) | ((F.col("entity_id") == entity) & (F.col("source") > source))
        rows = rows.filter((F.col("start_time") <= at) & ((F.col("start_time") < at) | tie))
    return rows.select(*_columns(raw)).orderBy(*order()).limit(int_param(limit, 100, 1, MAX_ROWS))


def points_total(readings: DataFrame, data_type: str, since: str | None = None, until: str | None = None, dedupe: bool = False) -> DataFrame:
    rows = _points(readings, data_type, since, until, False)
    if not dedupe:
        return rows.agg(F.count("*").alias("total"))
    mine = F.count_if(known_source(F.col("source")) == PREFERRED_SOURCE)
    g = rows.groupBy("entity_id").agg(F.count("*").alias("n"), mine.alias("mine"))
    return g.agg(F.coalesce(F.sum(F.when(F.col("mine") > 0, F.col("mine")).otherwise(F.col("n"))), F.lit(0)).alias("total"))


def summary(readings: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """entity_id, metric, value, at: all summary metrics by one aggregation. Sums
    count the preferred source alone where the whole window has it; latest takes
    the newest reading, also one without a value."""
    types = [t for _, t, _, _ in SUMMARY]
    rows = in_range(readings.filter(F.col("data_type").isin(*types)), since, until).withColumn("source", known_source(F.col("source")))
    mine = F.col("source") == PREFERRED_SOURCE
    newest = lambda c: F.max(F.when(c, F.struct("start_time", "source", "value")))
    g = rows.groupBy("entity_id", "data_type").agg(
        F.bool_or(mine).alias("has"), F.sum("value").alias("s"), F.sum(F.when(mine, F.col("value"))).alias("ps"), newest(F.lit(True)).alias("l"), newest(mine).alias("pl")
    )
    spec = F.array(*(F.struct(F.lit(n).alias("metric"), F.lit(t).alias("type"), F.lit(m).alias("mode"), F.lit(float(d)).alias("by")) for n, t, m, d in SUMMARY))
    g = g.withColumn("spec", F.explode(F.filter(spec, lambda s: s["type"] == F.col("data_type"))))
    total, last = F.when(F.col("has"), F.col("ps")).otherwise(F.col("s")), F.when(F.col("has"), F.col("pl")).otherwise(F.col("l"))
    is_sum = F.col("spec.mode") == "sum"
    return g.select("entity_id", "spec.metric", F.when(is_sum, total / F.col("spec.by")).otherwise(last["value"]).alias("value"), F.when(~is_sum, last["start_time"]).alias("at"))
