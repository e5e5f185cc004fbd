"""Idempotent incremental loads: JSON pages become readings in a table.

Within a batch the last record of a key wins; against the table the first one that
was written wins. A load is one pass whatever the number of types: one aggregation for
the batch's ranges and skipped rows, then one write of what the table lacks, read for
the keys of the batch's types, each in its own range of times only, so that partitions
and row groups prune the look-up. What was written of each type is observed by the write
itself. The anti-join keeps duplicates out for any lateness, as a watermark alone would
not; marks are committed after the data (see `marks`)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import DATA_TYPES, SYNCABLE_TYPES
from ..sources.pages import register
from ..sources.readings import KEY, READING_SCHEMA, normalised, page_points, read_table, write_table
from .marks import commit, marks, starts


def last_of_batch(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row for each key: the one that came last."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", order)


def new_rows(batch: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of the batch whose key the table lacks."""
    return batch.join(table.select(*KEY), list(KEY), "left_anti")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None before the first load."""
    try:
        return read_table(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _lacking(rows: DataFrame, path: str, ranges: dict[str, tuple[datetime, datetime]]) -> DataFrame:
    """The rows whose key the table lacks; it's read within each type's range."""
    table = _table(rows.sparkSession, path)
    if table is None:
        return rows
    within = [(F.col("data_type") == t) & F.col("start_time").between(F.lit(low), F.lit(high)) for t, (low, high) in ranges.items()]
    return new_rows(rows, table.filter(reduce(Column.__or__, within, F.lit(False))))


def load(batch: DataFrame, path: str, state: str | None = None, started: datetime | None = None, requested: Iterable[str] = (), key: str | None = None) -> dict[str, dict]:
    """Adds a batch of readings (with seq, and error where a type's source failed) to the
    table: {type: {written, skipped}} for the types requested and those in the batch, or
    {type: {error}} for one that failed; what came of it before is loaded all the same.

    Where `state` names marks, the time at which the run started becomes the mark of
    each type without an error, also of one that had no points, unless the batch named
    `key` moved them before. Types that the registry doesn't know are errors."""
    spark = batch.sparkSession
    started = started or datetime.now(timezone.utc).replace(tzinfo=None)
    if "error" not in batch.columns:
        batch = batch.withColumn("error", F.lit(None).cast("string"))
    usable = F.col("start_time").isNotNull() & F.col("error").isNull() & F.col("data_type").isin(*DATA_TYPES)
    skipped = F.count_if(F.col("start_time").isNull() & F.col("error").isNull() & F.col("seq").isNotNull())
    bounds = [f(F.when(usable, F.col("start_time"))).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))]
    report: dict[str, dict] = {t: {"written": 0, "skipped": 0} for t in requested}
    ranges: dict[str, tuple[datetime, datetime]] = {}
    for r in batch.groupBy("data_type").agg(*bounds, skipped.alias("skipped"), F.min("error").alias("error")).collect():  # a row for each type
        t = r["data_type"]
        error = r["error"] if t in DATA_TYPES else f"unknown data type: {t!r}"
        report[t] = {"error": error} if error else {"written": 0, "skipped": r["skipped"]}
        if r["low"] is not None:
            ranges[t] = (r["low"], r["high"])
    if ranges:
        rows = _lacking(last_of_batch(batch.filter(usable).drop("error")), path, ranges)
        seen = Observation()
        counts = [F.count_if(F.col("data_type") == t).alias(t) for t in ranges]
        write_table(rows.select(*READING_SCHEMA.names), path, observed=lambda df: df.observe(seen, *counts))
        for t, n in seen.get.items():
            if "error" not in report[t]:
                report[t]["written"] = n
    if state:
        commit(spark, state, [t for t, r in report.items() if "error" not in r], started, key or uuid.uuid4().hex)
    return report


def sync_state(runs: DataFrame, default: str, types: tuple[str, ...] = SYNCABLE_TYPES) -> DataFrame:
    """data_type, last_synced_at: where the next load of each type starts (marks.starts)."""
    return starts(runs, default, types)


def _batches(rows: DataFrame, path: str, checkpoint: str, report: Callable[[dict], None] | None, state: str | None, started: datetime | None, requested: Iterable[str]):  # noqa: ANN202
    """Starts the query that loads each micro-batch; a batch is named by its checkpoint
    and number, so one that runs again after a crash changes nothing it did before."""

    def batch(df: DataFrame, n: int) -> None:
        begun = started or datetime.now(timezone.utc).replace(tzinfo=None)
        df = df.persist()  # read for the ranges and for the write
        try:
            done = load(df, path, state, begun, requested, f"{checkpoint}#{n}")
        finally:
            df.unpersist()
        if report:
            report(done)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pages(spark: SparkSession, pages: str, path: str, checkpoint: str, lateness: str | None = None, report: Callable[[dict], None] | None = None, state: str | None = None):  # noqa: ANN201
    """Starts a query that loads JSON page files (entity_id, data_type, body) and
    stops when it has seen all. A restart goes on from its checkpoint, and a batch
    that ran twice adds nothing. A page without points moves its type's mark too."""
    source = spark.readStream.schema("entity_id string, data_type string, page string, body string").json(pages)
    points = page_points(source, outer=True).withColumn("seq", F.when(F.col("point").isNotNull(), F.concat_ws("/", "page", F.format_string("%08d", "seq"))))
    rows = normalised(points.drop("page"))
    if lateness:
        rows = rows.withWatermark("start_time", lateness).dropDuplicatesWithinWatermark([*KEY])
    return _batches(rows, path, checkpoint, report, state, None, ())


def stream_service(spark: SparkSession, root: str, entity: str, path: str, checkpoint: str, since: str, until: str, types: Iterable[str] = SYNCABLE_TYPES, state: str | None = None, report: Callable[[dict], None] | None = None, errors: str = "report"):  # noqa: ANN201
    """Starts a query that fetches what a paged service has of each type from its mark
    up to `until`, loads it and stops. A restart goes on type by type: from the
    checkpoint's offsets, in which a batch that didn't end is fetched again; a new
    checkpoint starts from the marks. Every type requested gets its mark, `until`."""
    register(spark)
    kept = list(types)
    known = {r["data_type"]: r["last_synced_at"].isoformat() for r in marks(spark, state).collect()} if state else {}
    options = {"root": root, "since": since, "until": until, "types": ",".join(kept), "marks": json.dumps(known), "errors": errors}
    points = spark.readStream.format("pages").options(**options).load().drop("since", "until")
    rows = normalised(points.withColumn("entity_id", F.lit(entity)))
    return _batches(rows, path, checkpoint, report, state, datetime.fromisoformat(until), kept)


def bucket_stream(readings: DataFrame, width: str = "1 hour", lateness: str = "0 seconds") -> DataFrame:
    """Sums and counts for each tumbling window of a stream of readings."""
    rows = readings.withColumn("at", F.col("start_time").cast("timestamp")).withWatermark("at", lateness)
    return rows.groupBy(F.window("at", width).alias("w"), "entity_id", "data_type").agg(F.sum("value").alias("total"), F.count("*").alias("n")).select("entity_id", "data_type", F.col("w.start").alias("bucket"), "total", "n")
