"""The day frame as a table that follows its readings.

The table holds `daily` rows, partitioned by day. After a load only the days it touched
are computed again, and for these only the entities it touched: `changed` says which
(entity, day) they are, the readings are read within those days' times, the rest of a
day's partition is kept as it is, and dynamic overwrite puts the partitions in place.
Days that nothing touched keep their files. A refresh that runs again gives the same
table, so it may follow each micro-batch.

A day that loses all its rows keeps a mark (n = 0) in its partition, as an overwrite of
partitions can't take one away; `frame_rows` leaves marks out."""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import anchor, daily, local_day
from ..registry import END_ANCHORED, PREFERRED_SOURCE
from ..sources.readings import read_table, write_table

SCHEMA = "entity_id string, data_type string, total double, avg double, n long, day date"
COLUMNS = ("entity_id", "data_type", "total", "avg", "n", "day")


def changed(rows: DataFrame, tz: str) -> DataFrame:
    """entity_id, day of readings: what to compute again when they are added."""
    return rows.filter("start_time IS NOT NULL").select("entity_id", local_day(anchor(), tz).alias("day")).distinct()


def frame_rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's `daily` rows; none before the first refresh."""
    try:
        return spark.read.schema(SCHEMA).parquet(path).filter("n > 0").select(*COLUMNS)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA).select(*COLUMNS)


def _near(low, high):  # noqa: ANN001, ANN202
    """Readings that may belong to local days from low to high: by their start, or, of
    types that count where they end, by either end."""
    first, last = (F.lit(d).cast("timestamp_ntz") for d in (low - timedelta(1), high + timedelta(2)))
    ends = F.col("data_type").isin(*END_ANCHORED)
    by_start = F.col("start_time").between(first, last)
    return (~ends & by_start) | (ends & (F.col("start_time") <= last) & (F.coalesce("end_time", "start_time") >= first))


def refresh(spark: SparkSession, readings: str, path: str, touched: DataFrame, tz: str, preferred: str = PREFERRED_SOURCE) -> list:
    """Computes the touched (entity_id, day) anew from the table of readings and puts
    their days' partitions in place. Gives the days, of which a history has few."""
    touched = touched.persist()
    try:
        days = sorted(r["day"] for r in touched.select("day").distinct().collect())
        if not days:
            return []
        rows = read_table(spark, readings).filter(_near(days[0], days[-1])).withColumn("_day", local_day(anchor(), tz))
        own = rows.join(touched.withColumnRenamed("day", "_day"), ["entity_id", "_day"], "left_semi").drop("_day")
        new = daily(own, tz, preferred=preferred).select(*COLUMNS)
        kept = frame_rows(spark, path).filter(F.col("day").isin(*days)).join(touched, ["entity_id", "day"], "left_anti").select(*COLUMNS)
        marks = spark.createDataFrame([("", "", None, None, 0, d) for d in days], SCHEMA).select(*COLUMNS)
        out = new.unionByName(kept).unionByName(marks)
        # a day's rows go to as many files as range partitioning gives them
        out.repartitionByRange("day", "entity_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        return days
    finally:
        touched.unpersist()


def replace_in_place(spark: SparkSession, readings: str, source: str, rows: DataFrame) -> list[str]:
    """Puts rows in the place of a source's readings, in the table itself: partitions of
    the types that either has are written anew, others keep their files. Gives these types.
    Touched days of a frame are `changed` of the old and of the new rows."""
    table = read_table(spark, readings)
    types = sorted({r[0] for df in (table.filter(F.col("source") == source), rows) for r in df.select("data_type").distinct().collect()})
    kept = table.filter(F.col("data_type").isin(*types) & (F.col("source") != source))
    out = kept.unionByName(rows.select(*kept.columns)).persist()
    try:
        left = {r[0] for r in out.select("data_type").distinct().collect()}
        write_table(out, readings, "overwrite", dynamic=True)
    finally:
        out.unpersist()
    for t in set(types) - left:  # nothing is left to overwrite these with
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{readings}/data_type={t}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return types
