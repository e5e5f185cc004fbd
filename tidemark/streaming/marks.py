"""Marks: up to when each type was loaded, kept so that a crash loses none.

The marks lie in two slots that take turns. A commit reads the newest whole version,
puts the batch's types in, and overwrites the older slot by a single file; until that
file is there the other slot is the newest, so a crash leaves the marks as they were.
Both slots together are one row for each type, twice, whatever the number of loads.

A version names the batch that wrote it. A batch that is run again finds its name and
changes nothing, so that a mark follows the first run's start, as the data do."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "data_type string, last_synced_at timestamp_ntz, batch string, version long"


def _rows(spark: SparkSession, path: str) -> list:
    """The rows of the newest version, of which there are as many as types."""
    found = []
    for slot in (0, 1):
        try:
            found.append(spark.read.schema(SCHEMA).parquet(f"{path}/slot{slot}").collect())
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return max((rows for rows in found if rows), key=lambda rows: rows[0]["version"], default=[])


def marks(spark: SparkSession, path: str) -> DataFrame:
    """data_type, last_synced_at, batch, version as last committed."""
    return spark.createDataFrame([tuple(r) for r in _rows(spark, path)], SCHEMA)


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    """Whether a batch moved the marks already."""
    return any(r["batch"] == batch for r in _rows(spark, path))


def commit(spark: SparkSession, path: str, types: Iterable[str], at: datetime, batch: str) -> bool:
    """Moves the marks of types to `at`, in one write, unless the batch did so before;
    other types keep theirs. Called when the batch's data are written."""
    old = {r["data_type"]: tuple(r) for r in _rows(spark, path)}
    if any(r[2] == batch for r in old.values()):
        return False
    version = 1 + max((r[3] for r in old.values()), default=0)
    new = {t: (t, m, b, version) for t, (_, m, b, _) in old.items()} | {t: (t, at, batch, version) for t in types}
    if new:
        rows = spark.createDataFrame(sorted(new.values(), key=lambda r: r[0]), SCHEMA)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/slot{version % 2}")
    return True


def starts(known: DataFrame, default: str, types: Iterable[str]) -> DataFrame:
    """data_type, last_synced_at: where the next load of each type starts: its mark, or
    the default before the first. known: data_type, last_synced_at, one or more a type."""
    every = known.sparkSession.createDataFrame([(t,) for t in types], "data_type string")
    last = known.groupBy("data_type").agg(F.max("last_synced_at").alias("last_synced_at"))
    mark = F.coalesce("last_synced_at", F.lit(default).cast("timestamp_ntz"))
    return every.join(F.broadcast(last), "data_type", "left").select("data_type", mark.alias("last_synced_at"))
