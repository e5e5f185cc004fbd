"""Readings made of the test tables: events, orders, and order lines as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Which reading type stands for each event type, and for each order priority.
EVENT_TYPES = {"view": "steps", "click": "active-minutes", "purchase": "active-energy-burned", "signup": "heart-rate-variability", "error": "daily-resting-heart-rate"}
PRIORITY_TYPES = {"1-URGENT": "heart-rate-variability", "2-HIGH": "daily-resting-heart-rate", "3-MEDIUM": "sleep", "4-NOT SPECIFIED": "active-minutes", "5-LOW": "steps"}


def _mapped(column: str, names: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col(column)]


def from_events(spark: SparkSession, sf_dir: str, entities: int = 1) -> DataFrame:
    """Users are spread over `entities`; every third user's source is preferred."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("e"), (F.col("user_id") % entities).cast("string")).alias("entity_id"), _mapped("event_type", EVENT_TYPES).alias("data_type"), F.col("ts").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"), "value", F.lit(None).cast("string").alias("unit"),
        F.when(F.col("user_id") % 3 == 0, "PRIMARY").otherwise("PHONE").alias("source"), F.col("props").alias("raw"),
    )


def from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long history of one entity, without preferred sources."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.lit("o").alias("entity_id"), _mapped("o_orderpriority", PRIORITY_TYPES).alias("data_type"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"), F.lit(None).cast("timestamp_ntz").alias("end_time"),
        F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("PHONE").alias("source"), F.lit(None).cast("string").alias("raw"),
    )


#: Which reading type stands for each seventh of the orders.
SEVENTHS = ("heart-rate-variability", "daily-resting-heart-rate", "sleep", "active-minutes", "steps", "active-energy-burned", "oxygen-saturation")
HISTORY_UNTIL, HISTORY_DAYS = "2024-06-30", 120


def from_history(spark: SparkSession, sf_dir: str, entities: int = 3) -> DataFrame:
    """Orders as dense histories of a few entities: the order's key gives its day
    and type, the customer the entity and, every third time, the preferred source."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day, kind = F.col("o_orderkey") % HISTORY_DAYS, (F.floor(F.col("o_orderkey") / HISTORY_DAYS) % len(SEVENTHS)).cast("int")
    at = (F.date_sub(F.to_date(F.lit(HISTORY_UNTIL)), day.cast("int")).cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")).cast("timestamp_ntz")
    return o.select(
        F.concat(F.lit("h"), (F.col("o_custkey") % entities).cast("string")).alias("entity_id"), F.get(F.array(*map(F.lit, SEVENTHS)), kind).alias("data_type"), at.alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("end_time"), F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("unit"),
        F.when(F.col("o_custkey") % 3 == 0, "PRIMARY").otherwise("PHONE").alias("source"), F.lit(None).cast("string").alias("raw"),
    )


def from_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as sleep from the order's day to the shipping day."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_quantity")
    j = i.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.lit("l").alias("entity_id"), F.lit("sleep").alias("data_type"), F.col("o_orderdate").cast("timestamp_ntz").alias("start_time"), F.col("l_shipdate").cast("timestamp_ntz").alias("end_time"),
        F.col("l_quantity").alias("value"), F.lit("min").alias("unit"), F.lit("PHONE").alias("source"), F.lit(None).cast("string").alias("raw"),
    )
