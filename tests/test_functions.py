"""Formats, SQL functions, table upkeep, added layers."""

from datetime import date, datetime, time
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.sql import register
from tidemark.functions.stats import sorted_quantile
from tidemark.functions.text import camel, human_date, listed, shown
from tidemark.operators.frame import start_of_local_day
from tidemark.plans.insights import EXTRA, Insights, register_layer
from tidemark.sources.readings import READING_SCHEMA, has_data, read_table, replace_source, write_table


def test_sql_functions(spark):
    assert set(register(spark)) == {"array_median", "array_mad", "ewma", "readiness_band"}
    r = spark.sql("SELECT array_median(array(3D, 1D, 2D)) a, array_median(CAST(array() AS ARRAY<DOUBLE>)) b, array_mad(array(1D, 2D, 4D, 9D)) c, ewma(array(1D, 2D, 3D), 7) d, readiness_band(60D) e, array_mad(array(1D)) f").first()
    assert (r.a, r.b, r.e, r.f) == (2.0, None, "steady", None)
    assert abs(r.c - 1.4826 * 1.5) < 1e-9 and abs(r.d - (1.25 + 0.25 * (3 - 1.25))) < 1e-9


def test_formats(spark):
    df = spark.createDataFrame([(431.6, True), (59.7, True), (12345.6, False), (3.14159, False)], "v double, s boolean")
    assert [r[0] for r in df.select(shown(F.col("v"), F.col("s"))).collect()] == ["7h 12m", "1h 00m", "12,346", "3.1"]
    one = spark.createDataFrame([(["a", "b", "c"], ["a"], date(2024, 9, 29), "daily-vo2-max")], "x array<string>, y array<string>, d date, k string")
    assert tuple(one.select(listed(F.col("x")), listed(F.col("y")), human_date(F.col("d")), camel(F.col("k"))).first()) == ("a, b and c", "a", "29 Sep", "dailyVo2Max")


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.75, 1.0])
def test_quantiles_against_numpy(spark, q):
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.normal(size=n).tolist()),) for n in (1, 2, 5, 10)] + [([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<double>").select(sorted_quantile(F.col("a"), q)).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([np.quantile(r[0], q) for r in rows[:-1]])


def test_local_midnights(spark):
    days = [date(2024, 3, 30), date(2024, 3, 31), date(2024, 4, 1), date(2024, 10, 27), date(2024, 10, 28)]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d date").select(start_of_local_day(F.col("d"), "Europe/London")).collect()]
    assert got == [datetime.combine(d, time(), ZoneInfo("Europe/London")).astimezone(ZoneInfo("UTC")).replace(tzinfo=None) for d in days]


def test_replace_source(spark, tmp_path):
    row = lambda v, s: ("me", "steps", datetime(2024, 1, 1, int(v)), None, v, None, s, None)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write_table(spark.createDataFrame([row(1.0, "DEMO"), row(2.0, "PHONE")], READING_SCHEMA), a)
    replace_source(spark, a, "DEMO", spark.createDataFrame([row(3.0, "DEMO")], READING_SCHEMA), b)
    rows = read_table(spark, b)
    assert {(r["value"], r["source"]) for r in rows.collect()} == {(2.0, "PHONE"), (3.0, "DEMO")}
    assert has_data(rows) and not has_data(rows.limit(0))


def test_added_layer(spark):
    register_layer("rows", lambda f: f.groupBy("entity_id").count(), deep=True)
    try:
        r = spark.createDataFrame([("me", "steps", datetime(2024, 1, 1), None, 1.0, None, "A", None)], READING_SCHEMA)
        assert Insights(r, "2024-01-10", "UTC").layers["rows"].first()["count"] == 365
    finally:
        EXTRA.clear()
