"""Day frames: civil days, sources, end anchors, gaps."""

from datetime import date, datetime

import pytest

from tidemark.functions.stats import interpolated
from tidemark.operators.frame import daily, daily_by_window, day_frame
from tidemark.operators.reads import buckets, points, points_total, summary
from tidemark.registry import bucket_for, checked_type, int_param, time_filter
from tidemark.sources.readings import READING_SCHEMA

T = datetime


def readings(spark, rows):
    return spark.createDataFrame([("me", k, s, e, v, None, src, None) for k, s, e, v, src in rows], READING_SCHEMA)


def test_calendar_is_dense_over_the_autumn_change(spark):
    r = readings(spark, [("steps", T(2026, 10, 25, 0, 30), None, 5.0, "PHONE")])
    f = day_frame(r, "2026-11-26", 90, "Europe/London").collect()
    assert len({x["date"] for x in f}) == 90
    assert max(x["date"] for x in f) == date(2026, 11, 26)
    assert [x["steps"] for x in f if x["date"] == date(2026, 10, 25)] == [5.0]


def test_local_day_and_sleep_count_where_they_end(spark):
    r = readings(spark, [("steps", T(2024, 7, 1, 23, 30), None, 1.0, "A"), ("sleep", T(2024, 7, 1, 22, 10), T(2024, 7, 2, 6, 0), 400.0, "A")])
    got = {x["data_type"]: x["day"] for x in daily(r, "Europe/London").collect()}
    assert got == {"steps": date(2024, 7, 2), "sleep": date(2024, 7, 2)}


def test_preferred_source_for_each_day(spark):
    rows = [("steps", T(2024, 1, 1, 9), None, 10.0, "PRIMARY"), ("steps", T(2024, 1, 1, 10), None, 99.0, "PHONE"), ("steps", T(2024, 1, 2, 9), None, 7.0, "PHONE"), ("steps", T(2024, 1, 3, 9), None, None, "PRIMARY"), ("steps", T(2024, 1, 3, 9), None, 3.0, "unknown")]
    r = readings(spark, rows)
    got = {x["day"].day: (x["total"], x["n"]) for x in daily(r, "UTC").collect()}
    assert got == {1: (10.0, 1), 2: (7.0, 1), 3: (3.0, 1)}
    assert sorted(map(tuple, daily_by_window(r, "UTC").collect())) == sorted(map(tuple, daily(r, "UTC").collect()))


@pytest.mark.parametrize("gap", [2, 3])
def test_interpolation_against_a_loop(spark, gap):
    xs = [None, 1.0, None, 3.0, None, None, 6.0, None, None, None, 10.0, None, None, None, None, 15.0, None]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(xs)], "k string, i int, v double")
    got = [r["filled"] for r in interpolated(df, ["k"], "i", "v", gap).orderBy("i").collect()]
    want, known = list(xs), [i for i, v in enumerate(xs) if v is not None]
    for a, b in zip(known, known[1:]):
        if 0 < b - a - 1 <= gap:
            for i in range(a + 1, b):
                want[i] = xs[a] + (xs[b] - xs[a]) * (i - a) / (b - a)
    assert got == pytest.approx(want)
    again = spark.createDataFrame([("k", i, v) for i, v in enumerate(got)], "k string, i int, v double")
    assert [r["filled"] for r in interpolated(again, ["k"], "i", "v", gap).orderBy("i").collect()] == pytest.approx(got)


def test_reads(spark):
    rows = [("steps", T(2024, 1, 1, h), None, float(h), s) for h in range(6) for s in ("PRIMARY", "PHONE")] + [("weight", T(2024, 1, 1), None, 80.0, "PHONE"), ("weight", T(2024, 1, 2), None, None, "PHONE")]
    r = readings(spark, rows)
    s = {x["metric"]: (x["value"], x["at"]) for x in summary(r).collect()}
    assert s["steps"] == (15.0, None)
    assert s["weight"] == (None, T(2024, 1, 2))
    assert points_total(r, "steps", dedupe=True).first()[0] == 6
    page = points(r, "steps", page=1, limit=4).collect()
    assert [(x["start_time"].hour, x["source"]) for x in page] == [(3, "PHONE"), (3, "PRIMARY"), (2, "PHONE"), (2, "PRIMARY")]
    assert {x["value"] for x in buckets(r, "steps", "day").collect()} == {30.0}
    with pytest.raises(ValueError):
        buckets(r, "weight", "day")


def test_registry():
    assert int_param("x", 5, 1, 9) == 5 and int_param("99", 5, 1, 9) == 9 and int_param(None, 5, 1, 9) == 5 and int_param(2.9, 5, 1, 9) == 2
    assert [bucket_for("steps", d) for d in (0.2, 1, 5, 30)] == [None, "hour", "day", "day"]
    assert [bucket_for("heart-rate", d) for d in (0.2, 1, 5, 30)] == [None, None, "hour", "day"]
    assert bucket_for("sleep", 30) is None
    assert time_filter("sleep")["field"].endswith("civil_end_time") and not time_filter("electrocardiogram")["upper"]
    with pytest.raises(ValueError):
        checked_type("mood")


def test_scan_is_pruned_and_filtered(spark, tmp_path):
    from tidemark.sources.readings import read_table, write_table

    r = readings(spark, [("steps", T(2024, 1, d), None, 1.0, "A") for d in range(1, 20)] + [("weight", T(2024, 1, 1), None, 80.0, "A")])
    write_table(r, str(tmp_path / "t"))
    df = points_total(read_table(spark, str(tmp_path / "t")), "steps", "2024-01-05 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_type" in plan and "GreaterThanOrEqual(start_time" in plan
    assert df.first()[0] == 15
