"""The frame as a table: refreshed by days, equal to the whole, with untouched files."""

from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators.frame import daily
from tidemark.sources.readings import READING_SCHEMA, read_table, write_table
from tidemark.streaming.frame_table import changed, frame_rows, refresh, replace_in_place

TZ = "Europe/London"


def readings(spark, rows):
    return spark.createDataFrame([(e, k, t, end, v, None, s, None) for e, k, t, end, v, s in rows], READING_SCHEMA)


def history(days=range(1, 11), entities=("a", "b")):
    out = []
    for e in entities:
        for d in days:
            at = datetime(2024, 3, 20) + timedelta(d)
            out += [(e, "steps", at + timedelta(hours=h), None, float(10 * d + h), "PHONE") for h in (0, 8, 23)]
            out.append((e, "sleep", at - timedelta(hours=2), at + timedelta(hours=6), 400.0 + d, "PHONE"))
    return out


def same(spark, table, frame):
    want = sorted(map(tuple, daily(read_table(spark, table), TZ).select("entity_id", "data_type", "day", "total", "avg", "n").collect()))
    got = sorted(map(tuple, frame_rows(spark, frame).select("entity_id", "data_type", "day", "total", "avg", "n").collect()))
    assert got == want


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


def test_batches_give_the_whole_frame(spark, tmp_path):
    table, frame = str(tmp_path / "t"), str(tmp_path / "f")
    late = [("a", "steps", datetime(2024, 3, 23, 9), None, 5.0, "PRIMARY"), ("a", "sleep", datetime(2024, 3, 27, 22), datetime(2024, 3, 28, 5), 9.0, "PHONE"), ("c", "hrv-unknown", datetime(2024, 3, 29), None, 1.0, "PHONE")]
    for rows in (history(range(1, 7)), history(range(7, 11)), late, [("a", "steps", datetime(2024, 4, 1, 23, 30), None, 1.0, "PHONE")]):
        batch = readings(spark, rows)
        write_table(batch, table)
        days = refresh(spark, table, frame, changed(batch, TZ), TZ)
        assert days == sorted(r["day"] for r in changed(batch, TZ).select("day").distinct().collect())
        same(spark, table, frame)
    before = files(tmp_path / "f")
    assert refresh(spark, table, frame, changed(readings(spark, []), TZ), TZ) == [] and files(tmp_path / "f") == before


def test_untouched_days_keep_their_files(spark, tmp_path):
    table, frame = str(tmp_path / "t"), str(tmp_path / "f")
    write_table(readings(spark, history()), table)
    refresh(spark, table, frame, changed(read_table(spark, table), TZ), TZ)
    before = files(tmp_path / "f")
    batch = readings(spark, [("b", "steps", datetime(2024, 3, 24, 12), None, 7.0, "PRIMARY")])
    write_table(batch, table)
    assert refresh(spark, table, frame, changed(batch, TZ), TZ) == [date(2024, 3, 24)]
    assert {f.split("/")[0] for f in before ^ files(tmp_path / "f")} == {"day=2024-03-24"}
    same(spark, table, frame)


def test_a_refresh_reads_its_days_alone(spark, tmp_path):
    table, frame = str(tmp_path / "t"), str(tmp_path / "f")
    write_table(readings(spark, history()), table)
    refresh(spark, table, frame, changed(read_table(spark, table), TZ), TZ)
    plan = frame_rows(spark, frame).filter(F.col("day").isin(date(2024, 3, 24)))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-03-24" in plan


def test_a_source_is_replaced_in_place(spark, tmp_path):
    table, frame = str(tmp_path / "t"), str(tmp_path / "f")
    old = readings(spark, [*history(), ("a", "weight", datetime(2024, 3, 25), None, 80.0, "DEMO"), ("a", "height", datetime(2024, 3, 26), None, 1.8, "DEMO"), ("a", "steps", datetime(2024, 3, 25, 3), None, 4.0, "DEMO")])
    write_table(old, table)
    refresh(spark, table, frame, changed(old, TZ), TZ)
    before = files(tmp_path / "t")
    gone = spark.createDataFrame(read_table(spark, table).filter("source = 'DEMO'").select(*READING_SCHEMA.names).collect(), READING_SCHEMA)
    new = readings(spark, [("b", "height", datetime(2024, 3, 29), None, 1.7, "DEMO")])
    assert replace_in_place(spark, table, "DEMO", new) == ["height", "steps", "weight"]
    assert {f.split("/")[0] for f in before ^ files(tmp_path / "t")} == {"data_type=height", "data_type=steps", "data_type=weight"} and not (tmp_path / "t" / "data_type=weight").exists()
    assert sorted((r["entity_id"], r["data_type"]) for r in read_table(spark, table).filter("source = 'DEMO'").collect()) == [("b", "height")]
    refresh(spark, table, frame, changed(gone.unionByName(new), TZ), TZ)
    same(spark, table, frame)
