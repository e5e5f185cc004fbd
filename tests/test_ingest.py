"""JSON points, pages, and loads that may run twice."""

import json
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.registry import SYNCABLE_TYPES

from tidemark.sources.pages import filter_text, register, windows
from tidemark.sources.readings import normalised, page_points, read_table, split_usable
from tidemark.streaming import ingest
from tidemark.streaming.ingest import bucket_stream, load, stream_pages, stream_service, sync_state
from tidemark.streaming.marks import commit, marks

POINTS = [
    ("steps", {"steps": {"count": "412", "interval": {"startTime": "2024-01-01T08:00:00Z", "endTime": "2024-01-01T09:00:00Z"}}, "dataSource": {"platform": "PRIMARY"}}),
    ("heart-rate", {"heartRate": {"beatsPerMinute": 61, "sampleTime": {"physicalTime": "2024-01-01T08:05:00Z"}}}),
    ("daily-resting-heart-rate", {"dailyRestingHeartRate": {"beatsPerMinute": "55", "date": {"year": 2024, "month": 1, "day": 1}}}),
    ("sleep", {"sleep": {"summary": {"minutesAsleep": "431"}, "interval": {"startTime": "2023-12-31T23:10:00Z", "endTime": "2024-01-01T07:00:00Z"}}}),
    ("active-minutes", {"activeMinutes": {"activeMinutesByActivityLevel": [{"activeMinutes": "4"}, {"activeMinutes": "9"}, {}], "interval": {"startTime": "2024-01-01T08:00:00Z"}}}),
    ("active-minutes", {"activeMinutes": {"activeMinutesByActivityLevel": [{"activeMinutes": "x"}], "interval": {"startTime": "2024-01-01T09:00:00Z"}}}),
    ("weight", {"weight": {"kilograms": "x"}}),
    ("sedentary-period", {"sedentaryPeriod": {"interval": {"startTime": "2024-01-01T08:00:00Z", "endTime": "2024-01-01T08:30:00Z"}}}),
    ("distance", {"distance": {"millimeters": "1500", "interval": {"startTime": "2024-01-01T08:00:00Z"}}}),
]


def test_points_become_readings(spark):
    df = spark.createDataFrame([(k, json.dumps(p)) for k, p in POINTS], "data_type string, point string")
    rows = normalised(df)
    got = [(r["data_type"], r["value"], r["unit"], r["source"]) for r in rows.collect()]
    assert got == [("steps", 412.0, "count", "PRIMARY"), ("heart-rate", 61.0, "bpm", "unknown"), ("daily-resting-heart-rate", 55.0, "bpm", "unknown"), ("sleep", 431.0, "min", "unknown"), ("active-minutes", 13.0, "min", "unknown"), ("active-minutes", None, None, "unknown"), ("weight", None, None, "unknown"), ("sedentary-period", 30.0, "min", "unknown"), ("distance", 1.5, "m", "unknown")]
    usable, skipped = split_usable(rows)
    assert usable.count() == 8 and [tuple(r) for r in skipped.collect()] == [("weight", 1)]


def _page(folder, name, kind, points):
    (folder / f"{name}.json").write_text(json.dumps({"entity_id": "me", "data_type": kind, "page": name, "body": json.dumps({"dataPoints": points})}))


def _steps(n, hour, source="PRIMARY"):
    return {"steps": {"count": n, "interval": {"startTime": f"2024-01-01T{hour:02d}:00:00Z"}}, "dataSource": {"platform": source}}


def test_streaming_load_is_idempotent(spark, tmp_path):
    pages, table, mark = tmp_path / "pages", str(tmp_path / "table"), str(tmp_path / "mark")
    pages.mkdir()
    _page(pages, "p1", "steps", [_steps(1, 8), _steps(2, 8), _steps(5, 9)])
    reports = []
    stream_pages(spark, str(pages), table, mark, report=reports.append).awaitTermination()
    assert {(r["start_time"].hour, r["value"]) for r in read_table(spark, table).collect()} == {(8, 2.0), (9, 5.0)}
    _page(pages, "p2", "steps", [_steps(77, 9), _steps(6, 10), {"steps": {"count": 1}}])
    stream_pages(spark, str(pages), table, mark, report=reports.append).awaitTermination()
    assert {(r["start_time"].hour, r["value"]) for r in read_table(spark, table).collect()} == {(8, 2.0), (9, 5.0), (10, 6.0)}
    assert reports[1] == {"steps": {"written": 1, "skipped": 1}}
    stream_pages(spark, str(pages), table, str(tmp_path / "other"), report=reports.append).awaitTermination()
    assert read_table(spark, table).count() == 3


def test_late_readings_read_their_own_range(spark, tmp_path):
    row = lambda kind, t, v, seq: ("me", kind, t, None, v, None, "A", None, seq)
    batch = lambda *rows: spark.createDataFrame(rows, "entity_id string, data_type string, start_time timestamp_ntz, end_time timestamp_ntz, value double, unit string, source string, raw string, seq string")
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    T = datetime
    first = load(batch(row("steps", T(2020, 1, 1), 1.0, "a"), row("steps", T(2024, 1, 1), 2.0, "b"), row("weight", T(2024, 1, 1), 80.0, "c")), path, state, T(2024, 1, 2))
    assert first == {"steps": {"written": 2, "skipped": 0}, "weight": {"written": 1, "skipped": 0}}
    second = load(batch(row("steps", T(2020, 1, 1), 9.0, "a"), row("steps", T(2021, 1, 1), 3.0, "b"), row("weight", T(2024, 1, 1), 99.0, "c")), path, state, T(2024, 1, 3))
    assert second == {"steps": {"written": 1, "skipped": 0}, "weight": {"written": 0, "skipped": 0}}
    assert sorted(r["value"] for r in read_table(spark, path).collect()) == [1.0, 2.0, 3.0, 80.0]
    found = {r["data_type"]: r["last_synced_at"] for r in sync_state(marks(spark, state), "2023-06-01").collect()}
    assert found["steps"] == found["weight"] == T(2024, 1, 3) and found["sleep"] == T(2023, 6, 1) and len(found) == 36


BATCH = "entity_id string, data_type string, start_time timestamp_ntz, end_time timestamp_ntz, value double, unit string, source string, raw string, seq string, error string"


def test_a_failing_type_stops_no_other(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("me", k, at, None, 1.0, None, "A", None, "a", None) for k in ("steps", "weight", "no-such-type")] + [("me", "steps", None, None, None, None, "A", None, None, "HTTP Error 500")]
    done = load(spark.createDataFrame(rows, BATCH), str(tmp_path / "t"), str(tmp_path / "state"), datetime(2024, 1, 2), ("steps", "weight", "sleep"))
    assert done["weight"] == {"written": 1, "skipped": 0} and done["steps"] == {"error": "HTTP Error 500"} and "unknown" in done["no-such-type"]["error"]
    # what came before the error is kept, but its mark stays; a type without points moves
    assert sorted(r["data_type"] for r in read_table(spark, str(tmp_path / "t")).collect()) == ["steps", "weight"]
    assert sorted(r["data_type"] for r in marks(spark, str(tmp_path / "state")).collect()) == ["sleep", "weight"]


def test_a_batch_that_runs_again_moves_no_mark(spark, tmp_path):
    path, state = str(tmp_path / "t"), str(tmp_path / "state")
    batch = spark.createDataFrame([("me", "steps", datetime(2024, 1, 1), None, 1.0, None, "A", None, "a", None)], BATCH)
    for day in (2, 5):
        load(batch, path, state, datetime(2024, 1, day), ("steps", "sleep"), "q#0")
    assert {(r["data_type"], r["last_synced_at"].day, r["version"]) for r in marks(spark, state).collect()} == {("steps", 2, 1), ("sleep", 2, 1)}
    for n in range(1, 6):
        load(batch, path, state, datetime(2024, 1, 5 + n), ("steps",), f"q#{n}")
    found = {r["data_type"]: (r["last_synced_at"].day, r["version"]) for r in marks(spark, state).collect()}
    assert found == {"steps": (10, 6), "sleep": (2, 6)} and read_table(spark, path).count() == 1
    assert spark.read.parquet(f"{state}/slot0", f"{state}/slot1").count() == 4  # two versions, however many loads


def test_a_broken_commit_keeps_the_marks(spark, tmp_path):
    state = str(tmp_path / "state")
    for n in (1, 2, 3):
        commit(spark, state, ["steps"], datetime(2024, 1, n), f"b{n}")
    for f in (tmp_path / "state" / "slot1").glob("*"):  # as if version 3 was being overwritten
        f.unlink()
    assert [(r["last_synced_at"].day, r["version"]) for r in marks(spark, state).collect()] == [(2, 2)]


def test_a_load_takes_as_many_jobs_for_many_types(spark, tmp_path):
    def jobs(types):
        at = datetime(2024, 1, 1)
        batch = spark.createDataFrame([("me", t, at, None, 1.0, None, "A", None, "a", None) for t in types], BATCH)
        path = str(tmp_path / f"t{len(types)}")
        load(batch, path)
        spark.sparkContext.setJobGroup(f"load-{len(types)}", "")
        done = load(batch.withColumn("start_time", F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")), path)
        n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"load-{len(types)}"))
        spark.sparkContext.setJobGroup("", "")
        assert done == {t: {"written": 1, "skipped": 0} for t in types}
        return n

    assert jobs(SYNCABLE_TYPES[:2]) == jobs(SYNCABLE_TYPES[:20])


class Service(BaseHTTPRequestHandler):
    """Two pages of steps, one of sleep, none of weight; heart rates fail at first."""

    asked, broken = [], True

    def do_GET(self):
        url = urlparse(self.path)
        kind, query = url.path.split("/")[1], {k: v[0] for k, v in parse_qs(url.query).items()}
        self.asked.append((kind, query))
        if kind == "heart-rate" and Service.broken:
            return self.send_error(500)
        points, token = [], ""
        if kind == "steps" and "2024-01-01" in query["filter"]:
            points, token = ([_steps(1, 8)], "x") if "pageToken" not in query else ([_steps(2, 9)], "")
        if kind == "heart-rate":
            points = [{"heartRate": {"beatsPerMinute": 61, "sampleTime": {"physicalTime": "2024-01-01T08:05:00Z"}}}]
        body = json.dumps({"dataPoints": points, "nextPageToken": token}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    Service.asked, Service.broken = [], True
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_filters_reach_the_service(spark, service):
    register(spark)
    df = spark.read.format("pages").options(root=service, types="steps,sleep,weight,electrocardiogram,daily-vo2-max", since="2024-01-01T00:00:00", until="2024-02-01T00:00:00").load()
    assert df.count() == 2 and len({k for k, _ in Service.asked}) == 5
    sent = {k: q["filter"] for k, q in Service.asked if "2024-01-01" in q["filter"]}
    assert sent == {
        "steps": 'steps.interval.start_time >= "2024-01-01T00:00:00Z" AND steps.interval.start_time < "2024-01-15T00:00:00Z"',
        "sleep": 'sleep.interval.civil_end_time >= "2024-01-01T00:00:00" AND sleep.interval.civil_end_time < "2024-01-15T00:00:00"',
        "weight": 'weight.sample_time.physical_time >= "2024-01-01T00:00:00Z" AND weight.sample_time.physical_time < "2024-01-15T00:00:00Z"',
        "electrocardiogram": 'electrocardiogram.interval.start_time >= "2024-01-01T00:00:00Z"',
        "daily-vo2-max": 'daily_vo2_max.date >= "2024-01-01" AND daily_vo2_max.date < "2024-01-15"',
    }
    Service.asked.clear()
    kept = df.filter("data_type IN ('steps', 'weight') AND until > TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    assert kept.count() == 0
    assert {(k, q["filter"][-21:-1]) for k, q in Service.asked} == {(k, f"{d}T00:00:00Z") for k in ("steps", "weight") for d in ("2024-01-29", "2024-02-01")}


def test_a_service_is_loaded_type_by_type(spark, tmp_path, service):
    table, state, reports = str(tmp_path / "t"), str(tmp_path / "state"), []

    def run(until, checkpoint):
        stream_service(spark, service, "me", table, str(tmp_path / checkpoint), "2024-01-01T00:00:00", until, ("steps", "weight", "heart-rate"), state, reports.append).awaitTermination()
        return {r["data_type"]: r["last_synced_at"].isoformat() for r in marks(spark, state).collect()}

    found = run("2024-01-03T00:00:00", "a")
    assert found == {"steps": "2024-01-03T00:00:00", "weight": "2024-01-03T00:00:00"}
    assert reports[-1]["steps"] == {"written": 2, "skipped": 0} and "500" in reports[-1]["heart-rate"]["error"] and reports[-1]["weight"]["written"] == 0
    # a new checkpoint starts each type at its mark, and the failed one at the beginning
    Service.broken = False
    Service.asked.clear()
    assert set(run("2024-01-05T00:00:00", "b").values()) == {"2024-01-05T00:00:00"} and reports[-1]["heart-rate"] == {"written": 1, "skipped": 0}
    assert {k: q["filter"].split('"')[1] for k, q in Service.asked} == {"steps": "2024-01-03T00:00:00Z", "weight": "2024-01-03T00:00:00Z", "heart-rate": "2024-01-01T00:00:00Z"}
    # the same checkpoint goes on from its offsets
    Service.asked.clear()
    run("2024-01-09T00:00:00", "b")
    assert {q["filter"].split('"')[1] for _, q in Service.asked} == {"2024-01-05T00:00:00Z"} and read_table(spark, table).count() == 3


@pytest.mark.parametrize("after", ["write_table", "commit"])
def test_a_crash_between_fetch_and_commit(spark, tmp_path, service, monkeypatch, after):
    table, state, reports = str(tmp_path / "t"), str(tmp_path / "state"), []
    start = lambda: stream_service(spark, service, "me", table, str(tmp_path / "c"), "2024-01-01T00:00:00", "2024-01-03T00:00:00", ("steps", "weight"), state, reports.append)
    real = getattr(ingest, after)

    def crash(*args, **named):
        real(*args, **named)
        raise RuntimeError("crash")

    monkeypatch.setattr(ingest, after, crash)
    with pytest.raises(Exception, match="crash"):
        start().awaitTermination()
    monkeypatch.undo()
    start().awaitTermination()
    assert sorted(r["value"] for r in read_table(spark, table).collect()) == [1.0, 2.0] and reports[-1]["steps"]["written"] == 0
    assert {(r["data_type"], r["version"]) for r in marks(spark, state).collect()} == {("steps", 1), ("weight", 1)}


def test_an_empty_page_moves_its_mark(spark, tmp_path):
    pages, state = tmp_path / "pages", str(tmp_path / "state")
    pages.mkdir()
    _page(pages, "p1", "steps", [_steps(1, 8)])
    _page(pages, "p2", "weight", [])
    reports = []
    stream_pages(spark, str(pages), str(tmp_path / "t"), str(tmp_path / "c"), report=reports.append, state=state).awaitTermination()
    assert reports == [{"steps": {"written": 1, "skipped": 0}, "weight": {"written": 0, "skipped": 0}}]
    assert sorted(r["data_type"] for r in marks(spark, state).collect()) == ["steps", "weight"]


@pytest.mark.parametrize("status", [500, 404])
def test_a_failed_request_fails_the_read(spark, status):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_error(status)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        register(spark)
        df = spark.read.format("pages").option("root", f"http://127.0.0.1:{server.server_port}").option("types", "steps").option("since", "2024-01-01").option("until", "2024-01-05").load()
        with pytest.raises(Exception, match=f"HTTP Error {status}"):
            df.count()
    finally:
        server.shutdown()


def test_a_missing_later_page_fails_the_read(spark, tmp_path):
    (tmp_path / "steps").mkdir()
    (tmp_path / "steps" / "2024-01-01.0.json").write_text(json.dumps({"dataPoints": [_steps(1, 8)], "nextPageToken": "1"}))
    register(spark)
    df = spark.read.format("pages").option("root", f"file://{tmp_path}").option("types", "steps").option("since", "2024-01-01").option("until", "2024-01-05").load()
    with pytest.raises(Exception, match="No such file"):
        df.count()


def test_bucket_stream(spark, tmp_path):
    from tidemark.sources.readings import READING_SCHEMA

    rows = spark.createDataFrame([("me", "steps", datetime(2024, 1, 1, h, m), None, 1.0, None, "A", None) for h in (8, 9, 12) for m in (0, 30)], READING_SCHEMA)
    rows.write.parquet(str(tmp_path / "r"))
    stream = bucket_stream(spark.readStream.schema(READING_SCHEMA).parquet(str(tmp_path / "r")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("buckets").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["bucket"].hour, r["total"], r["n"]) for r in spark.table("buckets").collect()) == [(8, 2.0, 2), (9, 2.0, 2), (12, 2.0, 2)]


def test_paged_source(spark, tmp_path):
    folder = tmp_path / "steps"
    folder.mkdir()
    (folder / "2024-01-01.0.json").write_text(json.dumps({"dataPoints": [_steps(1, 8)], "nextPageToken": "1"}))
    (folder / "2024-01-01.1.json").write_text(json.dumps({"dataPoints": [_steps(2, 9)], "nextPageToken": ""}))
    (folder / "2024-01-15.0.json").write_text(json.dumps({"dataPoints": [_steps(3, 10)]}))
    register(spark)
    df = spark.read.format("pages").option("root", f"file://{tmp_path}").option("types", "steps,floors").option("since", "2024-01-01").option("until", "2024-01-20").load()
    assert df.rdd.getNumPartitions() == 2
    assert sorted(r["value"] for r in normalised(df.select("data_type", "point")).collect()) == [1.0, 2.0, 3.0]
    assert list(windows(datetime(2024, 1, 1), datetime(2024, 1, 20))) == [(datetime(2024, 1, 1), datetime(2024, 1, 15)), (datetime(2024, 1, 15), datetime(2024, 1, 20))]
    assert filter_text("electrocardiogram", "2024-01-01T00:00:00", "2024-01-02T00:00:00").count("AND") == 0
    assert 'sleep.interval.civil_end_time >= "2024-01-01T00:00:00"' in filter_text("sleep", "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z")


def test_pages_split_into_points(spark):
    df = spark.createDataFrame([("p", json.dumps({"dataPoints": [{"a": 1}, {"b": 2}]}))], "page string, body string")
    assert [(r["seq"], json.loads(r["point"])) for r in page_points(df).collect()] == [(0, {"a": 1}), (1, {"b": 2})]
