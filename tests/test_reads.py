"""Pages of readings: looked up by counts, or after a cursor, in one total order."""

import re

import pytest

from tidemark.operators import reads
from tidemark.sources.adapters import from_events
from tidemark.sources.readings import READING_SCHEMA, read_table, write_table


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("readings") / "t")
    write_table(from_events(spark, "/root/testdata/sf0.01", 5).select(*READING_SCHEMA.names), path)
    return read_table(spark, path)


@pytest.fixture(scope="module")
def whole(table):
    rows = [(r["start_time"], r["entity_id"], r["source"], r["value"]) for r in table.filter("data_type = 'steps'").collect()]
    return sorted(rows, key=lambda r: (-r[0].timestamp(), r[1], r[2], -r[3]))


def rows(df):
    return [(r["start_time"], r["entity_id"], r["source"], r["value"]) for r in df.collect()]


@pytest.mark.parametrize("spare", [0, 300, 50_000])
@pytest.mark.parametrize(("page", "limit"), [(0, 30), (1, 30), (13, 100), (1, 1000), (60, 30), (500, 30)])
def test_pages_are_slices_of_the_whole(table, whole, monkeypatch, spare, page, limit):
    monkeypatch.setattr(reads, "SPARE", spare)
    assert rows(reads.points(table, "steps", page=page, limit=limit)) == whole[page * limit : (page + 1) * limit]


def test_a_deep_page_sorts_its_own_range(table, monkeypatch):
    monkeypatch.setattr(reads, "SPARE", 50)
    plan = reads.points(table, "steps", page=40, limit=25)._jdf.queryExecution().executedPlan().toString()
    limits = [int(n) for n in re.findall(r"(?:TakeOrderedAndProject\(limit=|GlobalLimit |LocalLimit )(\d+)", plan)]
    assert limits and max(limits) < 200 and "GreaterThanOrEqual(start_time" in plan and "LessThan(start_time" in plan and "PartitionFilters: [isnotnull(data_type" in plan


def test_cursors_go_through_the_whole(table, whole):
    got, cursor = [], None
    for _ in range(4):
        page = rows(reads.points_after(table, "steps", cursor, limit=150))
        got, cursor = got + page, page[-1][:3]
    assert got == whole[:600]
    assert "LessThanOrEqual(start_time" in reads.points_after(table, "steps", cursor, limit=10)._jdf.queryExecution().executedPlan().toString()


def test_a_page_of_nothing(table):
    assert rows(reads.points(table, "weight", page=3)) == [] and rows(reads.points_after(table, "weight")) == []
