"""A Python data source for a paged REST interface, for batches and streams: a
partition for each type and time window, pages followed within it.

    register(spark)
    spark.read.format("pages").option("root", "https://...").option("since", ...).load()

Each request carries the filter of its type's family, `filter_text`, with the bounds of
its window, so the service sends nothing else. Conditions on `data_type` and on the
windows' `since` and `until` are pushed into the reader: types and windows that they
rule out aren't requested.

As a stream, an offset is a mark for each type: the time up to which it was fetched. A
restart goes on from the checkpoint's marks, type by type; a type that is new starts at
its own mark in `marks` (JSON), or at `since`.

A failed request fails its task, which Spark runs again, and in the end the query. With
`errors` set to `report` a type's error becomes a row (without a point) instead, so that
the other types are loaded. `root` may be a folder of captured pages,
<type>/<since>.<page>.json, so that no network is needed; a window that was never
captured is then empty."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..registry import SYNCABLE_TYPES, time_filter

PAGE_SIZE, WINDOW_DAYS = 1000, 14


@dataclass
class Window(InputPartition):
    data_type: str
    since: str
    until: str


def windows(since: datetime, until: datetime, days: int = WINDOW_DAYS) -> Iterator[tuple[datetime, datetime]]:
    """Half-open windows of up to `days` that cover [since, until)."""
    while since < until:
        end = min(until, since + timedelta(days=days))
        yield since, end
        since = end


def filter_text(data_type: str, since: str, until: str) -> str:
    """The request's filter: its field with the bounds its family allows."""
    f = time_filter(data_type)
    cut = {"date": lambda s: s[:10], "local": lambda s: s[:19], "instant": lambda s: s if s.endswith("Z") else f"{s}Z"}[f["form"]]
    parts = [f'{f["field"]} >= "{cut(since)}"'] + ([f'{f["field"]} < "{cut(until)}"'] if f["upper"] else [])
    return " AND ".join(parts)


def fetch(root: str, part: Window, token: str | None) -> dict:
    """One page. A window that was never captured has no first file and is empty;
    any other failure is an error."""
    if not root.startswith("http"):
        url = f"{root}/{part.data_type}/{part.since[:10]}.{token or 0}.json"
    else:
        query = {"filter": filter_text(part.data_type, part.since, part.until), "pageSize": PAGE_SIZE}
        url = f"{root}/{part.data_type}/dataPoints?{urlencode(query | ({'pageToken': token} if token else {}))}"
    try:
        with urlopen(url, timeout=60) as f:
            return json.load(f)
    except URLError as e:
        if token is None and isinstance(e.reason, FileNotFoundError):
            return {}
        raise


def pages(root: str, part: Window) -> Iterator[tuple[str, dict]]:
    """A window's pages with their tokens. A token that comes again would never end."""
    token, seen = None, set()
    while True:
        page = fetch(root, part, token)
        yield token or "0", page
        token = page.get("nextPageToken")
        if not token:
            return
        if token in seen:
            raise ValueError(f"page {token!r} of {part.data_type} came again")
        seen.add(token)


def rows(options: dict[str, str], part: Window) -> Iterator[tuple]:
    """data_type, since, until, seq, point, error of a window."""
    own = (part.data_type, datetime.fromisoformat(part.since), datetime.fromisoformat(part.until))
    try:
        for token, page in pages(options["root"], part):
            for i, point in enumerate(page.get("dataPoints", [])):
                yield *own, f"{part.since}/{token}/{i:06d}", json.dumps(point), None
    except Exception as e:
        if options.get("errors") != "report":
            raise
        yield *own, None, None, str(e)


def types_of(options: dict[str, str]) -> list[str]:
    return [t for t in options.get("types", ",".join(SYNCABLE_TYPES)).split(",") if t in SYNCABLE_TYPES]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.types, self.kept = options, types_of(options), []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes conditions on types and on windows' ends; gives back the others."""
        for f in filters:
            name = getattr(f, "attribute", (None,))[0]
            if name == "data_type" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.types = [t for t in self.types if t in wanted]
            elif name in ("since", "until") and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                self.kept.append((name, f))
            else:
                yield f

    def _wanted(self, bounds: dict[str, datetime]) -> bool:
        compare = {GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        return all(getattr(bounds[name], compare[type(f)])(f.value.replace(tzinfo=None)) for name, f in self.kept)

    def partitions(self) -> list[InputPartition]:
        since, until = (datetime.fromisoformat(self.options[k]) for k in ("since", "until"))
        return [Window(t, a.isoformat(), b.isoformat()) for t in self.types for a, b in windows(since, until) if self._wanted({"since": a, "until": b})]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows(self.options, partition)


class PagedStream(DataSourceStreamReader):
    """Offsets are {type: the time up to which it was fetched}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.types = options, types_of(options)

    def initialOffset(self) -> dict[str, str]:  # noqa: N802
        marks = json.loads(self.options.get("marks", "{}"))
        return {t: marks.get(t, self.options["since"]) for t in self.types}

    def latestOffset(self) -> dict[str, str]:  # noqa: N802
        until = self.options.get("until") or datetime.now(timezone.utc).replace(tzinfo=None).isoformat()
        return dict.fromkeys(self.types, until)

    def partitions(self, start: dict[str, str], end: dict[str, str]) -> list[InputPartition]:
        first = self.initialOffset()
        bounds = {t: (datetime.fromisoformat(start.get(t, first.get(t, end[t]))), datetime.fromisoformat(end[t])) for t in end}
        return [Window(t, a.isoformat(), b.isoformat()) for t, (low, high) in bounds.items() for a, b in windows(low, high)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows(self.options, partition)

    def commit(self, end: dict[str, str]) -> None:
        """Nothing to let go of: the service keeps its points."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "data_type string, since timestamp_ntz, until timestamp_ntz, seq string, point string, error string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return PagedReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return PagedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the source known as `pages`, with push-down of conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedSource)
