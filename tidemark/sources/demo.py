"""A seeded history with planted structure, for tests and demonstrations.

Days run from `days - 1` days ago to `until`. Planted: a weekly rhythm, slow
trends, a training block (6 to 23 days ago), an illness (20 and 21 days ago) and
travel (54 to 60 days ago). Entities differ by seed. One pass, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, datetime, time, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..registry import int_param
from .readings import READING_SCHEMA

#: Monday first.
STEP_SHAPE = (1.05, 1.0, 1.1, 1.0, 0.95, 0.8, 0.7)
SLEEP_SHAPE = (-12, -8, -5, -8, 0, 28, 22)


def _history(entity: str, seed: int, until: date, days: int, source: str) -> Iterator[tuple]:
    rng = np.random.default_rng(seed)
    for ago in range(days - 1, -1, -1):
        day = until - timedelta(days=ago)
        ill, block, travel = ago in (20, 21), 6 <= ago <= 23, 54 <= ago <= 60
        w, done = day.weekday(), 1 - ago / days
        effort = STEP_SHAPE[w] * (1.28 if block else 1) * (0.22 if ill else 1)
        at = lambda h, m=0, day=day: datetime.combine(day, time(h, m))
        steps = max(200.0, rng.normal(9000, 900) * effort)
        shares = rng.dirichlet(np.full(15, 3.0))
        for h, s in enumerate(shares):
            a, b = at(7 + h), at(7 + h) + timedelta(hours=1)
            for kind, v, unit in (("steps", steps * s, "count"), ("distance", steps * s * 0.74, "m"), ("active-energy-burned", steps * s * 0.045, "kcal"), ("active-minutes", steps * s / 140, "min")):
                yield entity, kind, a, b, float(v), unit, source, "{}"
        sleep = float(np.clip(rng.normal(430 + SLEEP_SHAPE[w] + (52 if ill else 0), 96 if travel else 34), 120, 700))
        yield entity, "sleep", at(7) - timedelta(minutes=sleep), at(7), sleep, "min", source, "{}"
        for kind, v, unit, h in (
            ("daily-resting-heart-rate", rng.normal(57 - 3 * done + 9.5 * ill + 1.1 * block, 1.3), "bpm", 4),
            ("heart-rate-variability", rng.normal(52 + 7 * done - 18 * ill - 3 * block, 4.0), "ms", 4),
            ("oxygen-saturation", min(100.0, rng.normal(96.6 - 1.4 * ill, 0.5)), "%", 3),
        ):
            yield entity, kind, at(h), None, float(v), unit, source, "{}"
        if ago % 7 == 0:
            yield entity, "weight", at(8), None, float(80 - 2.2 * done + rng.normal(0, 0.2)), "kg", source, "{}"
        for m in range(0, 24 * 60, 5 if ago < 14 else 30):
            h = m / 60
            v = (56 if h < 7 else 74) + 40 * np.exp(-(((h - 18) / 0.7) ** 2)) + rng.normal(0, 3)
            yield entity, "heart-rate", at(m // 60, m % 60), None, float(v), "bpm", source, "{}"


def demo(spark: SparkSession, until: str, days: int = 120, entities: int = 1, source: str = "DEMO") -> DataFrame:
    """Readings of `entities` histories of 30 to 1000 days."""
    days, end, names = int_param(days, 120, 30, 1000), date.fromisoformat(until), READING_SCHEMA.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame(_history(f"demo{i}", 20240 + int(i), end, days, source), columns=names)

    return spark.range(entities).mapInPandas(run, READING_SCHEMA)
