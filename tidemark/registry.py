"""Fixed facts about reading types and day-frame metrics, and argument checks."""

from __future__ import annotations

from dataclasses import dataclass

#: Every reading type.
DATA_TYPES = (
    "active-energy-burned", "active-minutes", "active-zone-minutes", "activity-level", "altitude", "blood-glucose", "body-fat",
    "calories-in-heart-rate-zone", "core-body-temperature", "daily-heart-rate-variability", "daily-heart-rate-zones",
    "daily-oxygen-saturation", "daily-respiratory-rate", "daily-resting-heart-rate", "daily-sleep-temperature-derivations",
    "daily-vo2-max", "distance", "electrocardiogram", "exercise", "floors", "food", "food-measurement-unit", "heart-rate",
    "heart-rate-variability", "height", "hydration-log", "irregular-rhythm-notification", "nutrition-log", "oxygen-saturation",
    "respiratory-rate-sleep-summary", "run-vo2-max", "sedentary-period", "sleep", "steps", "swim-lengths-data",
    "time-in-heart-rate-zone", "total-calories", "vo2-max", "weight",
)
#: Types without a list end point, summed types, types never bucketed.
NOT_LISTABLE = ("floors", "calories-in-heart-rate-zone", "total-calories")
SUM_TYPES = ("steps", "distance", "active-energy-burned", "active-minutes", "active-zone-minutes", "floors", "total-calories")
RAW_ALWAYS_TYPES = ("sleep", "daily-resting-heart-rate", "daily-heart-rate-variability", "daily-oxygen-saturation", "daily-respiratory-rate", "daily-vo2-max", "weight", "body-fat", "height")
#: How a source filters each family of types by time.
DAILY_TYPES = ("daily-heart-rate-variability", "daily-heart-rate-zones", "daily-oxygen-saturation", "daily-respiratory-rate", "daily-resting-heart-rate", "daily-sleep-temperature-derivations", "daily-vo2-max")
INTERVAL_TYPES = ("active-energy-burned", "active-minutes", "active-zone-minutes", "activity-level", "altitude", "distance", "sedentary-period", "steps", "swim-lengths-data", "time-in-heart-rate-zone", "irregular-rhythm-notification")
CIVIL_SESSION_TYPES = ("sleep", "exercise", "hydration-log")
#: Types that belong to the day on which they end.
END_ANCHORED = ("sleep",)
SYNCABLE_TYPES = tuple(t for t in DATA_TYPES if t not in NOT_LISTABLE)
#: The source that wins a day where a call names no other, and what a missing one is called.
PREFERRED_SOURCE, UNKNOWN_SOURCE = "PRIMARY", "unknown"


@dataclass(frozen=True)
class Metric:
    name: str
    data_type: str
    agg: str
    label: str
    unit: str
    higher_is_better: bool = True
    non_negative: bool = False


METRICS = (
    Metric("steps", "steps", "total", "Steps", "steps", non_negative=True),
    Metric("distance", "distance", "total", "Distance", "m", non_negative=True),
    Metric("calories", "active-energy-burned", "total", "Calories burned", "kcal", non_negative=True),
    Metric("active_minutes", "active-minutes", "total", "Active minutes", "min", non_negative=True),
    Metric("sleep_minutes", "sleep", "total", "Sleep", "min", non_negative=True),
    Metric("resting_heart_rate", "daily-resting-heart-rate", "avg", "Resting heart rate", "bpm", higher_is_better=False),
    Metric("hrv", "heart-rate-variability", "avg", "Heart rate variability", "ms"),
    Metric("spo2", "oxygen-saturation", "avg", "Blood oxygen", "%"),
    Metric("heart_rate", "heart-rate", "avg", "Heart rate", "bpm", higher_is_better=False),
)
BY_NAME = {m.name: m for m in METRICS}
METRIC_NAMES = tuple(m.name for m in METRICS)
#: Which metrics each layer reads.
ANOMALY_METRICS = ("resting_heart_rate", "hrv", "sleep_minutes", "steps", "spo2", "active_minutes")
BASELINE_METRICS = ("steps", "sleep_minutes", "resting_heart_rate", "hrv", "active_minutes", "spo2")
CLUSTER_METRICS = ("steps", "active_minutes", "sleep_minutes", "resting_heart_rate", "hrv")
FOREST_METRICS = CLUSTER_METRICS
FACTOR_METRICS = ("steps", "active_minutes", "calories", "sleep_minutes", "resting_heart_rate", "hrv")
STATE_METRICS = ("hrv", "resting_heart_rate", "sleep_minutes", "active_minutes")
NET_METRICS = ("hrv", "resting_heart_rate", "sleep_minutes", "steps", "active_minutes")
FORECAST_METRICS = ("steps", "sleep_minutes", "resting_heart_rate")
GP_METRICS = ("hrv", "sleep_minutes", "steps")
ATTRIBUTIONS = (("sleep_minutes", ("steps", "active_minutes", "calories", "heart_rate"), 0), ("hrv", ("steps", "active_minutes", "sleep_minutes", "resting_heart_rate"), 1))
#: Summary metrics with their type, mode and divisor.
SUMMARY = (
    ("steps", "steps", "sum", 1), ("distance", "distance", "sum", 1000), ("calories", "active-energy-burned", "sum", 1), ("active_minutes", "active-minutes", "sum", 1),
    ("heart_rate", "heart-rate", "latest", 1), ("resting_heart_rate", "daily-resting-heart-rate", "latest", 1), ("hrv", "heart-rate-variability", "latest", 1),
    ("spo2", "oxygen-saturation", "latest", 1), ("sleep", "sleep", "latest", 1), ("weight", "weight", "latest", 1),
)


def checked_type(data_type: str | None) -> str:
    """The type, or an error for a missing or unknown one."""
    if data_type not in DATA_TYPES:
        raise ValueError(f"unknown data type: {data_type!r}")
    return data_type


def int_param(value: object, default: int, low: int, high: int) -> int:
    """A whole number within bounds; the default where there is none."""
    try:
        n = int(float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default
    return max(low, min(high, n))


def bucket_for(data_type: str, span_days: float) -> str | None:
    """The bucket that suits a span: none, hour or day."""
    adds = data_type in SUM_TYPES
    if data_type in RAW_ALWAYS_TYPES or span_days <= 0.25:
        return None
    if span_days <= 2:
        return "hour" if adds else None
    if span_days <= 10:
        return "day" if adds else "hour"
    return "day"


def time_filter(data_type: str) -> dict[str, object]:
    """How a source bounds a type by time: the field, its form, and which bounds."""
    checked_type(data_type)
    snake = data_type.replace("-", "_")
    if data_type in DAILY_TYPES:
        return {"field": f"{snake}.date", "form": "date", "lower": True, "upper": True}
    if data_type == "electrocardiogram":
        return {"field": f"{snake}.interval.start_time", "form": "instant", "lower": True, "upper": False}
    if data_type in CIVIL_SESSION_TYPES:
        end = "civil_end_time" if data_type == "sleep" else "civil_start_time"
        return {"field": f"{snake}.interval.{end}", "form": "local", "lower": True, "upper": True}
    if data_type in INTERVAL_TYPES:
        return {"field": f"{snake}.interval.start_time", "form": "instant", "lower": True, "upper": True}
    return {"field": f"{snake}.sample_time.physical_time", "form": "instant", "lower": True, "upper": True}
