"""Numbers and dates as readers see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown(value: Column, is_sleep: Column) -> Column:
    """Hours and minutes for sleep, grouped thousands, else one decimal."""
    minutes = F.floor(value % 60 + 0.5).cast("int")
    hours = F.floor(value / 60).cast("int") + F.when(minutes == 60, 1).otherwise(0)
    sleep = F.format_string("%dh %02dm", hours, F.when(minutes == 60, 0).otherwise(minutes))
    return F.when(is_sleep, sleep).when(F.abs(value) >= 1000, F.format_number(value, 0)).otherwise(F.format_string("%.1f", value))


def human_date(day: Column) -> Column:
    """Such as 29 Sep."""
    return F.date_format(day, "d MMM")


def listed(names: Column) -> Column:
    """a, b and c."""
    n = F.size(names)
    return F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1)))


def camel(kebab: Column) -> Column:
    """heart-rate as heartRate."""
    s = F.regexp_replace(F.initcap(F.regexp_replace(kebab, "-", " ")), " ", "")
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1000))
