"""The array statistics as SQL functions of a session, planned by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

def _median(a: str) -> str:
    s = f"array_sort({a})"
    return f"(get({s}, CAST(floor((size({a}) - 1) / 2) AS INT)) + get({s}, CAST(ceil((size({a}) - 1) / 2) AS INT))) / 2"


#: Name, arguments, type and body; arrays hold no nulls, as collect_list leaves them.
FUNCTIONS = {
    "array_median": ("a ARRAY<DOUBLE>", "DOUBLE", _median("a")),
    "array_mad": ("a ARRAY<DOUBLE>", "DOUBLE", f"IF(size(a) < 2, NULL, 1.4826D * {_median(f'transform(a, x -> abs(x - {_median("a")}))')})"),
    "ewma": ("a ARRAY<DOUBLE>, span INT", "DOUBLE", "aggregate(slice(a, 2, greatest(size(a) - 1, 0)), get(a, 0), (s, x) -> s + 2.0D / (span + 1) * (x - s))"),
    "readiness_band": ("score DOUBLE", "STRING", "CASE WHEN score IS NULL OR score < 35 THEN 'rest' WHEN score < 55 THEN 'easy' WHEN score < 75 THEN 'steady' ELSE 'push' END"),
}


def register(spark: SparkSession) -> list[str]:
    """Defines the functions for the session; their names."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
