"""Every registered query against its SQL, and the entry point."""

import glob
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import oracle, queries


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") and v.tzinfo else v


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name, scale):
    sf, db = f"/root/testdata/{scale}", duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df, rel = queries.QUERIES[name](spark, sf), db.sql(oracle.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert got == want


def test_rounding_goes_a_hair_above():
    assert oracle._a_hair_above("SELECT round(a, 4), round(f(b, round(c, 2)), 3) x") == "SELECT round(CAST(a AS DOUBLE) + 1e-9, 4), round(CAST(f(b, round(CAST(c AS DOUBLE) + 1e-7, 2)) AS DOUBLE) + 1e-8, 3) x"


def test_anomalies_sort_each_window_a_few_times(spark, sf):
    plan = queries.anomaly_days(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_sort(") <= 4 and "percentile(" in plan


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 30


def test_all_names_have_queries():
    assert set(oracle.SQL) <= set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run_from_another_folder(tmp_path, sf):
    code = f"""
import sys; sys.path.insert(0, {str(entry.HERE)!r})
import __spark_entry__ as e
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", e.queries()["forecast_holt_winters"](s, {sf!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=170)
    assert "rows 21" in done.stdout, done.stderr[-2000:]


def test_an_error_within_the_text_operators_is_no_absence(tmp_path):
    """Without the folder the rest works; with a broken module in it the import fails."""
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "tidemark"):
        here = entry.HERE / name
        if here.exists():
            (shutil.copytree if here.is_dir() else shutil.copy)(here, tmp_path / name)
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, env={"PATH": os.environ["PATH"]}, capture_output=True, text=True, timeout=120)
    if (tmp_path / "tidemark" / "llm").exists():
        (tmp_path / "tidemark" / "llm" / "urls.py").write_text("import no_such_module\n")
        assert "no_such_module" in run().stderr
        shutil.rmtree(tmp_path / "tidemark" / "llm")
        (tmp_path / "corpus_pipeline.py").unlink()
    assert run().stdout.split() == [str(len(queries.QUERIES)), "False"]
