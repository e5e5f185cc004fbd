"""Attempts of a key: a fixed window, kept between micro-batches, cleared after it."""

import json

import numpy as np

from tidemark.streaming import attempts
from tidemark.streaming.attempts import PROVIDER, ROW, limited, ordered

S = 1_000_000


def run(spark, base, name):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = spark.readStream.schema("key string, id long, at_us long").option("maxFilesPerTrigger", 1).json(str(base / "in"))
    q = limited(stream, 60, 3, "0 seconds").writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r["id"]: (r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(base / "out")).collect()}, q.lastProgress


def batch(base, n, rows):
    (base / "in").mkdir(exist_ok=True)
    (base / "in" / f"{n:02d}.json").write_text("\n".join(json.dumps({"key": k, "id": i, "at_us": 10**15 + at}) for k, i, at in rows))


def test_windows_go_on_between_batches(spark, tmp_path):
    batch(tmp_path, 0, [("a", 2, 10 * S), ("a", 1, 0), ("b", 3, 5 * S)])
    got, _ = run(spark, tmp_path, "state")
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0)}
    # a restart finds the window: the third is allowed, the fourth isn't until 60 s
    batch(tmp_path, 1, [("a", 4, 20 * S), ("a", 5, 30 * S + 1), ("a", 6, 60 * S), ("a", 7, 60 * S + 1)])
    got, _ = run(spark, tmp_path, "state")
    assert [got[i] for i in (4, 5, 6, 7)] == [(True, 0), (False, 30), (False, 0), (True, 0)]


def test_state_of_ended_windows_is_cleared(spark, tmp_path):
    batch(tmp_path, 0, [(f"k{i}", i, i) for i in range(20)])
    batch(tmp_path, 1, [("late", 100, 900 * S)])
    batch(tmp_path, 2, [("later", 101, 901 * S)])
    got, progress = run(spark, tmp_path, "state")
    assert len(got) == 22 and progress.stateOperators[0].numRowsTotal <= 2 * 3


def test_ordered_blocks_are_bounded_and_whole():
    """Runs of a temporary file give the rows in order, none of them in a block of all."""
    rng = np.random.default_rng(2)
    for n, held in ((0, 10), (7, 10), (1000, 100), (5000, 64), (3000, 2999)):
        rows = np.zeros(n, ROW)
        rows["bare"], rows["at"], rows["bare_id"], rows["id"] = rng.random(n) < 0.1, rng.integers(0, 50, n), rng.random(n) < 0.1, rng.integers(-5, 200, n)
        blocks = list(ordered(iter(np.array_split(rows, max(1, n // 30))), held))
        assert [r.item() for b in blocks for r in b] == sorted(r.item() for r in rows)
        assert max(map(len, blocks)) <= max(held, 30) + held // 2 + 60


def test_attempts_beyond_what_a_task_holds(spark, tmp_path, monkeypatch):
    """A key of more attempts than a task holds counts as in one piece; those without a time come last."""
    rng = np.random.default_rng(3)
    times = rng.integers(0, 400 * S, 3000).tolist()
    limiter = attempts.Limiter.__init__

    def less(self, window_s, most):
        limiter(self, window_s, most)
        self.held = 70

    monkeypatch.setattr(attempts.Limiter, "__init__", less)
    (tmp_path / "in").mkdir()
    lines = [{"key": "a", "id": i, "at_us": 10**15 + at} for i, at in enumerate(times)] + [{"key": k, "id": i} for k in "ab" for i in range(5000, 5005)]
    (tmp_path / "in" / "00.json").write_text("\n".join(map(json.dumps, lines)))
    run(spark, tmp_path, "state")
    got = sorted((r["key"], r["id"], r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["key"] == "a" and r["id"] < 5000)
    want, ends, n = [], None, 0
    for at, i in sorted((at, i) for i, at in enumerate(times)):
        if ends is None or at > ends:
            ends, n = at + 60 * S, 0
        n += 1
        want.append(("a", i, n <= 3, 0 if n <= 3 else -(-(ends - at) // S)))
    assert got == sorted(want)
    bare = {(r["key"], r["id"]): (r["at_us"], r["allowed"], r["retry_after"]) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["id"] >= 5000}
    assert bare == {(k, i): (None, k == "b" and i < 5003, 0 if k == "b" and i < 5003 else None) for k in "ab" for i in range(5000, 5005)}
