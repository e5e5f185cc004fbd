"""Models: planted structure, literal loops, and histories that are too short."""

import itertools
import json
import math
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.functions.rng import Lcg, Mulberry32
from tidemark.operators import folds as F_
from tidemark.operators import models as M
from tidemark.operators import series
from tidemark.operators.frame import day_frame
from tidemark.plans import queries
from tidemark.plans.insights import Insights
from tidemark.sources.demo import demo

UNTIL = "2024-06-30"


@pytest.fixture(scope="module")
def history(spark):
    return demo(spark, UNTIL, 120).cache()


@pytest.fixture(scope="module")
def frame(spark, history):
    return day_frame(history, UNTIL, 120, "UTC").cache()


def test_generators():
    m, g = Mulberry32(1), Lcg(42)
    assert [m() for _ in range(3)] == pytest.approx([0.6270739405881613, 0.002735721180215478, 0.5274470399599522])
    assert g() == (1664525 * 42 + 1013904223) % 2**32 / 2**32


def test_illness_is_found(frame):
    a = series.anomalies(frame).filter("concerning").collect()
    assert any(r["date"].isoformat() in ("2024-06-09", "2024-06-10") for r in a)


def test_anomaly_needs_a_spread_and_ten_values(spark):
    rows = [("e", None, i, 0, 5.0 if i < 30 else 50.0) for i in range(31)]
    f = spark.createDataFrame(rows, "entity_id string, date date, idx int, weekday int, steps double")
    assert series.anomalies(f, ("steps",)).count() == 0


def test_forest_flags_the_illness(frame):
    got = M.forest(frame).filter("flagged").collect()
    assert any(r["date"].isoformat() in ("2024-06-09", "2024-06-10") for r in got)
    assert len(got) <= 6


def test_models_ignore_row_order_and_need_history(frame):
    a = sorted(map(tuple, M.clusters(frame).select("date", "cluster").collect()))
    b = sorted(map(tuple, M.clusters(frame.orderBy("idx", ascending=False)).select("date", "cluster").collect()))
    assert a == b and len(a) == 120
    short = frame.filter("idx < 13")
    assert all(f(short).count() == 0 for f in (M.clusters, M.factors, M.forest, M.states, M.network, M.gp_forecasts, F_.forecasts, M.attributions))


def slow_holt_winters(values: np.ndarray, horizon: int, floor: bool, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.3) -> list[dict]:
    """Additive, weekly, day after day. Missing days move the level by the slope."""
    known = np.flatnonzero(~np.isnan(values))
    if len(known) < 21:
        return []
    x = values[known[0] :]
    with np.errstate(all="ignore"):
        first, second = (np.nanmean(x[a : a + 7]) if (~np.isnan(x[a : a + 7])).any() else math.nan for a in (0, 7))
        level = np.nanmean(x[:14])
    slope = (second - first) / 7
    slope = 0.0 if math.isnan(slope) else slope
    season = [float(np.nanmean(x[i::7]) - level) if (~np.isnan(x[i::7])).any() else 0.0 for i in range(7)]
    errors = []
    for t, v in enumerate(x):
        s = season[t % 7]
        if math.isnan(v):
            level += slope
            continue
        errors.append(v - (level + slope + s))
        before = level
        level = alpha * (v - s) + (1 - alpha) * (level + slope)
        slope = beta * (level - before) + (1 - beta) * slope
        season[t % 7] = gamma * (v - level) + (1 - gamma) * s
    rmse = math.sqrt(np.mean(np.square(errors)))
    out = []
    for h in range(1, horizon + 1):
        point = level + h * slope + season[(len(x) + h - 1) % 7]
        point = max(0.0, point) if floor else point
        spread = rmse * math.sqrt(h)
        low = {f"lower{p}": point - q * spread for p, q in ((80, 1.2816), (95, 1.96))}
        out.append({"day": h, "value": point, **{k: max(0.0, v) if floor else v for k, v in low.items()}, "upper80": point + 1.2816 * spread, "upper95": point + 1.96 * spread, "rmse": rmse})
    return out


def folded(spark, x):
    """The fold's forecasts of one series of steps."""
    rows = [("e", date(2024, 1, 1) + timedelta(t), t, t % 7, None if math.isnan(v) else float(v)) for t, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "entity_id string, date date, idx int, weekday int, steps double")
    return F_.forecasts(frame, ("steps",)).orderBy("day").collect()


def test_holt_winters_follows_a_weekly_line(spark):
    x = np.array([100 + 2 * t + 10 * (t % 7 == 5) for t in range(140)], float)
    out = folded(spark, x)
    want = [100 + 2 * t + 10 * (t % 7 == 5) for t in range(140, 147)]
    assert [o["value"] for o in out] == pytest.approx(want, rel=0.05)
    assert all(o["lower95"] <= o["lower80"] <= o["value"] <= o["upper80"] <= o["upper95"] for o in out)
    x[30:33] = math.nan
    assert len(folded(spark, x)) == 7 and folded(spark, x[:20]) == []


def test_the_fold_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    for gaps in ((), range(9), range(40, 52), range(7, 14)):
        x = rng.normal(50, 30, 90)
        x[list(gaps)] = math.nan
        want, got = slow_holt_winters(x, 7, True), folded(spark, x)
        assert len(got) == len(want) == 7
        for g, w in zip(got, want, strict=True):
            assert {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in w.items()} == {k: g[k] for k in w}


def test_the_fold_stays_in_the_jvm(spark, sf):
    plan = queries.forecast_holt_winters(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_axes_equal_numpys(spark):
    rng = np.random.default_rng(8)
    names = ("steps", "hrv", "sleep_minutes", "calories")
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4)) + rng.normal(size=4)
    frame = spark.createDataFrame([("e", *map(float, r)) for r in x] + [("short", 1.0, None, 2.0, 3.0)], "entity_id string, " + ", ".join(f"{n} double" for n in names))
    got = F_.axes(frame, names).orderBy("axis").collect()
    w, v = np.linalg.eigh(np.corrcoef(x.T))
    assert [r["entity_id"] for r in got] == ["e"] * 4 and [r["value"] for r in got] == pytest.approx(w[::-1], abs=1e-9)
    for r, u in zip(got, v.T[::-1], strict=True):
        u = u * np.sign(u[np.argmax(np.abs(u))])
        assert r["vector"] == pytest.approx(u, abs=1e-7)


def test_gp_agrees_with_cholesky():
    rng = np.random.default_rng(0)
    t = np.arange(40.0)
    v = np.sin(2 * np.pi * t / 7) + 0.1 * rng.normal(size=40)
    got = M.gp_fit(t, v, False)[0]
    y = (v - v.mean()) / v.std(ddof=1)
    k = M._kernel(t[:, None] - t[None], got["length_scale"], got["periodic_weight"]) + got["noise"] * np.eye(40)
    low = np.linalg.cholesky(k)
    score = -0.5 * y @ np.linalg.solve(k, y) - np.log(np.diag(low)).sum() - 20 * math.log(2 * math.pi)
    assert got["log_likelihood"] == pytest.approx(score)
    assert got["rhythm"]


def test_hmm_finds_three_states():
    rng = np.random.default_rng(1)
    path = np.repeat(rng.integers(0, 3, 40), 7)
    x = np.array([[-2, 2, 0, 0], [0, 0, 0, 0], [2, -2, 1, 0]])[path] + 0.3 * rng.normal(size=(len(path), 4))
    fits = [M.hmm_fit(x, k) for k in (2, 3, 4)]
    best = min(fits, key=lambda f: f["bic"])
    assert best["k"] == 3 and np.allclose(best["a"].sum(axis=1), 1)


def test_ridge_against_the_normal_equations(frame):
    rows = frame.orderBy("idx").toPandas()
    p = ["steps", "active_minutes", "sleep_minutes", "resting_heart_rate"]
    x, y = rows[p].to_numpy()[:-1], rows["hrv"].to_numpy()[1:]
    z, zy = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    beta = np.linalg.solve(z.T @ z + np.eye(4), z.T @ zy)
    got = {r["driver"]: r["beta"] for r in M.attribution(frame, "hrv", tuple(p), 1).collect()}
    assert [got[k] for k in p] == pytest.approx(beta.tolist())


def test_principal_components_against_singular_vectors(frame):
    got = M.factors(frame).filter("component = 0").orderBy("date").collect()
    x = frame.orderBy("idx").toPandas()[list(M.FACTOR_METRICS)].to_numpy(float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    v = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert [r["score"] for r in got] == pytest.approx((z @ v).tolist(), abs=1e-6)
    assert got[0]["explained"] == pytest.approx(s[0] ** 2 / (s**2).sum())
    weights = {w["metric"]: w["weight"] for w in got[0]["loadings"]}
    assert weights == pytest.approx(dict(zip(M.FACTOR_METRICS, v.tolist())))
    assert list(weights.values()) == sorted(weights.values(), key=lambda w: -abs(w))


def slow_forest(x, trees, sample, seed):
    """A tree at a time, a row at a time."""
    rand, size = Mulberry32(seed), min(sample, len(x))
    limit = math.ceil(math.log2(size))

    def grow(rows, level):
        free = [j for j in range(x.shape[1]) if rows and min(r[j] for r in rows) < max(r[j] for r in rows)]
        if level >= limit or len(rows) <= 1 or not free:
            return len(rows)
        j = free[int(rand() * len(free))]
        low, high = min(r[j] for r in rows), max(r[j] for r in rows)
        at = low + rand() * (high - low)
        return j, at, grow([r for r in rows if r[j] < at], level + 1), grow([r for r in rows if not r[j] < at], level + 1)

    def path(node, r, level=0):
        return level + M._expected_depth(node) if isinstance(node, int) else path(node[2] if r[node[0]] < node[1] else node[3], r, level + 1)

    grown = [grow([x[int(rand() * len(x))].tolist() for _ in range(size)], 0) for _ in range(trees)]
    return [2 ** (-sum(path(t, r) for t in grown) / trees / M._expected_depth(size)) for r in x.tolist()]


def test_forest_against_a_loop():
    x = np.random.default_rng(2).normal(size=(40, 3))
    assert M.forest_scores(x, 12, 16, 5).tolist() == pytest.approx(slow_forest(x, 12, 16, 5))


def test_k_means_against_a_loop():
    x = np.random.default_rng(3).normal(size=(45, 2)) + np.repeat([[0, 0], [4, 0], [0, 4]], 15, axis=0)
    labels, centres = M.k_means(x, 3)
    near = lambda r: min(range(3), key=lambda j: sum((r[i] - centres[j][i]) ** 2 for i in range(2)))
    assert labels.tolist() == [near(r) for r in x]
    assert all(centres[j].tolist() == pytest.approx([sum(x[i][c] for i in range(45) if labels[i] == j) / (labels == j).sum() for c in range(2)]) for j in range(3))
    widths = []
    for i in range(45):
        mean = lambda j: np.mean([math.dist(x[i], x[m]) for m in range(45) if labels[m] == j and m != i])  # noqa: E731, B023
        a, b = mean(labels[i]), min(mean(j) for j in range(3) if j != labels[i])
        widths.append((b - a) / max(a, b))
    assert M.silhouette(x, labels, 3) == pytest.approx(np.mean(widths))


def test_hmm_likelihood_against_all_paths():
    rng = np.random.default_rng(4)
    x, mu, var = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.uniform(0.5, 2, size=(2, 2))
    pi, a = np.array([0.3, 0.7]), np.array([[0.8, 0.2], [0.4, 0.6]])
    density = lambda t, s: math.prod(math.exp(-((x[t, d] - mu[s, d]) ** 2) / (2 * var[s, d])) / math.sqrt(2 * math.pi * var[s, d]) for d in range(2))
    weight = {p: pi[p[0]] * math.prod(a[p[t - 1], p[t]] for t in range(1, 6)) * math.prod(density(t, p[t]) for t in range(6)) for p in itertools.product((0, 1), repeat=6)}
    logb = M._log_density(x, mu[None], var[None])
    gamma, _, _, full = M._forward_backward(logb, pi[None], a[None])
    total = sum(weight.values())
    assert full[0] == pytest.approx(math.log(total))
    assert gamma[0, 2, 1] == pytest.approx(sum(w for p, w in weight.items() if p[2] == 1) / total)
    assert tuple(M.viterbi(logb[0], pi, a)) == max(weight, key=weight.get)


def test_network_gradient_lowers_the_error():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    y = np.tanh(x[:, 0]) * 3 + 10
    fit, none = M.net_fit(x, y), M.net_fit(x, y, epochs=1)
    assert fit["rmse"] < 0.5 * none["rmse"] and fit["train_days"] == 64 and fit["importance"][0] == max(fit["importance"])
    assert M.net_fit(x[:44], y[:44]) is None


def test_details_of_clusters_and_states(frame):
    rows = M.clusters(frame).collect()
    raw = {r["date"]: r for r in frame.collect()}
    first = [r for r in rows if r["rank"] == 0]
    assert first[0]["size"] == max(r["size"] for r in rows) and len(first[0]["distinguishing"]) == 3
    assert first[0]["centroid"][0] == pytest.approx(np.mean([raw[r["date"]]["steps"] for r in first]))
    z = [abs(d["z"]) for d in first[0]["distinguishing"]]
    assert z == sorted(z, reverse=True)
    state = M.states(frame).filter("last").first()
    assert sum(o["probability"] for o in state["outward"]) == pytest.approx(state["change"])
    assert [o["probability"] for o in state["outward"]] == sorted((o["probability"] for o in state["outward"]), reverse=True)
    assert state["outward"][0]["name"] == state["likely_next"] and {p["metric"] for p in state["profile"]} == set(M.STATE_METRICS)


def test_decomposition_falls_back_to_sleep(spark, history):
    few = history.filter("data_type <> 'steps' OR start_time > '2024-06-20'")
    x = Insights(few, UNTIL, "UTC")
    assert [r["metric"] for r in x.layers["decomposition"].collect()] == ["sleep_minutes"]
    x.close()


def test_documents(history, spark, tmp_path):
    x = Insights(history, UNTIL, "UTC")
    x.write_documents(str(tmp_path / "d"))
    x.close()
    (line,) = [r[0] for r in spark.read.text(str(tmp_path / "d")).collect()]
    found = json.loads(line)
    assert found["until"] == UNTIL and set(x.layers) < set(found)
    assert {"id", "headline", "detail", "tone", "source"} <= set(found["findings"][0]) and found["baseline"][0]["n"] > 3


def test_insights_and_findings(history):
    x = Insights(history, UNTIL, "UTC")
    got = {r["id"]: r for r in x.findings().collect()}
    assert all(r["detail"] for r in got.values()) and "typically" in got["forecast-sleep"]["detail"]
    assert "readiness" in got and "forecast-sleep" in got and "net" in got
    assert x.layers["readiness"].first()["coverage"] == pytest.approx(1.0)
    joined = x.states_with_factors()
    assert joined.filter("name IS NULL").count() == 0
    assert x.history_with_forecast().filter("forecast IS NOT NULL").count() == 8
