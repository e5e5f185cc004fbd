"""Models fitted for each entity: numpy within an Arrow grouped map.

A group is one entity's day frame, of at most a couple of years of days, so it is
bounded by the window and not by the data; entities spread over the cluster. Every
model sorts by date first and returns no row when its history is too short."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import Lcg, Mulberry32
from ..functions.stats import interpolated
from ..registry import ATTRIBUTIONS, BY_NAME, CLUSTER_METRICS, FACTOR_METRICS, FOREST_METRICS, GP_METRICS, NET_METRICS, STATE_METRICS
from .frame import long_frame


def filled_frame(frame: DataFrame, metrics: tuple[str, ...], max_gap: int) -> DataFrame:
    """The frame with the metrics' short gaps filled, wide again."""
    rows = interpolated(long_frame(frame, metrics), ["entity_id", "metric"], "idx", "value", max_gap)
    return rows.groupBy("entity_id", "date", "idx", "weekday").agg(*(F.max(F.when(F.col("metric") == m, F.col("filled"))).alias(m) for m in metrics))


def _per_entity(frame: DataFrame, fit: Callable[[pd.DataFrame], list[dict]], schema: str, keys: tuple[str, ...] = ("entity_id",)) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = {k: pdf[k].iloc[0] for k in keys}
        out = [first | r for r in fit(pdf.sort_values("idx", ignore_index=True))]
        return pd.DataFrame([[_clean(r[n]) for n in names] for r in out], columns=names)

    return frame.groupBy(*keys).applyInPandas(run, schema)


def _clean(v: object) -> object:
    if isinstance(v, (float, np.floating)):
        return float(v) if math.isfinite(v) else None
    return v.item() if isinstance(v, np.generic) else v


def standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns less their mean over their sample deviation, or over 1 if that is none."""
    mean = x.mean(axis=0)
    sd = x.std(axis=0, ddof=1) if len(x) > 1 else np.ones(x.shape[1])
    sd = np.where(np.isfinite(sd) & (sd > 0), sd, 1.0)
    return (x - mean) / sd, mean, sd


# --- attribution -----------------------------------------------------------


def attribution(frame: DataFrame, target: str, predictors: tuple[str, ...], lag: int, ridge: float = 1.0, least: int = 14) -> DataFrame:
    """Ridge drivers of a target, lagged: from sufficient statistics of one
    aggregation, so any number of days costs the same at the end.
    entity_id, driver, beta, effect_per_unit, share, r2, n, target, lag."""

    w = Window.partitionBy("entity_id").orderBy("idx")
    y = F.lead(target, lag).over(w) if lag else F.col(target)
    rows = frame.select("entity_id", y.alias("y"), *(F.col(p).alias(f"x{i}") for i, p in enumerate(predictors))).dropna()
    names = ["y", *(f"x{i}" for i in range(len(predictors)))]
    # centred on a fixed origin of the entity, as raw squares lose digits
    g = rows.groupBy("entity_id").agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m_{c}") for c in names), *(F.covar_samp(a, b).alias(f"c_{a}_{b}") for i, a in enumerate(names) for b in names[i:]))
    schema = "entity_id string, driver string, beta double, effect_per_unit double, share double, r2 double, n long, target string, lag int"

    def solve(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                n, k = r.n, len(predictors)
                if n < least:
                    continue
                cov = np.array([[getattr(r, f"c_{min(a, b, key=names.index)}_{max(a, b, key=names.index)}") for b in names] for a in names], dtype=float)
                sd = np.sqrt(np.diag(cov))
                if not sd[0] > 0:
                    continue
                scale = np.where(sd > 0, sd, 1.0)
                z = cov / np.outer(scale, scale) * (n - 1)
                try:
                    beta = np.linalg.solve(z[1:, 1:] + ridge * np.eye(k), z[1:, 0])
                except np.linalg.LinAlgError:
                    continue
                ssr = z[0, 0] - 2 * beta @ z[1:, 0] + beta @ z[1:, 1:] @ beta
                r2, total = max(0.0, 1 - ssr / z[0, 0]), np.abs(beta).sum()
                for i in np.argsort(-np.abs(beta), kind="stable"):
                    out.append((r.entity_id, predictors[i], beta[i], beta[i] * scale[0] / scale[i + 1], abs(beta[i]) / total if total else 0.0, r2, n, target, lag))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return g.mapInPandas(solve, schema)


def attributions(frame: DataFrame) -> DataFrame:
    parts = [attribution(frame, *a) for a in ATTRIBUTIONS]
    return parts[0].unionByName(parts[1])


# --- clusters --------------------------------------------------------------

#: What a cluster is called when a metric stands out above, or below.
CLUSTER_NAMES = {
    "steps": ("High mileage days", "Sedentary days"),
    "active_minutes": ("Hard training days", "Light days"),
    "sleep_minutes": ("Well rested days", "Short sleep days"),
    "resting_heart_rate": ("Elevated strain days", "Deeply recovered days"),
    "hrv": ("Strong recovery days", "Suppressed recovery days"),
}


def k_means(x: np.ndarray, k: int, seed: int = 42, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    rand = Lcg(seed)
    centres = [x[int(rand() * len(x))]]
    while len(centres) < k:
        gap = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        if gap.sum() == 0:
            break
        at = np.flatnonzero(np.cumsum(gap) >= rand() * gap.sum())
        centres.append(x[at[0] if len(at) else 0])
    centres = np.array(centres)
    labels = np.zeros(len(x), dtype=int)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = (new != labels).any()
        labels = new
        centres = np.array([x[labels == j].mean(axis=0) if (labels == j).any() else c for j, c in enumerate(centres)])
        if not moved:
            break
    return labels, centres


def silhouette(x: np.ndarray, labels: np.ndarray, k: int) -> float:
    """Mean width; members of singletons are left out."""
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))
    widths = []
    for i, own in enumerate(labels):
        mates = (labels == own).sum() - 1
        others = [d[i, labels == j].mean() for j in range(k) if j != own and (labels == j).any()]
        if mates and others:
            a, b = d[i, labels == own].sum() / mates, min(others)
            widths.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(widths)) if widths else 0.0


def clusters(frame: DataFrame) -> DataFrame:
    """A row for each day used: date, cluster, its name, size, share, rank by size
    (ties by number), k, silhouette, its members' means, and the three metrics that
    set it apart most with their standardised and plain means."""
    schema = "entity_id string, date date, weekday int, cluster int, name string, size long, share double, rank int, k int, silhouette double, centroid array<double>, distinguishing array<struct<metric:string,z:double,value:double>>"

    def fit(pdf: pd.DataFrame) -> list[dict]:
        raw = pdf[list(CLUSTER_METRICS)].astype(float)
        use = raw.notna().sum(axis=1) >= 3
        days, raw = pdf[use], raw[use]
        if len(raw) < 14 or raw.isna().all().any():
            return []
        plain = raw.fillna(raw.median()).to_numpy()
        x = standardised(plain)[0]
        best = None
        for k in (2, 3, 4):
            if len(x) >= 3 * k:
                labels, centres = k_means(x, k)
                score = silhouette(x, labels, k)
                if best is None or score > best[0]:
                    best = (score, k, labels, centres)
        score, k, labels, centres = best
        names = []
        for c in centres:
            j = int(np.argmax(np.abs(c)))
            names.append(CLUSTER_NAMES[CLUSTER_METRICS[j]][0 if c[j] > 0 else 1])
        sizes = np.bincount(labels, minlength=len(centres))
        rank = {int(c): i for i, c in enumerate(np.argsort(-sizes, kind="stable"))}
        about = []
        for j, c in enumerate(centres):
            means = plain[labels == j].mean(axis=0) if sizes[j] else np.full(len(c), np.nan)
            apart = [{"metric": CLUSTER_METRICS[i], "z": _clean(c[i]), "value": _clean(means[i])} for i in np.argsort(-np.abs(c), kind="stable")[:3]]
            about.append({"name": names[j], "size": int(sizes[j]), "share": sizes[j] / len(x), "rank": rank[j], "k": k, "silhouette": score, "centroid": [_clean(v) for v in means], "distinguishing": apart})
        return [{"date": d, "weekday": w, "cluster": int(c)} | about[c] for d, w, c in zip(days["date"], days["weekday"], labels, strict=True)]

    return _per_entity(frame, fit, schema)


def cluster_weekdays(found: DataFrame) -> DataFrame:
    """Days of each cluster by weekday, zeros kept."""
    return found.groupBy("entity_id", "cluster", "name").pivot("weekday", list(range(7))).count().fillna(0)


# --- principal components --------------------------------------------------


def _complete(pdf: pd.DataFrame, metrics: tuple[str, ...]) -> tuple[pd.DataFrame, np.ndarray]:
    ok = pdf[list(metrics)].notna().all(axis=1)
    return pdf[ok], pdf.loc[ok, list(metrics)].to_numpy(float)


#: What a component is called by the kind of metric that loads it.
MIXED, EFFORT, RECOVERY, BOTH = "Mixed", "How hard the day was", "How well recovered you were", "Load against recovery"


def factors(frame: DataFrame) -> DataFrame:
    """entity_id, component, name, explained, loadings (the largest first), date,
    score. A component's largest loading is positive."""
    schema = "entity_id string, component int, name string, explained double, loadings array<struct<metric:string,weight:double>>, date date, score double"
    activity = [m in ("steps", "active_minutes", "calories") for m in FACTOR_METRICS]

    def fit(pdf: pd.DataFrame) -> list[dict]:
        days, raw = _complete(pdf, FACTOR_METRICS)
        if len(raw) < 24:
            return []
        z = standardised(raw)[0]
        values, vectors = np.linalg.eigh(np.cov(z, rowvar=False))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        if not values.sum() > 0:
            return []
        out = []
        for c in range(2):
            v = vectors[:, c] * np.sign(vectors[np.abs(vectors[:, c]).argmax(), c])
            heavy = np.where(np.abs(v) >= 0.35, np.abs(v), 0)
            act, rec = heavy[activity].sum(), heavy[np.logical_not(activity)].sum()
            name = MIXED if not heavy.any() else EFFORT if act > 1.6 * rec else RECOVERY if rec > 1.6 * act else BOTH
            ordered = [{"metric": FACTOR_METRICS[i], "weight": float(v[i])} for i in np.argsort(-np.abs(v), kind="stable")]
            out += [{"component": c, "name": name, "explained": values[c] / values.sum(), "loadings": ordered, "date": d, "score": s} for d, s in zip(days["date"], z @ v, strict=True)]
        return out

    return _per_entity(filled_frame(frame, FACTOR_METRICS, 2), fit, schema)


# --- isolation forest ------------------------------------------------------


def _expected_depth(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def forest_scores(x: np.ndarray, trees: int = 160, sample: int = 64, seed: int = 2718) -> np.ndarray:
    """Anomaly scores: 2 to the minus mean depth over the expected depth."""
    rand, size = Mulberry32(seed), min(sample, len(x))
    limit, depth = math.ceil(math.log2(size)), np.zeros(len(x))

    def grow(train: np.ndarray, rows: np.ndarray, level: int) -> None:
        """Draws come in pre-order; all rows descend along with the training rows."""
        low, high = (train.min(axis=0), train.max(axis=0)) if len(train) else (np.zeros(1), np.zeros(1))
        varying = np.flatnonzero(high > low)
        if level >= limit or len(train) <= 1 or not len(varying):
            depth[rows] += level + _expected_depth(len(train))
            return
        f = varying[int(rand() * len(varying))]
        split = low[f] + rand() * (high[f] - low[f])
        left, mine = train[:, f] < split, x[rows, f] < split
        grow(train[left], rows[mine], level + 1)
        grow(train[~left], rows[~mine], level + 1)

    for _ in range(trees):
        drawn = np.array([int(rand() * len(x)) for _ in range(size)])
        grow(x[drawn], np.arange(len(x)), 0)
    c = _expected_depth(size)
    return 2.0 ** (-(depth / trees) / c) if c else np.ones(len(x))


def forest(frame: DataFrame) -> DataFrame:
    """entity_id, date, score, flagged, contributors (the metrics of the three largest
    deviations) and those deviations."""
    schema = "entity_id string, date date, score double, flagged boolean, contributors array<string>, deviations array<struct<metric:string,z:double>>"

    def fit(pdf: pd.DataFrame) -> list[dict]:
        days, raw = _complete(pdf, FOREST_METRICS)
        if len(raw) < 24:
            return []
        score, z = forest_scores(raw), standardised(raw)[0]
        over = np.flatnonzero(score >= 0.6)
        flagged = set(over[np.argsort(-score[over], kind="stable")][:6].tolist())
        return [
            {"date": d, "score": s, "flagged": i in flagged, "contributors": [FOREST_METRICS[j] for j in top], "deviations": [{"metric": FOREST_METRICS[j], "z": float(z[i, j])} for j in top]}
            for i, (d, s, top) in enumerate(zip(days["date"], score, np.argsort(-np.abs(z), axis=1, kind="stable")[:, :3], strict=True))
        ]

    return _per_entity(filled_frame(frame, FOREST_METRICS, 2), fit, schema)


# --- Gaussian process ------------------------------------------------------

#: The grid of hyper-parameters, the week and its smoothness.
LENGTHS, PERIODIC, NOISE = (3, 5, 10, 20, 40, 80, 120), (0.0, 0.25, 0.5, 1.0), (0.05, 0.1, 0.2, 0.4, 0.6, 0.8, 1.2, 1.8, 2.6)
WEEK, SMOOTH = 7.0, 1.5
#: What the chosen kernel says.
TREND, RHYTHM, NOISY = "trend and weekly rhythm", "weekly rhythm only", "mostly day to day noise"


def _kernel(d: np.ndarray, length: float, weight: float) -> np.ndarray:
    return np.exp(-(d**2) / (2 * length**2)) + weight * np.exp(-2 * np.sin(np.pi * np.abs(d) / WEEK) ** 2 / SMOOTH**2)


def gp_fit(t: np.ndarray, values: np.ndarray, floor: bool, horizon: int = 14) -> list[dict]:
    """Exact marginal likelihood over the grid. The noise only shifts eigenvalues,
    so each kernel is decomposed once for all noise levels."""
    if len(values) < 30:
        return []
    centre, scale = values.mean(), values.std(ddof=1) or 1.0
    y, n, best = (values - centre) / scale, len(values), None
    gaps = t[:, None] - t[None]
    for length in LENGTHS:
        for weight in PERIODIC:
            w, v = np.linalg.eigh(_kernel(gaps, length, weight))
            p = v.T @ y
            for noise in NOISE:
                s = w + noise
                if s.min() <= 0:
                    continue
                score = -0.5 * (p**2 / s).sum() - 0.5 * np.log(s).sum() - 0.5 * n * math.log(2 * math.pi)
                if best is None or score > best[0]:
                    best = (score, length, weight, noise, w, v)
    if best is None:
        return []
    score, length, weight, noise, w, v = best
    alpha = v @ ((v.T @ y) / (w + noise))
    out = []
    for h in range(1, horizon + 1):
        k = _kernel(t - (t[-1] + h), length, weight)
        mean = k @ alpha
        q = v.T @ k
        sd = math.sqrt(max(1e-9, float(_kernel(np.zeros(1), length, weight)[0]) + noise - (q**2 / (w + noise)).sum()))
        native = [z * scale + centre for z in (mean, mean - 1.96 * sd, mean + 1.96 * sd)]
        native = [max(0.0, z) for z in native] if floor else native
        trend, rhythm = length < n / 2, weight > 0
        out.append({"day": h, "mean": native[0], "lower": native[1], "upper": native[2], "length_scale": float(length), "periodic_weight": weight, "noise": noise, "log_likelihood": score, "n": n, "trend": trend, "rhythm": rhythm, "structure": TREND if trend else RHYTHM if rhythm else NOISY})
    return out


def gp_forecasts(frame: DataFrame, metrics: tuple[str, ...] = GP_METRICS) -> DataFrame:
    rows = interpolated(long_frame(frame, metrics), ["entity_id", "metric"], "idx", "value", 2)
    schema = "entity_id string, metric string, day int, mean double, lower double, upper double, length_scale double, periodic_weight double, noise double, log_likelihood double, n int, trend boolean, rhythm boolean, structure string"

    def fit(pdf: pd.DataFrame) -> list[dict]:
        ok = pdf["filled"].notna()
        return gp_fit(pdf.loc[ok, "idx"].to_numpy(float), pdf.loc[ok, "filled"].to_numpy(float), BY_NAME[pdf["metric"].iloc[0]].non_negative)

    return _per_entity(rows, fit, schema, ("entity_id", "metric"))


def gp_history(frame: DataFrame, metrics: tuple[str, ...] = GP_METRICS, last: int = 42) -> DataFrame:
    """entity_id, metric, date, value: the last known values that a forecast follows."""
    rows = interpolated(long_frame(frame, metrics), ["entity_id", "metric"], "idx", "value", 2).filter("filled IS NOT NULL")
    w = Window.partitionBy("entity_id", "metric").orderBy(F.desc("idx"))
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= last).select("entity_id", "metric", "date", F.col("filled").alias("value"))


# --- hidden Markov states --------------------------------------------------


def _log_density(x: np.ndarray, mu: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(restart, day, state) log densities of diagonal Gaussians."""
    d = x[None, :, None, :] - mu[:, None]
    return -0.5 * (d**2 / var[:, None] + np.log(2 * np.pi * var[:, None])).sum(axis=3)


def _forward_backward(logb: np.ndarray, pi: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, summed transitions, and log-likelihoods without and with the
    daily offsets that keep densities in range. Days come first within."""
    top = logb.max(axis=2, keepdims=True)
    b = np.ascontiguousarray(np.exp(logb - top).transpose(1, 0, 2))
    n, r, k = b.shape
    fwd, back, scale = np.empty((n, r, k)), np.ones((n, r, k)), np.empty((n, r, 1))
    p = pi * b[0]
    for t in range(n):
        if t:
            p = np.matmul(p[:, None, :], a)[:, 0, :] * b[t]
        scale[t] = np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        p = p / scale[t]
        fwd[t] = p
    over, backwards = b / scale, np.ascontiguousarray(a.transpose(0, 2, 1))
    for t in range(n - 2, -1, -1):
        back[t] = np.matmul((over[t + 1] * back[t + 1])[:, None, :], backwards)[:, 0, :]
    gamma = fwd * back
    gamma /= gamma.sum(axis=2, keepdims=True)
    xi = np.matmul(fwd[:-1].transpose(1, 2, 0), (over[1:] * back[1:]).transpose(1, 0, 2)) * a
    bare = np.log(scale[:, :, 0]).sum(axis=0)
    return gamma.transpose(1, 0, 2), xi, bare, bare + top.sum(axis=(1, 2))


def hmm_fits(x: np.ndarray, counts: tuple[int, ...], compat: bool = False, restarts: int = 8, rounds: int = 200) -> list[dict]:
    """For each number of states the best of several restarts, all climbing at once:
    states beyond a restart's own have no density. compat leaves the daily offsets
    out of the likelihood."""
    (n, d), most, total = x.shape, max(counts), restarts * len(counts)
    mu, a, pi, own = np.zeros((total, most, d)), np.zeros((total, most, most)), np.zeros((total, most)), np.zeros((total, most), bool)
    for i, k in enumerate(counts):
        rand, at = Mulberry32(7 + k), slice(i * restarts, (i + 1) * restarts)
        mu[at, :k] = [[x[int(rand() * n)] + np.array([(rand() - 0.5) * 0.5 for _ in range(d)]) for _ in range(k)] for _ in range(restarts)]
        a[at, :k, :k] = np.full((k, k), 0.3 / (k - 1)) + np.eye(k) * (0.7 - 0.3 / (k - 1))
        pi[at, :k], own[at, :k] = 1 / k, True
    var = np.ones((total, most, d))
    before, done, final = np.full(total, -np.inf), np.zeros(total, bool), np.full(total, -np.inf)
    for _ in range(rounds):
        go = np.flatnonzero(~done)
        logb = np.where(own[go][:, None, :], _log_density(x, mu[go], var[go]), -np.inf)
        gamma, xi, bare, full = _forward_backward(logb, pi[go], a[go])
        final[go] = bare if compat else full
        weight = np.maximum(gamma.sum(axis=1), 1e-12)
        mu[go] = np.einsum("rtk,td->rkd", gamma, x) / weight[:, :, None]
        gap = x[None, :, None, :] - mu[go][:, None]
        var[go] = np.maximum(np.einsum("rtk,rtkd->rkd", gamma, gap**2) / weight[:, :, None], 0.01)
        a[go], pi[go] = xi / np.maximum(xi.sum(axis=2, keepdims=True), 1e-300), gamma[:, 0]
        done[go] = np.abs(final[go] - before[go]) < 1e-6
        before[go] = final[go]
        if done.all():
            break
    out = []
    for i, k in enumerate(counts):
        best = i * restarts + int(np.nanargmax(final[i * restarts : (i + 1) * restarts]))
        free = k - 1 + k * (k - 1) + 2 * k * d
        out.append({"k": k, "mu": mu[best, :k], "var": var[best, :k], "a": a[best, :k, :k], "pi": pi[best, :k], "ll": float(final[best]), "bic": float(-2 * final[best] + free * math.log(n))})
    return out


def hmm_fit(x: np.ndarray, k: int, compat: bool = False) -> dict:
    return hmm_fits(x, (k,), compat)[0]


def viterbi(logb: np.ndarray, pi: np.ndarray, a: np.ndarray) -> np.ndarray:
    la, lp = np.log(np.maximum(a, 1e-12)), np.log(np.maximum(pi, 1e-12))
    score, back = lp + logb[0], np.zeros(logb.shape, dtype=int)
    for t in range(1, len(logb)):
        step = score[:, None] + la
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + logb[t]
    path = [int(score.argmax())]
    for t in range(len(logb) - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.array(path[::-1])


#: Names of states from the least recovered to the most.
LADDERS = {2: ("Strained", "Recovered"), 3: ("Strained", "Holding", "Recovered"), 4: ("Strained", "Flat", "Holding", "Recovered")}


def state_names(mu: np.ndarray) -> list[str]:
    sign = np.array([0 if m == "active_minutes" else 1 if BY_NAME[m].higher_is_better else -1 for m in STATE_METRICS])
    names = ["Typical"] * len(mu)
    for rank, i in enumerate(np.argsort(mu @ sign, kind="stable")):
        if np.abs(mu[i]).mean() >= 0.35:
            names[i] = LADDERS[len(mu)][rank]
    return names


def states(frame: DataFrame, compat: bool = False) -> DataFrame:
    """A row for each complete day: date, state, name, confidence, and the model's
    count, likelihood and information criterion; share, dwell, chance to change and
    likely next of the state; its profile (standardised means, the largest first) and
    the states it leads to, the likeliest first; run length on the last day's state."""
    schema = (
        "entity_id string, date date, state int, name string, confidence double, state_count int, log_likelihood double, bic double, share double, dwell double, change double, likely_next string, run_length int, last boolean, gaps int, profile array<struct<metric:string,z:double>>, outward array<struct<name:string,probability:double>>"
    )

    def fit(pdf: pd.DataFrame) -> list[dict]:
        days, raw = _complete(pdf, STATE_METRICS)
        if len(raw) < 42:
            return []
        x = standardised(raw)[0]
        m = min(hmm_fits(x, (2, 3, 4), compat), key=lambda f: f["bic"])
        logb = _log_density(x, m["mu"][None], m["var"][None])
        path, gamma = viterbi(logb[0], m["pi"], m["a"]), _forward_backward(logb, m["pi"][None], m["a"][None])[0][0]
        names, run = state_names(m["mu"]), 1
        while run < len(path) and path[-run - 1] == path[-1]:
            run += 1
        out = []
        for i, (d, s) in enumerate(zip(days["date"], path, strict=True)):
            stay = m["a"][s, s]
            others = [j for j in np.argsort(-m["a"][s], kind="stable") if j != s]
            profile = [{"metric": STATE_METRICS[i], "z": float(m["mu"][s, i])} for i in np.argsort(-np.abs(m["mu"][s]), kind="stable")]
            outward = [{"name": names[j], "probability": float(m["a"][s, j])} for j in others]
            out.append({"profile": profile, "outward": outward, "date": d, "state": int(s), "name": names[s], "confidence": gamma[i, s], "state_count": m["k"], "log_likelihood": m["ll"], "bic": m["bic"], "share": (path == s).mean(), "dwell": 1 / (1 - stay) if stay < 1 else math.inf, "change": 1 - stay, "likely_next": names[others[0]] if others else None, "run_length": run, "last": i == len(path) - 1, "gaps": int((np.diff(days["idx"]) > 1).sum())})
        return out

    return _per_entity(filled_frame(frame, STATE_METRICS, 2), fit, schema)


# --- network ---------------------------------------------------------------


def _rmse(e: np.ndarray) -> float:
    return float(np.sqrt(np.mean(e**2)))


def net_fit(x: np.ndarray, y: np.ndarray, hidden: int = 8, epochs: int = 400, rate: float = 0.01, l2: float = 1e-4) -> dict | None:
    """A tanh layer of eight, full-batch Adam, the last fifth of the days held out."""
    n, d = x.shape
    split = int(n * 0.8)
    if n < 45 or split < 24 or n - split < 6:
        return None
    _, mean, sd = standardised(x[:split])
    xz, cy, sy = (x - mean) / sd, y[:split].mean(), y[:split].std(ddof=1) or 1.0
    yz, rand = (y - cy) / sy, Mulberry32(1337)
    w1 = np.array([[(rand() * 2 - 1) * math.sqrt(1 / d) for _ in range(d)] for _ in range(hidden)])
    w2 = np.array([(rand() * 2 - 1) * math.sqrt(1 / hidden) for _ in range(hidden)])
    w = [w1, np.zeros(hidden), w2, np.zeros(1)]
    m1, m2 = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    tx, ty = xz[:split], yz[:split]
    for step in range(1, epochs + 1):
        h = np.tanh(tx @ w[0].T + w[1])
        e = 2 * (h @ w[2] + w[3] - ty)
        dh = e[:, None] * w[2] * (1 - h**2)
        for i, g in enumerate((dh.T @ tx, dh.sum(axis=0), h.T @ e, np.array([e.sum()]))):
            g = g / split + l2 * w[i]
            m1[i], m2[i] = 0.9 * m1[i] + 0.1 * g, 0.999 * m2[i] + 0.001 * g**2
            w[i] = w[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    predict = lambda z: (np.tanh(z @ w[0].T + w[1]) @ w[2] + w[3]) * sy + cy
    test, actual = xz[split:], y[split:]
    error, naive = _rmse(predict(test) - actual), _rmse(x[split:, 0] - actual)
    importance = []
    for c in range(d):
        shuffle, z = Mulberry32(99 + c), test.copy()
        for i in range(len(z) - 1, 0, -1):
            j = int(shuffle() * (i + 1))
            z[i, c], z[j, c] = z[j, c], z[i, c]
        importance.append(_rmse(predict(z) - actual) - error)
    return {"train_days": split, "test_days": n - split, "rmse": error, "baseline_rmse": naive, "improvement": (naive - error) / naive if naive else None, "beats_baseline": error < naive, "importance": importance}


def network(frame: DataFrame) -> DataFrame:
    """Next-day variability from today's metrics: a row for each input with its
    permutation importance, and the model's errors against persistence."""
    schema = "entity_id string, input string, increase_in_error double, harmful boolean, train_days int, test_days int, rmse double, baseline_rmse double, improvement double, beats_baseline boolean"

    def fit(pdf: pd.DataFrame) -> list[dict]:
        raw = pdf[list(NET_METRICS)].to_numpy(float)
        ok = ~np.isnan(raw[:-1]).any(axis=1) & ~np.isnan(raw[1:, 0])
        m = net_fit(raw[:-1][ok], raw[1:, 0][ok]) if len(raw) > 1 else None
        if m is None:
            return []
        order = np.argsort(-np.array(m["importance"]), kind="stable")
        return [{"input": NET_METRICS[i], "increase_in_error": m["importance"][i], "harmful": m["importance"][i] < 0} | m for i in order]

    return _per_entity(filled_frame(frame, NET_METRICS, 2), fit, schema)
