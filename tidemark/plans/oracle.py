"""The registered queries in DuckDB's SQL, where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement, permutations

from ..registry import ANOMALY_METRICS, ATTRIBUTIONS, BASELINE_METRICS, FACTOR_METRICS, FORECAST_METRICS, GP_METRICS, METRICS, SUMMARY, SYNCABLE_TYPES
from ..sources.adapters import EVENT_TYPES, HISTORY_DAYS, HISTORY_UNTIL, PRIORITY_TYPES, SEVENTHS
from .queries import DRIVERS, POINTS

TZ = "Europe/London"
SINCE, UNTIL = "TIMESTAMP '2024-01-08 00:00:00'", "TIMESTAMP '2024-01-22 00:00:00'"


def _case(column: str, names: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _kind(of: Callable[..., str]) -> str:
    return f"CASE n % {len(POINTS)} " + " ".join(f"WHEN {i} THEN {of(*p)}" for i, p in enumerate(POINTS)) + " END"


#: The metrics' pairs on and above the diagonal.
_UPPER = list(combinations_with_replacement(FACTOR_METRICS, 2))


def _local(ts: str, tz: str = TZ) -> str:
    return f"CAST(({ts} AT TIME ZONE 'UTC') AT TIME ZONE '{tz}' AS DATE)"


def _midnight(tz: str) -> str:
    return f"(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AT TIME ZONE '{tz}') AT TIME ZONE 'UTC'"


def events(n: int = 1) -> str:
    return f"r AS (SELECT 'e' || CAST(user_id % {n} AS VARCHAR) entity_id, {_case('event_type', EVENT_TYPES)} data_type, ts start_time, NULL::TIMESTAMP end_time, value, CASE WHEN user_id % 3 = 0 THEN 'PRIMARY' ELSE 'PHONE' END source, props raw FROM events)"


ORDERS = f"r AS (SELECT 'o' entity_id, {_case('o_orderpriority', PRIORITY_TYPES)} data_type, CAST(o_orderdate AS TIMESTAMP) start_time, NULL::TIMESTAMP end_time, o_totalprice value, 'PHONE' source FROM orders)"
HISTORY = f"r AS (SELECT 'h' || CAST(o_custkey % 3 AS VARCHAR) entity_id, [{', '.join(f"'{t}'" for t in SEVENTHS)}][(o_orderkey // {HISTORY_DAYS}) % 7 + 1] data_type, CAST(DATE '{HISTORY_UNTIL}' - CAST(o_orderkey % {HISTORY_DAYS} AS INTEGER) AS TIMESTAMP) + INTERVAL 12 HOUR start_time, NULL::TIMESTAMP end_time, o_totalprice value, CASE WHEN o_custkey % 3 = 0 THEN 'PRIMARY' ELSE 'PHONE' END source FROM orders)"
LINES = "r AS (SELECT 'l' entity_id, 'sleep' data_type, CAST(o_orderdate AS TIMESTAMP) start_time, CAST(l_shipdate AS TIMESTAMP) end_time, l_quantity value, 'PHONE' source FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
DAILY = f"""k AS (SELECT *, {_local("CASE WHEN data_type = 'sleep' THEN coalesce(end_time, start_time) ELSE start_time END")} AS day FROM r WHERE value IS NOT NULL),
p AS (SELECT *, bool_or(source = 'PRIMARY') OVER (PARTITION BY entity_id, data_type, day) AS hp FROM k),
d AS (SELECT entity_id, data_type, day, sum(value) total, avg(value) avg, count(*) n FROM p WHERE NOT hp OR source = 'PRIMARY' GROUP BY ALL)"""


def frame(readings: str, until: str, days: int) -> str:
    """CTEs up to f: the dense day frame."""
    cells = ", ".join(f"max(CASE WHEN data_type = '{m.data_type}' THEN {m.agg} END) {m.name}" for m in METRICS)
    return f"""WITH {readings}, {DAILY},
c AS (SELECT entity_id, CAST(DATE '{until}' - {days - 1} + CAST(i AS INTEGER) AS DATE) AS date, CAST(i AS INTEGER) idx FROM (SELECT DISTINCT entity_id FROM r), range({days}) t(i)),
w AS (SELECT entity_id, day AS date, {cells} FROM d GROUP BY ALL),
f AS (SELECT c.entity_id, c.date, c.idx, CAST(isodow(c.date) - 1 AS INTEGER) weekday, {", ".join(m.name for m in METRICS)} FROM c LEFT JOIN w USING (entity_id, date))"""


def long(metrics: tuple[str, ...]) -> str:
    return "l AS (" + " UNION ALL ".join(f"SELECT entity_id, date, idx, weekday, '{m}' metric, CAST({m} AS DOUBLE) AS value FROM f" for m in metrics) + ")"


def _rounded(columns: str, digits: int = 4) -> str:
    """Columns, those marked with * rounded."""
    out = []
    for c in columns.split():
        out.append(f"round({c[1:]}, {digits}) AS {c[1:]}" if c[0] == "*" else c)
    return ", ".join(out)


def _a_hair_above(sql: str) -> str:
    """Every round(x, n) as round(x + a hair, n), as the queries round."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        out.append(sql[at : i + 6])
        depth, j, comma = 1, i + 6, 0
        while depth:
            depth += (sql[j] == "(") - (sql[j] == ")")
            comma = j if sql[j] == "," and depth == 1 else comma
            j += 1
        digits = int(sql[comma + 1 : j - 1])
        out.append(f"CAST({_a_hair_above(sql[i + 6 : comma])} AS DOUBLE) + 1e-{digits + 5}, {digits})")
        at = j
    return "".join([*out, sql[at:]])


EVENT_FRAME, ENTITY_FRAME = frame(events(), "2024-01-30", 30), frame(events(3), "2024-01-30", 30)
ORDER_FRAME, HISTORY_FRAME = frame(ORDERS, "2001-08-01", 365), frame(HISTORY, HISTORY_UNTIL, HISTORY_DAYS)
WIDE = "entity_id date idx weekday " + " ".join(f"*{m.name}" for m in METRICS)

GAPS = f"""{EVENT_FRAME},
h AS (SELECT entity_id, date, idx, CASE WHEN idx NOT IN (0, 4, 8, 9, 13, 14, 15, 19, 20, 21, 22, 29) THEN steps END AS value FROM f)"""


def filled(source: str, keys: str, gap: int) -> str:
    """A query of rows with the column filled."""
    return f"""SELECT a.*, coalesce(value, CASE WHEN ni - pi - 1 <= {gap} THEN pv + (nv - pv) * (idx - pi) / (ni - pi) END) AS filled FROM (
SELECT *, last_value(value IGNORE NULLS) OVER b pv, last_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER b pi,
first_value(value IGNORE NULLS) OVER g nv, first_value(CASE WHEN value IS NOT NULL THEN idx END IGNORE NULLS) OVER g ni FROM {source}
WINDOW b AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY {keys} ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) a"""


def _fold(span: int) -> str:
    a = 2.0 / (span + 1)
    return f"list_reduce(v, lambda s, x: s + {a!r} * (x - s))"


def baseline(metrics: tuple[str, ...]) -> str:
    """CTE b of baselines over l."""
    return f"""{long(metrics)}, g AS (SELECT entity_id, metric, count(*) n, avg(value) mean, stddev_samp(value) stdev, median(value) median, list(value ORDER BY idx) v FROM l WHERE value IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
b AS (SELECT entity_id, metric, n, mean, stdev, median, 1.4826 * list_median(list_transform(v, lambda x: abs(x - median))) mad, {_fold(7)} ewma_fast, {_fold(28)} ewma_slow, v[-1] latest FROM g)"""


DOWN = ", ".join(f"'{m.name}'" for m in METRICS if not m.higher_is_better)
ANOMALY = f"""{ORDER_FRAME}, {long(ANOMALY_METRICS)},
s AS (SELECT *, median(value) OVER x expected, 1.4826 * mad(value) OVER x scale, count(value) OVER x n FROM l WINDOW x AS (PARTITION BY entity_id, metric ORDER BY idx ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
z AS (SELECT *, (value - expected) / scale AS z FROM s WHERE value IS NOT NULL AND n >= 10 AND scale > 0),
a AS (SELECT entity_id, metric, date, value, expected, z, CASE WHEN abs(z) >= 4 THEN 'extreme' WHEN abs(z) >= 3 THEN 'notable' ELSE 'watch' END severity, CASE WHEN z > 0 THEN 'above' ELSE 'below' END direction,
(z > 0) <> (metric NOT IN ({DOWN})) concerning FROM z WHERE abs(z) >= 2)"""
ANOMALY_COLUMNS = "entity_id metric date *value *expected *z severity direction concerning"

LOAD = """e AS (SELECT entity_id, CASE WHEN active_minutes IS NOT NULL OR calories IS NOT NULL THEN coalesce(active_minutes, 0) + coalesce(calories, 0) / 10 END e, max(idx) OVER (PARTITION BY entity_id) - idx AS back FROM f),
ld AS (SELECT entity_id, avg(e) FILTER (WHERE back < 7) acute, avg(e) FILTER (WHERE back < 28) chronic FROM e GROUP BY 1 HAVING count(e) FILTER (WHERE back < 7) >= 3 AND count(e) FILTER (WHERE back < 28) >= 10 AND avg(e) FILTER (WHERE back < 28) <> 0)"""
SLEEP = """sl AS (SELECT entity_id, stddev_pop(s) / avg(s) cv FROM (SELECT entity_id, CASE WHEN max(idx) OVER (PARTITION BY entity_id) - idx < 14 THEN sleep_minutes END s FROM f) GROUP BY 1 HAVING count(s) >= 5 AND avg(s) <> 0)"""
PARTS = f"""{ORDER_FRAME}, {baseline(("hrv", "resting_heart_rate", "sleep_minutes"))}, {LOAD}, {SLEEP},
o AS (SELECT entity_id, metric, latest, CASE WHEN mad > 0 THEN 100.0 / (1 + exp(CASE WHEN metric = 'resting_heart_rate' THEN 1 ELSE -1 END * (latest - median) / mad)) END own, greatest(0, least(100, 100 * latest / 450.0)) target FROM b),
q AS (SELECT entity_id, CASE metric WHEN 'sleep_minutes' THEN 'sleep_duration' ELSE metric END component, CASE WHEN metric = 'sleep_minutes' THEN coalesce(0.5 * target + 0.5 * own, target) ELSE own END score FROM o
UNION ALL SELECT entity_id, 'sleep_consistency', greatest(0, least(100, 100 * (1 - cv / 0.35))) FROM sl
UNION ALL SELECT entity_id, 'load', greatest(0, least(100, 100 - abs(acute / chronic - 1.05) * 180)) FROM ld),
y AS (SELECT entity_id, component, weight, score FROM (SELECT * FROM (SELECT DISTINCT entity_id FROM f), (VALUES ('hrv', 0.3::DOUBLE), ('resting_heart_rate', 0.25), ('sleep_duration', 0.25), ('sleep_consistency', 0.1), ('load', 0.1)) w(component, weight)) LEFT JOIN q USING (entity_id, component))"""

DECOMPOSED = f"""{ORDER_FRAME}, {long(("steps",))}, i AS ({filled("l", "entity_id", 3)}),
t AS (SELECT *, CASE WHEN count(filled) OVER x = 7 THEN avg(filled) OVER x END trend, count(filled) OVER (PARTITION BY entity_id) n FROM i WINDOW x AS (PARTITION BY entity_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
u AS (SELECT *, filled - trend detr FROM t WHERE n >= 21), v AS (SELECT entity_id, weekday, coalesce(avg(detr), 0) effect FROM u GROUP BY ALL),
s AS (SELECT entity_id, weekday, effect - sum(effect) OVER (PARTITION BY entity_id) / 7 seasonal FROM v),
x AS (SELECT entity_id, date, idx, weekday, filled AS value, trend, seasonal, detr - seasonal residual, detr FROM u JOIN s USING (entity_id, weekday))"""

def holt_winters(metrics: tuple[str, ...], horizon: int = 7) -> str:
    """CTEs up to fc: the weekly forecasts of the frame's metrics, day after day."""
    floor = ", ".join(f"'{m.name}'" for m in METRICS if m.non_negative)
    point = "lv + h * sl + se[(m + h - 1) % 7 + 1]"
    low = lambda q: f"CASE WHEN metric IN ({floor}) THEN greatest(0, p - {q} * rmse * sqrt(h)) ELSE p - {q} * rmse * sqrt(h) END"
    return f"""{long(metrics)}, hi AS ({filled("l", "entity_id, metric", 3)}),
hx AS (SELECT entity_id, metric, idx - min(idx) FILTER (WHERE filled IS NOT NULL) OVER (PARTITION BY entity_id, metric) t, filled v, count(filled) OVER (PARTITION BY entity_id, metric) n FROM hi),
hk AS (SELECT entity_id, metric, CAST(t AS INTEGER) t, v FROM hx WHERE t >= 0 AND n >= 21),
h0 AS (SELECT entity_id, metric, count(*) m, avg(v) FILTER (WHERE t < 14) lv, coalesce((avg(v) FILTER (WHERE t BETWEEN 7 AND 13) - avg(v) FILTER (WHERE t < 7)) / 7, 0) sl FROM hk GROUP BY ALL),
hs AS (SELECT entity_id, metric, list(coalesce(e, 0) ORDER BY i) se FROM (SELECT entity_id, metric, t % 7 i, avg(v) - any_value(lv) e FROM hk JOIN h0 USING (entity_id, metric) GROUP BY ALL) GROUP BY ALL),
hw AS (SELECT entity_id, metric, 0 t, m, lv, sl, se, 0.0::DOUBLE sse, 0 n FROM h0 JOIN hs USING (entity_id, metric)
UNION ALL SELECT entity_id, metric, t + 1, m, nl, CASE WHEN v IS NULL THEN sl ELSE 0.05 * (nl - lv) + 0.95 * sl END, CASE WHEN v IS NULL THEN se ELSE list_transform(se, lambda e, i: CASE WHEN i = t % 7 + 1 THEN 0.3 * (v - nl) + 0.7 * s ELSE e END) END,
sse + coalesce((v - (lv + sl + s)) * (v - (lv + sl + s)), 0), n + CASE WHEN v IS NULL THEN 0 ELSE 1 END
FROM (SELECT w.*, k.v, w.se[w.t % 7 + 1] s, CASE WHEN k.v IS NULL THEN w.lv + w.sl ELSE 0.3 * (k.v - w.se[w.t % 7 + 1]) + 0.7 * (w.lv + w.sl) END nl FROM hw w JOIN hk k ON k.entity_id = w.entity_id AND k.metric = w.metric AND k.t = w.t)),
hf AS (SELECT entity_id, metric, h, sqrt(sse / n) rmse, CASE WHEN metric IN ({floor}) THEN greatest(0, {point}) ELSE {point} END p FROM hw, (SELECT CAST(unnest(range(1, {horizon + 1})) AS INTEGER) h) WHERE t = m),
fc AS (SELECT entity_id, metric, h AS day, p AS value, rmse, {low(1.2816)} lower80, {low(1.96)} lower95, p + 1.2816 * rmse * sqrt(h) upper80, p + 1.96 * rmse * sqrt(h) upper95 FROM hf)"""


def _determinant(cells: list[list[str]]) -> str:
    """The sum over permutations, with the sign of their inversions."""
    n, terms = len(cells), []
    for p in permutations(range(n)):
        odd = sum(p[i] > p[j] for i in range(n) for j in range(i + 1, n)) % 2
        terms.append(("-" if odd else "+") + " * ".join(cells[i][p[i]] for i in range(n)))
    return "(" + " ".join(terms) + ")"


def ridge(target: str, drivers: tuple[str, ...], lag: int = 1) -> str:
    """CTEs up to rd: ridge coefficients of the target `lag` days on by Cramer's rule."""
    k = range(len(drivers))
    corr = lambda a, b: "1.0" if a == b else f"r{min(a, b)}{max(a, b)}"
    cells = [[f"(k * {corr(i, j)}" + (" + 1)" if i == j else ")") for j in k] for i in k]
    side = [f"(k * y{i})" for i in k]
    beta = [f"{_determinant([[side[i] if j == c else cells[i][j] for j in k] for i in k])} / {_determinant(cells)} b{c}" for c in k]
    fit = " + ".join(f"b{i} * k * y{i}" for i in k)
    both = " + ".join(f"b{i} * b{j} * k * {corr(i, j)}" for i in k for j in k)
    size = " + ".join(f"abs(b{i})" for i in k)
    rows = " UNION ALL ".join(f"SELECT entity_id, '{d}' driver, b{i} beta, b{i} * sy / s{i} effect_per_unit, abs(b{i}) / ({size}) share, r2, n FROM rf" for i, d in enumerate(drivers))
    return f"""rn AS (SELECT entity_id, lead({target}, {lag}) OVER (PARTITION BY entity_id ORDER BY idx) y, {", ".join(f"{d} x{i}" for i, d in enumerate(drivers))} FROM f),
rg AS (SELECT entity_id, count(*) n, count(*) - 1 AS k, stddev_samp(y) sy, {", ".join(f"stddev_samp(x{i}) s{i}, corr(x{i}, y) y{i}" for i in k)}, {", ".join(f"corr(x{i}, x{j}) r{i}{j}" for i in k for j in k if i < j)} FROM rn WHERE y IS NOT NULL AND {" AND ".join(f"x{i} IS NOT NULL" for i in k)} GROUP BY 1 HAVING count(*) >= 14),
rb AS (SELECT *, {", ".join(beta)} FROM rg), rf AS (SELECT *, greatest(0, 1 - (k - 2 * ({fit}) + {both}) / k) r2 FROM rb), rd AS ({rows})"""


_PAIRS = [(a, b) for i, a in enumerate(("steps", "active_minutes", "sleep_minutes", "hrv")) for b in ("steps", "active_minutes", "sleep_minutes", "hrv")[i + 1 :]]

SHALLOW = HISTORY_FRAME.replace("f AS (", "f0 AS (", 1) + ", f AS (SELECT * REPLACE (idx - 30 AS idx) FROM f0 WHERE idx >= 30)"
READINESS = """fin AS (SELECT entity_id, sum(score * weight) / sum(CASE WHEN score IS NOT NULL THEN weight END) score, coalesce(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) coverage FROM y GROUP BY 1)"""


def _label(column: str) -> str:
    return _case(column, {m.name: m.label for m in METRICS})


def _findings() -> str:
    """The rules over layers that SQL has, each a query of its own."""

    def strength(metric: str) -> str:
        sql = DECOMPOSED.replace(ORDER_FRAME, SHALLOW).replace(long(("steps",)), long((metric,)))
        return f"({sql} SELECT entity_id, '{metric}' metric, greatest(0, 1 - var_pop(residual) / var_pop(detr)) strength, arg_min(weekday, seasonal) weakest FROM x GROUP BY 1)"

    def driver(target: str, drivers: tuple[str, ...], lag: int) -> str:
        best = "(SELECT * FROM rd QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(beta) DESC, driver) = 1)"
        return f"{SHALLOW}, {ridge(target, drivers, lag)} SELECT entity_id, 6::INTEGER, 'driver-{target}-{lag}', {_label('driver')} || ' pulls ' || lower({_label(f"'{target}'")}) || CASE WHEN beta > 0 THEN ' up' ELSE ' down' END, 'neutral' FROM {best} WHERE abs(beta) > 0.1 AND r2 > 0.1"

    drift, days = "(ewma_fast - ewma_slow) / mad", "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"
    minutes, hours = "CAST(floor(m % 60 + 0.5) AS INTEGER)", "CAST(floor(m / 60) AS INTEGER)"
    rules = [
        f"""{PARTS.replace(ORDER_FRAME, SHALLOW)}, {READINESS} SELECT entity_id, 1::INTEGER, 'readiness', printf('Readiness %d of 100: %s', CAST(floor(score + 0.5) AS INTEGER), band), CASE band WHEN 'push' THEN 'good' WHEN 'rest' THEN 'warn' ELSE 'neutral' END
FROM (SELECT *, CASE WHEN score < 35 THEN 'rest' WHEN score < 55 THEN 'easy' WHEN score < 75 THEN 'steady' ELSE 'push' END band FROM fin WHERE score IS NOT NULL)""",
        f"""{ANOMALY.replace(ORDER_FRAME, SHALLOW)} SELECT entity_id, 2::INTEGER, 'anomaly', {_label('metric')} || ' on ' || strftime(date, '%-d %b') || printf(': %.1f deviations ', abs(z)) || direction || ' its usual range', 'warn'
FROM a WHERE concerning AND date >= DATE '{HISTORY_UNTIL}' - 14 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(z) DESC, date DESC, metric) = 1""",
        f"{SHALLOW}, {LOAD} SELECT entity_id, 3::INTEGER, 'load', CASE WHEN acute / chronic > 1.4 THEN 'Load is rising fast' ELSE 'Load is falling off' END, 'warn' FROM ld WHERE acute / chronic > 1.4 OR acute / chronic < 0.7",
        f"{SHALLOW}, {baseline(BASELINE_METRICS)} SELECT entity_id, 4::INTEGER, 'trend', {_label('metric')} || ' is drifting ' || CASE WHEN {drift} > 0 THEN 'up' ELSE 'down' END, 'neutral' FROM b WHERE mad > 0 AND abs({drift}) > 0.75 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs({drift}) DESC, metric) = 1",
        f"WITH st AS {strength('steps')}, sm AS {strength('sleep_minutes')} SELECT entity_id, 5::INTEGER, 'weekday', {_label('metric')} || ' dips on ' || {days}[weakest + 1] || 's', 'neutral' FROM (SELECT * FROM st UNION ALL SELECT * FROM sm WHERE entity_id NOT IN (SELECT entity_id FROM st)) WHERE strength > 0.15",
        *(driver(*a) for a in ATTRIBUTIONS),
        f"""{SHALLOW.replace('WITH', 'WITH RECURSIVE', 1)}, {holt_winters(('sleep_minutes',))} SELECT entity_id, 7::INTEGER, 'forecast-sleep', 'Next week''s nights are put at ' || printf('%dh %02dm', {hours} + CASE WHEN {minutes} = 60 THEN 1 ELSE 0 END, CASE WHEN {minutes} = 60 THEN 0 ELSE {minutes} END), CASE WHEN m >= 420 THEN 'good' ELSE 'warn' END
FROM (SELECT entity_id, avg(value) m FROM fc WHERE metric = 'sleep_minutes' GROUP BY 1)""",
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({r}) t(entity_id, ord, id, headline, tone)" for r in rules)


SQL = {
    "frame_daily": f"WITH {events()}, {DAILY} SELECT {_rounded('entity_id data_type day *total *avg n', 8)} FROM d",
    "frame_daily_window": f"WITH {events()}, {DAILY} SELECT {_rounded('entity_id data_type day *total *avg n', 8)} FROM d",
    "frame_entities": f"WITH {events(7)}, {DAILY} SELECT {_rounded('entity_id data_type day *total *avg n', 8)} FROM d",
    "frame_wide": f"{ENTITY_FRAME} SELECT {_rounded(WIDE, 8)} FROM f",
    "frame_days_with_data": f"{ENTITY_FRAME} SELECT entity_id, count(*) FILTER (WHERE coalesce({', '.join(m.name for m in METRICS)}) IS NOT NULL) AS days FROM f GROUP BY 1",
    "frame_long_history": f"{ORDER_FRAME} SELECT {_rounded('entity_id date idx weekday *hrv *resting_heart_rate *sleep_minutes *active_minutes *steps')} FROM f",
    "frame_incremental": f"WITH {events(7).replace('r AS (', 'e AS (', 1)}, r AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entity_id, data_type, start_time, source ORDER BY value DESC NULLS LAST, raw DESC NULLS LAST) = 1), {DAILY} SELECT {_rounded('entity_id data_type day *total *avg n', 8)} FROM d",
    "end_anchor_day": f"WITH {LINES}, {DAILY} SELECT {_rounded('entity_id data_type day *total *avg n', 8)} FROM d",
    "source_preferred_rows": f"WITH {events(7)}, s AS (SELECT *, bool_or(source = 'PRIMARY') OVER (PARTITION BY entity_id) h FROM r WHERE data_type = 'steps') SELECT entity_id, source, count(*) n, round(sum(value), 4) total FROM s WHERE NOT h OR source = 'PRIMARY' GROUP BY ALL",
    "source_exists": f"WITH {events(7)} SELECT a.data_type, EXISTS (SELECT 1 FROM r b WHERE b.data_type = a.data_type AND source = 'PRIMARY' AND start_time >= {SINCE} AND start_time < {UNTIL}) has_preferred FROM (SELECT DISTINCT data_type FROM r WHERE start_time >= {SINCE} AND start_time < {UNTIL}) a",
    "bucket_hour_sum": f"WITH {events()} SELECT entity_id, date_trunc('hour', start_time) bucket, round(sum(value), 4) AS value FROM r WHERE data_type = 'steps' AND start_time >= {SINCE} AND start_time < {UNTIL} GROUP BY ALL",
    "bucket_day_avg": f"WITH {events()} SELECT entity_id, CAST(date_trunc('day', start_time) AS TIMESTAMP) bucket, round(avg(value), 4) AS value FROM r WHERE data_type = 'heart-rate-variability' GROUP BY ALL",
    "bucket_hour_preferred": f"WITH {events(7)}, s AS (SELECT *, bool_or(source = 'PRIMARY') OVER (PARTITION BY entity_id) h FROM r WHERE data_type = 'active-minutes' AND start_time >= {SINCE} AND start_time < {UNTIL}) SELECT entity_id, date_trunc('hour', start_time) bucket, round(sum(value), 4) AS value FROM s WHERE NOT h OR source = 'PRIMARY' GROUP BY ALL",
    "summary_metrics": f"""WITH {events(7)}, s AS (SELECT *, bool_or(source = 'PRIMARY') OVER (PARTITION BY entity_id, data_type) h FROM r WHERE start_time >= {SINCE} AND start_time < {UNTIL}),
t AS (SELECT entity_id, data_type, sum(value) total, max({{'t': start_time, 's': source, 'v': value}}) l FROM s WHERE NOT h OR source = 'PRIMARY' GROUP BY ALL),
m(metric, data_type, mode, divisor) AS (VALUES {", ".join(f"('{n}', '{t}', '{m}', {d}.0)" for n, t, m, d in SUMMARY)})
SELECT entity_id, metric, round(CASE mode WHEN 'sum' THEN total / divisor ELSE l.v END, 4) AS value, CASE mode WHEN 'latest' THEN l.t END AS at FROM t JOIN m USING (data_type)""",
    "points_page": f"WITH {events()} SELECT entity_id, start_time, value, source, raw FROM r WHERE data_type = 'steps' AND start_time >= {SINCE} AND start_time < {UNTIL} ORDER BY start_time DESC, entity_id, source, value DESC LIMIT 50 OFFSET 100",
    "points_count": f"WITH {events()} SELECT count(*) total FROM r WHERE data_type = 'steps' AND start_time >= {SINCE} AND start_time < {UNTIL}",
    "artifact_flags": f"WITH {events()} SELECT start_time, value, value < 70 artifact, round(value / 1000, 6) thousands FROM r WHERE data_type = 'heart-rate-variability'",
    "interpolate_gap2": f"{GAPS} SELECT {_rounded('entity_id date idx *value *filled')} FROM ({filled('h', 'entity_id', 2)})",
    "interpolate_gap3": f"{GAPS} SELECT {_rounded('entity_id date idx *value *filled')} FROM ({filled('h', 'entity_id', 3)})",
    "baseline": f"{ENTITY_FRAME}, {baseline(BASELINE_METRICS)} SELECT {_rounded('entity_id metric n *mean *stdev *median *mad *ewma_fast *ewma_slow *latest')} FROM b",
    "anomaly_days": f"{ANOMALY} SELECT {_rounded(ANOMALY_COLUMNS)} FROM a",
    "anomaly_recent_top8": f"{ANOMALY} SELECT {_rounded(ANOMALY_COLUMNS)} FROM a WHERE date >= DATE '2001-08-01' - 30 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY abs(z) DESC, date DESC, metric) <= 8",
    "training_load": f"{ENTITY_FRAME}, {LOAD} SELECT entity_id, round(acute, 4) acute, round(chronic, 4) chronic, round(acute / chronic, 4) ratio, CASE WHEN acute / chronic < 0.8 THEN 'Detraining' WHEN acute / chronic > 1.5 THEN 'Spiking' WHEN acute / chronic > 1.3 THEN 'Ramping hard' ELSE 'In the sweet spot' END verdict FROM ld",
    "sleep_consistency": f"{ORDER_FRAME}, {SLEEP} SELECT entity_id, round(cv, 4) cv, round(CAST(greatest(0, least(100, 100 * (1 - cv / 0.35))) AS DOUBLE), 4) score FROM sl",
    "readiness_parts": f"{PARTS} SELECT entity_id, component, weight, round(CAST(score AS DOUBLE), 4) score FROM y",
    "readiness": f"""{PARTS}, fin AS (SELECT entity_id, sum(score * weight) / sum(CASE WHEN score IS NOT NULL THEN weight END) score, coalesce(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) coverage FROM y GROUP BY 1)
SELECT entity_id, round(CAST(score AS DOUBLE), 4) score, CASE WHEN score IS NULL OR score < 35 THEN 'rest' WHEN score < 55 THEN 'easy' WHEN score < 75 THEN 'steady' ELSE 'push' END band, round(CAST(coverage AS DOUBLE), 4) coverage FROM fin""",
    "decompose_days": f"{DECOMPOSED} SELECT {_rounded('entity_id date idx weekday *value *trend *seasonal *residual', 3)} FROM x",
    "decompose_weekdays": f"{DECOMPOSED} SELECT entity_id, weekday, round(max(seasonal), 3) effect FROM x GROUP BY ALL",
    "decompose_strength": f"{DECOMPOSED} SELECT entity_id, round(greatest(0, 1 - var_pop(residual) / var_pop(detr)), 3) strength, arg_max(weekday, seasonal) strongest, round(max(seasonal), 3) strongest_effect, arg_min(weekday, seasonal) weakest, round(min(seasonal), 3) weakest_effect FROM x GROUP BY 1",
    "correlation_pairs": f"{ORDER_FRAME} " + " UNION ALL ".join(f"SELECT entity_id, '{a}' a, '{b}' b, round(corr({a}, {b}), 6) r FROM f GROUP BY entity_id" for a, b in _PAIRS),
    "line_fit": f"{ORDER_FRAME} SELECT entity_id, round(regr_slope(steps, hrv), 5) slope, round(regr_intercept(steps, hrv), 5) intercept, round(coalesce(regr_r2(steps, hrv), 0), 5) r2 FROM f GROUP BY 1",
    "ridge_two": f"""{ORDER_FRAME}, nx AS (SELECT entity_id, lead(hrv) OVER (PARTITION BY entity_id ORDER BY idx) y, steps a, sleep_minutes b FROM f),
g AS (SELECT entity_id, count(*) n, corr(a, y) ay, corr(b, y) "by", corr(a, b) ab FROM nx WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
m AS (SELECT *, (n - 1) AS k, n - 1 + 1.0 AS dg FROM g),
s AS (SELECT *, (k * ay * dg - k * ab * k * "by") / (dg * dg - k * ab * k * ab) ba, (k * "by" * dg - k * ab * k * ay) / (dg * dg - k * ab * k * ab) bb FROM m),
t AS (SELECT *, greatest(0, 1 - (k - 2 * k * (ba * ay + bb * "by") + k * (ba * ba + bb * bb + 2 * ba * bb * ab)) / k) r2 FROM s)
SELECT entity_id, 'steps' driver, round(ba, 6) beta, round(abs(ba) / (abs(ba) + abs(bb)), 6) share, round(r2, 6) r2, n FROM t UNION ALL SELECT entity_id, 'sleep_minutes', round(bb, 6), round(abs(bb) / (abs(ba) + abs(bb)), 6), round(r2, 6), n FROM t""",
    "next_day_pairs": f"{ORDER_FRAME}, nx AS (SELECT entity_id, date, steps today, lead(hrv) OVER (PARTITION BY entity_id ORDER BY idx) tomorrow FROM f) SELECT {_rounded('entity_id date *today *tomorrow')} FROM nx WHERE today IS NOT NULL AND tomorrow IS NOT NULL",
    "persistence_error": f"{ORDER_FRAME}, nx AS (SELECT entity_id, lead(hrv) OVER (PARTITION BY entity_id ORDER BY idx) - hrv e FROM f) SELECT entity_id, round(sqrt(avg(e * e)), 4) rmse, count(e) n FROM nx GROUP BY 1",
    "complete_cases": f"{ORDER_FRAME}, n AS (SELECT entity_id, (steps IS NOT NULL)::INT + (active_minutes IS NOT NULL)::INT + (sleep_minutes IS NOT NULL)::INT + (resting_heart_rate IS NOT NULL)::INT + (hrv IS NOT NULL)::INT k FROM f) SELECT entity_id, count(*) FILTER (WHERE k = 5) complete, count(*) FILTER (WHERE k >= 3) usable FROM n GROUP BY 1",
    "weekday_mix": f"{ORDER_FRAME} SELECT steps > 500000 high, " + ", ".join(f"count(*) FILTER (WHERE weekday = {i}) d{i}" for i in range(7)) + " FROM f WHERE steps IS NOT NULL GROUP BY 1",
    "share_of_total": f"WITH {events()} SELECT data_type, round(sum(value) / sum(sum(value)) OVER (), 8) share FROM r WHERE value IS NOT NULL GROUP BY 1",
    "anomalies_anti_join": f"{ANOMALY} SELECT entity_id, date, round(z, 4) z FROM a WHERE metric = 'steps' AND (entity_id, date) NOT IN (SELECT (entity_id, date) FROM a WHERE metric <> 'steps' AND concerning)",
    "history_union": f"{EVENT_FRAME} SELECT entity_id, date, round(steps, 4) history, NULL::DOUBLE projection FROM f WHERE idx < 23 UNION ALL SELECT entity_id, date, NULL, round(steps, 4) FROM f WHERE idx >= 22",
    "json_extract": f"WITH {events()}, j AS (SELECT data_type, TRY_CAST(json_extract_string(raw, '$.k') AS DOUBLE) n FROM r) SELECT data_type, count(n) parsed, round(sum(n), 4) total, count(DISTINCT n) kinds FROM j GROUP BY 1",
    "json_readings": f"""WITH e AS (SELECT event_id n, ts, event_id // {len(POINTS)} % 5 form FROM events)
SELECT {_kind(lambda t, *_: f"'{t}'")} data_type, CASE form WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END start_time,
CASE WHEN form IN (0, 3, 4) THEN date_trunc('second', ts) + INTERVAL 30 MINUTE END end_time, {_kind(lambda t, f, value, unit: f"CAST({value} AS DOUBLE)")} AS value,
CASE WHEN {_kind(lambda t, f, value, unit: f"CAST({value} AS DOUBLE)")} IS NOT NULL THEN {_kind(lambda t, f, value, unit: f"'{unit}'")} END unit, CASE WHEN n % 3 = 0 THEN 'PRIMARY' ELSE 'unknown' END source FROM e""",
    "points_deep": f"WITH {events()} SELECT row_number() OVER (ORDER BY start_time DESC, entity_id, source, value DESC NULLS LAST) rank, entity_id, start_time, source, value FROM r WHERE data_type = 'steps' QUALIFY rank BETWEEN 176 AND 200",
    "points_cursor": f"WITH {events(7)} SELECT row_number() OVER (ORDER BY start_time DESC, entity_id, source, value DESC NULLS LAST) rank, entity_id, start_time, source, value FROM r WHERE data_type = 'steps' AND start_time >= {SINCE} AND start_time < {UNTIL} QUALIFY rank BETWEEN 31 AND 70",
    "attempts_limited": """WITH RECURSIVE e AS (SELECT event_type AS key, event_id id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) rn FROM events),
w AS (SELECT key, id, ts, rn, ts + INTERVAL 6 HOUR ends, 1 n FROM e WHERE rn = 1 UNION ALL
SELECT e.key, e.id, e.ts, e.rn, CASE WHEN e.ts > w.ends THEN e.ts + INTERVAL 6 HOUR ELSE w.ends END, CASE WHEN e.ts > w.ends THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, id, n <= 10 allowed, CAST(CASE WHEN n <= 10 THEN 0 ELSE ceil((epoch_us(ends) - epoch_us(ts)) / 1000000.0) END AS BIGINT) retry_after FROM w""",
    "load_report": f"""WITH {events()}, k AS (SELECT DISTINCT entity_id, data_type, start_time, source FROM r WHERE minute(start_time) <> 7),
w AS (SELECT data_type, CAST(count(*) FILTER (start_time < {UNTIL}) AS BIGINT) w1, CAST(count(*) FILTER (start_time >= {UNTIL}) AS BIGINT) w2 FROM k GROUP BY 1),
s AS (SELECT data_type, count(*) FILTER (minute(start_time) = 7 AND start_time < {UNTIL}) s1, count(*) FILTER (minute(start_time) = 7 AND start_time >= TIMESTAMP '2024-01-15') s2 FROM r GROUP BY 1)
SELECT 0::INTEGER run, data_type, w1 written, s1 skipped FROM w JOIN s USING (data_type) UNION ALL SELECT 1, data_type, w2, s2 FROM w JOIN s USING (data_type) UNION ALL VALUES (0, 'sleep', 0, 0), (1, 'weight', 0, 0)""",
    "load_marks": f"WITH {events()} SELECT data_type, CASE WHEN data_type = 'sleep' THEN TIMESTAMP '2024-01-22' WHEN data_type = 'weight' OR data_type IN (SELECT data_type FROM r WHERE start_time >= TIMESTAMP '2024-01-15') THEN TIMESTAMP '2024-01-31' ELSE {SINCE} END last_synced_at FROM (SELECT unnest([{', '.join(f"'{t}'" for t in SYNCABLE_TYPES)}]) data_type)",
    "in_batch_last": "SELECT event_type data_type, date_trunc('hour', ts) start_time, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY ALL",
    "incremental_load": f"WITH {events()}, u AS (SELECT DISTINCT entity_id, data_type, start_time, source FROM r) SELECT data_type, count(*) added FROM u WHERE start_time >= {UNTIL} GROUP BY 1",
    "sync_marks": f"WITH {events()}, m AS (SELECT data_type, max(date_trunc('day', start_time)) t FROM r GROUP BY 1) SELECT x.data_type, coalesce(m.t, {SINCE})::TIMESTAMP last_synced_at FROM (SELECT unnest([{', '.join(f"'{t}'" for t in SYNCABLE_TYPES)}]) data_type) x LEFT JOIN m USING (data_type)",
    "data_type_list": f"WITH {events()} SELECT DISTINCT data_type FROM r",
    "local_days": f"WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 23 HOUR + INTERVAL 30 MINUTE t FROM orders) SELECT o_orderkey, {_local('t')} london, {_local('t', 'America/New_York')} new_york FROM t",
    "local_midnights": f"SELECT o_orderkey, {_midnight(TZ)} london, {_midnight('America/New_York')} new_york FROM orders",
    "quantiles": f"{ENTITY_FRAME}, {long(('steps', 'hrv', 'active_minutes'))} SELECT entity_id, metric, round(quantile_cont(value, 0.1), 4) q10, round(quantile_cont(value, 0.5), 4) q50, round(quantile_cont(value, 0.75), 4) q75, round(quantile_cont(value, 0.9), 4) q90 FROM l GROUP BY ALL",
    "forecast_tail": f"{ORDER_FRAME}, {long(GP_METRICS)}, i AS ({filled('l', 'entity_id, metric', 2)}) SELECT entity_id, metric, date, round(filled, 4) AS value FROM i WHERE filled IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id, metric ORDER BY idx DESC) <= 42",
    "covariance_matrix": f"{HISTORY_FRAME}, whole AS (SELECT * FROM f WHERE {' AND '.join(f'{m} IS NOT NULL' for m in FACTOR_METRICS)}) " + " UNION ALL ".join(f"SELECT entity_id, '{a}' a, '{b}' b, round(covar_samp({a}, {b}) / 1e6, 5) covariance, round(corr({a}, {b}), 5) correlation, count(*) n FROM whole GROUP BY 1" for a, b in _UPPER),
    "principal_axes": f"{HISTORY_FRAME}, whole AS (SELECT * FROM f WHERE {' AND '.join(f'{m} IS NOT NULL' for m in FACTOR_METRICS)}), s AS (" + " UNION ALL ".join(f"SELECT entity_id, count(*) n, {1 if a == b else 2} * pow(corr({a}, {b}), 2) r FROM whole GROUP BY 1" for a, b in _UPPER) + f") SELECT entity_id, n, round({len(FACTOR_METRICS)}.0, 6) trace, round(sum(r), 6) squares, round(0.0, 6) residual, round(0.0, 6) tilt FROM s GROUP BY 1, 2 HAVING count(r) = {len(FACTOR_METRICS) * (len(FACTOR_METRICS) + 1) // 2}",
    "findings_relational": _findings(),
    "forecast_holt_winters": f"{ORDER_FRAME.replace('WITH', 'WITH RECURSIVE', 1)}, {holt_winters(FORECAST_METRICS)} SELECT entity_id, metric, day, {', '.join(f'round({c}, 3) {c}' for c in ('value', 'lower80', 'upper80', 'lower95', 'upper95', 'rmse'))} FROM fc",
    "history_frame": f"{HISTORY_FRAME} SELECT {_rounded(WIDE)} FROM f",
    "forecast_history": f"""{HISTORY_FRAME.replace('WITH', 'WITH RECURSIVE', 1).replace('f AS (', 'f0 AS (', 1)}, f AS (SELECT * REPLACE (idx - 30 AS idx) FROM f0 WHERE idx >= 30), {holt_winters(('steps',))},
kn AS (SELECT entity_id, date, steps AS value, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) rn FROM f WHERE steps IS NOT NULL)
SELECT entity_id, date, round(value, 3) AS value, NULL::DOUBLE forecast FROM kn WHERE rn <= 28 UNION ALL SELECT entity_id, date, NULL, round(value, 3) FROM kn WHERE rn = 1
UNION ALL SELECT entity_id, DATE '{HISTORY_UNTIL}' + day, NULL, round(value, 3) FROM fc""",
    "ridge_drivers": f"{ORDER_FRAME}, {ridge('hrv', DRIVERS)} SELECT entity_id, driver, round(beta, 6) beta, round(effect_per_unit, 6) effect_per_unit, round(share, 6) share, round(r2, 6) r2, n, 'hrv' AS target, 1::INTEGER AS lag FROM rd",
}
SQL = {name: _a_hair_above(sql) for name, sql in SQL.items()}
