"""The registered queries over the test tables, one for each operator, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog_ingest
from .functions.names import label_name
from .model import flat
from .operators.grid import Grid
from .plans import engine
from .sources import tables
from .sources.tables import DAY, ORDERS_AT

HOUR = 3_600_000
DAILY = Grid(1_704_153_600_000, 1_706_659_200_000, DAY)
HOURLY = Grid(1_704_153_600_000, 1_706_659_200_000, HOUR)
DENSE = Grid(1_704_153_600_000, 1_706_659_200_000, 900_000)
ORDERS = Grid(ORDERS_AT, ORDERS_AT)

EV = "ev AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v, event_id FROM events)"


def grid_sql(g: Grid) -> str:
    return f"g AS (SELECT unnest(range({g.start}, {g.end + 1}, {g.step})) AS eval_ms)"


def window_sql(g: Grid, length: int, source: str = "ev", offset: int = 0) -> str:
    """w: each sample beside each evaluation time whose window holds it."""
    return f"{grid_sql(g)}, w AS (SELECT g.eval_ms, s.* FROM g JOIN {source} s ON s.t > g.eval_ms - {offset} - {length} AND s.t <= g.eval_ms - {offset})"


def last_sql(g: Grid, length: int, offset: int = 0, extra: str = "") -> str:
    """b: the newest sample of each series at each evaluation time."""
    return f"WITH {EV}, {window_sql(g, length, offset=offset)}, b AS (SELECT eval_ms, event_type, user_id, max_by(v, t) AS v, max(t) AS t FROM w {extra} GROUP BY ALL)"


@dataclass
class Entry:
    """A query text over a store on a grid, its labels shown as columns, values rounded to digits; sql gives the same."""

    query: str
    grid: Grid
    labels: tuple[str, ...]
    sql: str | None
    digits: int = 7
    store: Callable = tables.event_value

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = engine.evaluate(spark, self.store(spark, sf_dir), self.query, self.grid)
        return flat(out, *self.labels).withColumn("value", F.round("value", self.digits) + F.lit(0.0))


ENTRIES: dict[str, Entry] = {}
BOTH = ("event_type", "user_id")
#: The vector that most entries take: the newest value of the last six hours of each series, each midnight.
LAST = "last_over_time(event_value[6h])"
LAST_SQL = last_sql(DAILY, 6 * HOUR)


def _add(name: str, query: str, sql: str | None, labels: tuple[str, ...] = BOTH, grid: Grid = DAILY, digits: int = 7, store: Callable = tables.event_value) -> None:
    ENTRIES[name] = Entry(query, grid, labels, sql, digits, store)


def _value(expression: str, digits: int = 7) -> str:
    return f"round({expression}, {digits}) + 0.0 AS value"


# selectors
_INSTANT = last_sql(HOURLY, 300_001)
for _name, _matchers, _where in (
    ("p01_metric_name", "", "true"),
    ("p02_equal", '{event_type="click"}', "event_type = 'click'"),
    ("p03_not_equal", '{event_type!="click"}', "event_type <> 'click'"),
    ("p04_match", '{event_type=~"c.*|view"}', "(event_type LIKE 'c%' OR event_type = 'view')"),
    ("p05_not_match", '{event_type!~"c.*|view"}', "NOT (event_type LIKE 'c%' OR event_type = 'view')"),
    ("p02_absent_label", '{no_such_label=""}', "true"),
):
    _add(_name, f"event_value{_matchers}", f"{_INSTANT} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b WHERE {_where}", grid=HOURLY)
_add("p06_name_match", '{__name__=~"event_val.*",event_type="view"}', f"{_INSTANT} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b WHERE event_type = 'view'", grid=HOURLY)
_add("p09_lookback", "event_value", f"{last_sql(DENSE, 300_001)} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b", grid=DENSE)
_add("p09_stale", "event_value", f"WITH {EV}, {window_sql(HOURLY, 300_001)}, b AS (SELECT eval_ms, event_type, user_id, max_by(v, t) AS v, max_by(event_id, t) AS i FROM w GROUP BY ALL) SELECT eval_ms, event_type, user_id, {_value('v')} FROM b WHERE i % 10 <> 0", grid=HOURLY, store=tables.event_stale)
_add("p10_offset", "event_value offset 90m", f"{last_sql(HOURLY, 300_001, 90 * 60_000)} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b", grid=HOURLY)
_add("p10_negative_offset", "event_value offset -30m", f"{last_sql(HOURLY, 300_001, -30 * 60_000)} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b", grid=HOURLY)
_add("p14_negation", f"-{LAST}", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('-v')} FROM b")
_add("s15_last_write_wins", "event_value", f"{_INSTANT} SELECT eval_ms, event_type, user_id, {_value('v + 1')} FROM b", grid=HOURLY, store=tables.event_value_again)

# range functions
_R = f"WITH {EV}, {window_sql(DAILY, DAY)}"
_BY = "GROUP BY eval_ms, event_type, user_id"
for _name, _sql, _digits in (
    ("r10_last_over_time", "max_by(v, t)", 7), ("r11_count_over_time", "CAST(count(*) AS DOUBLE)", 7), ("r12_present_over_time", "1.0", 7), ("r13_sum_over_time", "sum(v)", 7), ("r14_avg_over_time", "avg(v)", 7),
    ("r15_stddev_over_time", "stddev_pop(v)", 7), ("r16_stdvar_over_time", "var_pop(v)", 6), ("r17_min_over_time", "min(v)", 7), ("r18_max_over_time", "max(v)", 7),
):
    _add(_name, f"{_name[4:]}(event_value[1d])", f"{_R} SELECT eval_ms, event_type, user_id, {_value(_sql, _digits)} FROM w {_BY}", digits=_digits)
_add("r19_quantile_over_time", "quantile_over_time(0.75, event_value[1d])", f"{_R} SELECT eval_ms, event_type, user_id, {_value('quantile_cont(v, 0.75)')} FROM w {_BY}")
_XY = "(t - eval_ms) / 1000.0"
_REG = f"{_R}, r AS (SELECT eval_ms, event_type, user_id, regr_slope(v, {_XY}) AS slope, regr_intercept(v, {_XY}) AS intercept FROM w {_BY} HAVING count(*) >= 2)"
_add("r20_deriv", "deriv(event_value[1d])", f"{_REG} SELECT eval_ms, event_type, user_id, {_value('slope', 6)} FROM r", digits=6)
_add("r21_predict_linear", "predict_linear(event_value[1d], 3600)", f"{_REG} SELECT eval_ms, event_type, user_id, {_value('intercept + 3600 * slope', 5)} FROM r", digits=5)
_SMOOTH = f"""WITH RECURSIVE {EV}, {window_sql(DAILY, DAY)}, o AS (SELECT eval_ms, event_type, user_id, v, row_number() OVER (PARTITION BY eval_ms, event_type, user_id ORDER BY t) AS k FROM w),
r AS (SELECT a.eval_ms, a.event_type, a.user_id, CAST(2 AS BIGINT) AS k, b.v AS s, b.v - a.v AS d FROM o a JOIN o b USING (eval_ms, event_type, user_id) WHERE a.k = 1 AND b.k = 2
UNION ALL SELECT eval_ms, event_type, user_id, k, x, 0.3 * (x - s) + 0.7 * d FROM (SELECT r.eval_ms, r.event_type, r.user_id, o.k, r.s, r.d, 0.5 * o.v + 0.5 * (r.s + r.d) AS x FROM r JOIN o ON o.eval_ms = r.eval_ms AND o.event_type = r.event_type AND o.user_id = r.user_id AND o.k = r.k + 1))
SELECT eval_ms, event_type, user_id, {_value("max_by(s, k)", 6)} FROM r GROUP BY eval_ms, event_type, user_id"""
_add("r22_double_exponential_smoothing", "double_exponential_smoothing(event_value[1d], 0.5, 0.3)", _SMOOTH, digits=6)
_SPARSE = f"WITH {EV}, {window_sql(DENSE, HOUR)}"
_add("r23_absent_over_time", 'absent_over_time(event_value{event_type="click"}[1h])', f"{_SPARSE} SELECT eval_ms, 'click' AS event_type, 1.0 AS value FROM g WHERE eval_ms NOT IN (SELECT eval_ms FROM w WHERE event_type = 'click')", ("event_type",), DENSE)
_COUNTER = "c AS (SELECT event_type, user_id, t, CAST(row_number() OVER (PARTITION BY event_type, user_id ORDER BY t, event_id) AS DOUBLE) AS v FROM ev)"
_RESETS = "c AS (SELECT event_type, t, CAST(row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) % 7 AS DOUBLE) AS v FROM ev)"


def _counter_sql(source: str, keys: str, per_second: bool, digits: int, grid: Grid = DAILY) -> str:
    rate = f" / {DAY / 1000.0}" if per_second else ""
    return f"""WITH {EV}, {source}, {window_sql(grid, DAY, "c")},
d AS (SELECT *, lag(v) OVER (PARTITION BY eval_ms, {keys} ORDER BY t) AS p FROM w),
a AS (SELECT eval_ms, {keys}, count(*) AS n, min(t) AS t0, max(t) AS t1, min_by(v, t) AS v0, max_by(v, t) - min_by(v, t) + coalesce(sum(CASE WHEN v < p THEN p END), 0) AS raw FROM d GROUP BY ALL HAVING count(*) >= 2 AND max(t) > min(t)),
f AS (SELECT *, (t1 - t0) / 1000.0 AS span, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - eval_ms + {DAY}) / 1000.0 AS s, (eval_ms - t1) / 1000.0 AS e FROM a),
h AS (SELECT *, CASE WHEN s >= gap * 1.1 THEN gap / 2 ELSE s END AS s1, CASE WHEN e >= gap * 1.1 THEN gap / 2 ELSE e END AS e1 FROM f),
k AS (SELECT *, CASE WHEN raw > 0 AND v0 >= 0 AND span * (v0 / raw) < s1 THEN span * (v0 / raw) ELSE s1 END AS s2 FROM h)
SELECT eval_ms, {keys}, {_value(f"raw * ((span + s2 + e1) / span{rate})", digits)} FROM k"""


_KEYS = "event_type, user_id"
_add("r01_rate", "rate(event_count_total[1d])", _counter_sql(_COUNTER, _KEYS, True, 9), digits=9, store=tables.event_count)
_add("r02_increase", "increase(event_count_total[1d])", _counter_sql(_COUNTER, _KEYS, False, 7), store=tables.event_count)
_add("r01_rate_with_resets", "rate(event_reset_total[1d])", _counter_sql(_RESETS, "event_type", True, 8), ("event_type",), digits=8, store=tables.event_count)
_add("r04_increase_with_resets", "increase(event_reset_total[1d])", _counter_sql(_RESETS, "event_type", False, 7), ("event_type",), store=tables.event_count)
_TWO = f"""WITH {EV}, {_RESETS}, {window_sql(DAILY, DAY, "c")}, r AS (SELECT *, row_number() OVER (PARTITION BY eval_ms, event_type ORDER BY t DESC) AS k FROM w),
z AS (SELECT a.eval_ms, a.event_type, a.v AS v1, b.v AS v0, (a.t - b.t) / 1000.0 AS dt FROM r a JOIN r b ON a.eval_ms = b.eval_ms AND a.event_type = b.event_type AND a.k = 1 AND b.k = 2)"""
_add("r06_irate", "irate(event_reset_total[1d])", f"{_TWO} SELECT eval_ms, event_type, {_value('(CASE WHEN v1 < v0 THEN v1 ELSE v1 - v0 END) / dt', 8)} FROM z", ("event_type",), digits=8, store=tables.event_count)
_add("r07_idelta", "idelta(event_reset_total[1d])", f"{_TWO} SELECT eval_ms, event_type, {_value('v1 - v0')} FROM z", ("event_type",), store=tables.event_count)
_PAIRS = f"WITH {EV}, {_RESETS}, {window_sql(DAILY, DAY, 'c')}, d AS (SELECT *, lag(v) OVER (PARTITION BY eval_ms, event_type ORDER BY t) AS p FROM w)"
_add("r08_changes", "changes(event_reset_total[1d])", f"{_PAIRS} SELECT eval_ms, event_type, CAST(count(CASE WHEN v <> p THEN 1 END) AS DOUBLE) AS value FROM d GROUP BY ALL", ("event_type",), store=tables.event_count)
_add("r09_resets", "resets(event_reset_total[1d])", f"{_PAIRS} SELECT eval_ms, event_type, CAST(count(CASE WHEN v < p THEN 1 END) AS DOUBLE) AS value FROM d GROUP BY ALL", ("event_type",), store=tables.event_count)
_DELTA = f"""{_R}, a AS (SELECT eval_ms, event_type, user_id, count(*) AS n, min(t) AS t0, max(t) AS t1, max_by(v, t) - min_by(v, t) AS raw FROM w {_BY} HAVING count(*) >= 2 AND max(t) > min(t)),
f AS (SELECT *, (t1 - t0) / 1000.0 AS span, (t1 - t0) / 1000.0 / (n - 1) AS gap, (t0 - eval_ms + {DAY}) / 1000.0 AS s, (eval_ms - t1) / 1000.0 AS e FROM a)
SELECT eval_ms, event_type, user_id, {_value("raw * ((span + CASE WHEN s >= gap * 1.1 THEN gap / 2 ELSE s END + CASE WHEN e >= gap * 1.1 THEN gap / 2 ELSE e END) / span)", 6)} FROM f"""
_add("r05_delta", "delta(event_value[1d])", _DELTA, digits=6)
_OVER = f"WITH {EV}, {window_sql(HOURLY, DAY)}"
_add("t07_sliding_sum", "sum_over_time(event_value[1d])", f"{_OVER} SELECT eval_ms, event_type, user_id, {_value('sum(v)')} FROM w {_BY}", grid=HOURLY)
_add("t07_sliding_rate", "sum by (event_type) (increase(event_count_total[1d]))", f"SELECT eval_ms, event_type, {_value('sum(value)', 5)} FROM ({_counter_sql(_COUNTER, _KEYS, False, 15, HOURLY)}) GROUP BY ALL", ("event_type",), HOURLY, 5, tables.event_count)
for _name, _sql, _digits in (("stddev_over_time", "stddev_pop(v)", 6), ("min_over_time", "min(v)", 7), ("avg_over_time", "avg(v)", 7)):
    _add(f"t07_sliding_{_name}", f"{_name}(event_value[1d])", f"{_OVER} SELECT eval_ms, event_type, user_id, {_value(_sql, _digits)} FROM w {_BY}", grid=HOURLY, digits=_digits)
_OVER_REG = f"{_OVER}, r AS (SELECT eval_ms, event_type, user_id, regr_slope(v, {_XY}) AS slope, regr_intercept(v, {_XY}) AS intercept FROM w {_BY} HAVING count(*) >= 2)"
_add("t07_sliding_predict_linear", "predict_linear(event_value[1d], 3600)", f"{_OVER_REG} SELECT eval_ms, event_type, user_id, {_value('intercept + 3600 * slope', 3)} FROM r", grid=HOURLY, digits=3)
_add("t07_sliding_delta", "delta(event_value[1d])", _DELTA.replace(window_sql(DAILY, DAY), window_sql(HOURLY, DAY)), grid=HOURLY, digits=6)
_OVER_RESETS = _PAIRS.replace(window_sql(DAILY, DAY, "c"), window_sql(HOURLY, DAY, "c"))
_add("t07_sliding_resets", "resets(event_reset_total[1d])", f"{_OVER_RESETS} SELECT eval_ms, event_type, CAST(count(CASE WHEN v < p THEN 1 END) AS DOUBLE) AS value FROM d GROUP BY ALL", ("event_type",), HOURLY, store=tables.event_count)
_add("t07_sliding_idelta", "idelta(event_reset_total[1d])", f"{_TWO.replace(window_sql(DAILY, DAY, 'c'), window_sql(HOURLY, DAY, 'c'))} SELECT eval_ms, event_type, {_value('v1 - v0')} FROM z", ("event_type",), HOURLY, store=tables.event_count)
_add("p11_range_window", "count_over_time(event_value[1h])", f"{_SPARSE} SELECT eval_ms, event_type, user_id, CAST(count(*) AS DOUBLE) AS value FROM w {_BY}", grid=DENSE)
_TYPE = label_name("event.type")
_add("p07_dotted_names", 'event.value{event.type="click"}', f"{_INSTANT} SELECT eval_ms, event_type AS {_TYPE}, user_id, {_value('v')} FROM b WHERE event_type = 'click'", (_TYPE, "user_id"), HOURLY, store=tables.event_dotted)

# instant functions
for _name, _arg, _sql in (
    ("f01_abs", f"{LAST} - 200", "abs(v - 200)"), ("f02_ceil", LAST, "ceil(v)"), ("f02_floor", LAST, "floor(v)"), ("f05_ln", LAST, "ln(v)"), ("f05_log2", LAST, "log2(v)"), ("f05_log10", LAST, "log10(v)"),
    ("f06_sgn", f"{LAST} - 200", "CAST(sign(v - 200) AS DOUBLE)"), ("f07_acos", f"{LAST} / 500", "acos(v / 500)"), ("f07_acosh", f"{LAST} + 1", "acosh(v + 1)"), ("f07_asin", f"{LAST} / 500", "asin(v / 500)"), ("f07_asinh", LAST, "asinh(v)"),
    ("f07_atan", LAST, "atan(v)"), ("f07_atanh", f"{LAST} / 500", "atanh(v / 500)"), ("f07_cos", LAST, "cos(v)"), ("f07_cosh", f"{LAST} / 500", "cosh(v / 500)"), ("f07_sin", LAST, "sin(v)"), ("f07_sinh", f"{LAST} / 500", "sinh(v / 500)"),
    ("f07_tan", f"{LAST} / 500", "tan(v / 500)"), ("f07_tanh", f"{LAST} / 500", "tanh(v / 500)"), ("f08_deg", LAST, "v * 180 / pi()"), ("f08_rad", LAST, "v * pi() / 180"), ("f03_round", LAST, "floor(v + 0.5)"),
):
    _add(_name, f"{_name[4:]}({_arg})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value(_sql)} FROM b")
_add("f03_round_to", f"round({LAST}, 5)", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('floor(v / 5 + 0.5) * 5')} FROM b")
_add("f04_clamp", f"clamp({LAST}, 50, 200)", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('least(greatest(v, 50), 200)')} FROM b")
_add("f04_clamp_min", f"clamp_min({LAST}, 50)", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('greatest(v, 50)')} FROM b")
_add("f04_clamp_max", f"clamp_max({LAST}, 200)", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('least(v, 200)')} FROM b")
_AT = "make_timestamp(CAST(floor(v * 3000000) AS BIGINT) * 1000000)"
for _name, _sql in (("minute", f"minute({_AT})"), ("hour", f"hour({_AT})"), ("day_of_month", f"day({_AT})"), ("day_of_week", f"dayofweek({_AT})"), ("day_of_year", f"dayofyear({_AT})"), ("days_in_month", f"day(last_day({_AT}))"), ("month", f"month({_AT})"), ("year", f"year({_AT})")):
    _add(f"f09_{_name}", f"{_name}({LAST} * 3000000)", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, CAST({_sql} AS DOUBLE) AS value FROM b")
_add("f10_timestamp", "timestamp(event_value)", f"{_INSTANT} SELECT eval_ms, event_type, user_id, {_value('t / 1000.0')} FROM b", grid=HOURLY)
_add("f11_time", "time()", f"WITH {grid_sql(DAILY)} SELECT eval_ms, {_value('eval_ms / 1000.0')} FROM g", ())
_add("f12_vector", "vector(time() / 2)", f"WITH {grid_sql(DAILY)} SELECT eval_ms, {_value('eval_ms / 2000.0')} FROM g", ())
_add("f13_scalar", f"vector(scalar(sum({LAST})))", f"{LAST_SQL} SELECT eval_ms, {_value('sum(v)')} FROM b GROUP BY ALL", ())
_add("f14_pi", "pi() * 2", f"WITH {grid_sql(DAILY)} SELECT eval_ms, {_value('pi() * 2')} FROM g", ())
_add("f15_label_replace", f'label_replace({LAST}, "kind", "k-$1", "event_type", "(c|v)[a-z]*")', f"{LAST_SQL} SELECT eval_ms, event_type, user_id, CASE WHEN event_type SIMILAR TO '.*[cv].*' THEN regexp_replace(event_type, '(c|v)[a-z]*', 'k-\\1') ELSE '' END AS kind, {_value('v')} FROM b", ("event_type", "user_id", "kind"))
_add("f16_label_join", f'label_join({LAST}, "both", "/", "event_type", "user_id", "none")', f"{LAST_SQL} SELECT eval_ms, event_type, user_id, event_type || '/' || user_id || '/' AS \"both\", {_value('v')} FROM b", ("event_type", "user_id", "both"))
_add("f17_sort", f"sort({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b ORDER BY eval_ms, v, event_type, user_id")
_add("f17_sort_desc", f"sort_desc({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b ORDER BY eval_ms, v DESC, event_type, user_id")
_add("f18_absent", 'absent(event_value{event_type="click"})', f"{last_sql(HOURLY, 300_001)} SELECT eval_ms, 'click' AS event_type, 1.0 AS value FROM g WHERE eval_ms NOT IN (SELECT eval_ms FROM b WHERE event_type = 'click')", ("event_type",), HOURLY)

# aggregations
for _name, _sql, _digits in (("a01_sum", "sum(v)", 7), ("a02_count", "CAST(count(*) AS DOUBLE)", 7), ("a03_avg", "avg(v)", 7), ("a04_min", "min(v)", 7), ("a05_max", "max(v)", 7), ("a06_stddev", "stddev_pop(v)", 7), ("a07_stdvar", "var_pop(v)", 6), ("a08_group", "1.0", 7)):
    _add(_name, f"{_name[4:]} by (event_type) ({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, {_value(_sql, _digits)} FROM b GROUP BY eval_ms, event_type", ("event_type",), digits=_digits)
_add("a01_sum_without", f"sum without (user_id) ({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, {_value('sum(v)')} FROM b GROUP BY eval_ms, event_type", ("event_type",))
_add("a01_sum_all", f"sum({LAST})", f"{LAST_SQL} SELECT eval_ms, {_value('sum(v)')} FROM b GROUP BY eval_ms", ())
for _name, _order in (("topk", "v DESC"), ("bottomk", "v")):
    _add(f"a09_{_name}", f"{_name} by (event_type) (3, {LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('v')} FROM (SELECT *, row_number() OVER (PARTITION BY eval_ms, event_type ORDER BY {_order}, user_id) AS k FROM b) WHERE k <= 3")
_add("a10_quantile", f"quantile by (event_type) (0.9, {LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, {_value('quantile_cont(v, 0.9)')} FROM b GROUP BY eval_ms, event_type", ("event_type",))
_add("a11_count_values", f'count_values by (event_type) ("rounded", round({LAST}, 50))', f"{LAST_SQL} SELECT eval_ms, event_type, CAST(CAST(floor(v / 50 + 0.5) * 50 AS BIGINT) AS VARCHAR) AS rounded, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY ALL", ("event_type", "rounded"))
_add("q1_flagship", "sum by (event_type) (rate(event_count_total[1d]))", f"SELECT eval_ms, event_type, {_value('sum(value)', 6)} FROM ({_counter_sql(_COUNTER, _KEYS, True, 15)}) GROUP BY ALL", ("event_type",), digits=6, store=tables.event_count)

# operators
for _name, _op, _sql in (("add", "+", "v + 7"), ("subtract", "-", "v - 7"), ("multiply", "*", "v * 7"), ("divide", "/", "v / 7"), ("modulo", "%", "v % 7"), ("power", "^", "pow(v, 2)")):
    _add(f"b02_vector_{_name}_scalar", f"{LAST} {_op} {2 if _op == '^' else 7}", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value(_sql, 6)} FROM b", digits=6)
_add("b01_scalar_scalar", "time() / 86400 + 2 ^ 3 > bool 5", f"WITH {grid_sql(DAILY)} SELECT eval_ms, 1.0 AS value FROM g", ())
_add("b02_scalar_minus_vector", f"1000 - {LAST}", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('1000 - v')} FROM b")
for _name, _op, _sql in (("equal", "==", "="), ("not_equal", "!=", "<>"), ("greater", ">", ">"), ("less", "<", "<"), ("at_least", ">=", ">="), ("at_most", "<=", "<=")):
    _add(f"b03_filter_{_name}", f"round({LAST}, 50) {_op} 100", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('x')} FROM (SELECT *, floor(v / 50 + 0.5) * 50 AS x FROM b) WHERE x {_sql} 100")
_add("b04_bool", f"{LAST} > bool 100", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, CASE WHEN v > 100 THEN 1.0 ELSE 0.0 END AS value FROM b")
_TWICE = f"{LAST_SQL}, w2 AS (SELECT g.eval_ms, s.* FROM g JOIN ev s ON s.t > g.eval_ms - {DAY} AND s.t <= g.eval_ms), m AS (SELECT eval_ms, event_type, user_id, max(v) AS m FROM w2 GROUP BY ALL)"
_add("b05_one_to_one", f"{LAST} / max_over_time(event_value[1d])", f"{_TWICE} SELECT eval_ms, event_type, user_id, {_value('v / m')} FROM b JOIN m USING (eval_ms, event_type, user_id)")
_add("b06_on", f"sum by (event_type) ({LAST}) / on (event_type) count by (event_type) ({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, {_value('sum(v) / count(*)')} FROM b GROUP BY eval_ms, event_type", ("event_type",))
_add("b07_group_left", f"{LAST} / on (event_type) group_left sum by (event_type) ({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('v / s', 6)} FROM b JOIN (SELECT eval_ms, event_type, sum(v) AS s FROM b GROUP BY ALL) USING (eval_ms, event_type)", digits=6)
_add("b08_group_right", f"sum by (event_type) ({LAST}) - on (event_type) group_right {LAST}", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('s - v')} FROM b JOIN (SELECT eval_ms, event_type, sum(v) AS s FROM b GROUP BY ALL) USING (eval_ms, event_type)")
_add("b07_group_left_labels", "order_price offset 0s * on (custkey) group_left (nation, segment) customer_info", f"WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS custkey, o_orderstatus AS status, max_by(o_totalprice, o_orderkey) AS v FROM orders WHERE epoch_us(o_orderdate) // 1000 = {ORDERS_AT} GROUP BY ALL) SELECT CAST({ORDERS_AT} AS BIGINT) AS eval_ms, custkey, status, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, {_value('v', 2)} FROM o JOIN customer ON custkey = CAST(c_custkey AS VARCHAR)", ("custkey", "status", "nation", "segment"), ORDERS, 2, tables.orders)
_add("b09_vector_filter", f"{LAST} > on (event_type) group_left avg by (event_type) ({LAST})", f"{LAST_SQL} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b JOIN (SELECT eval_ms, event_type, avg(v) AS m FROM b GROUP BY ALL) USING (eval_ms, event_type) WHERE v > m")
_PAST = f"{LAST_SQL}, w2 AS (SELECT g.eval_ms, s.* FROM g JOIN ev s ON s.t > g.eval_ms - {12 * HOUR} AND s.t <= g.eval_ms - {6 * HOUR}), m AS (SELECT eval_ms, event_type, user_id, max_by(v, t) AS m FROM w2 GROUP BY ALL)"
_BEFORE = "last_over_time(event_value[6h] offset 6h)"
_add("b10_and", f"{LAST} and {_BEFORE}", f"{_PAST} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b SEMI JOIN m USING (eval_ms, event_type, user_id)")
_add("b11_unless", f"{LAST} unless {_BEFORE}", f"{_PAST} SELECT eval_ms, event_type, user_id, {_value('v')} FROM b ANTI JOIN m USING (eval_ms, event_type, user_id)")
_add("b12_or", f"{LAST} or {_BEFORE}", f"{_PAST} SELECT eval_ms, event_type, user_id, {_value('coalesce(v, m)')} FROM b FULL JOIN m USING (eval_ms, event_type, user_id)")

# histograms
_BUCKETS = "bu AS (SELECT event_type, t, le, sum(CASE WHEN v <= le THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY event_type, le ORDER BY t, event_id) AS v FROM ev, (SELECT unnest([10.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le))"
_QUANTILE = """q AS (SELECT *, 0.9 * max(v) OVER (PARTITION BY eval_ms, event_type) AS r, lag(v, 1, 0.0) OVER p AS below, lag(le, 1, 0.0) OVER p AS lo FROM h WINDOW p AS (PARTITION BY eval_ms, event_type ORDER BY le)),
z AS (SELECT eval_ms, event_type, min_by(CASE WHEN isinf(le) THEN 250.0 ELSE lo + (le - lo) * ((r - below) / (v - below)) END, le) AS x FROM q WHERE v >= r GROUP BY ALL)"""
_add("h01_classic_quantile", "histogram_quantile(0.9, last_over_time(event_value_bucket[1d]))", f"WITH {EV}, {_BUCKETS}, {window_sql(DAILY, DAY, 'bu')}, h AS (SELECT eval_ms, event_type, le, max_by(v, t) AS v FROM w GROUP BY ALL), {_QUANTILE} SELECT eval_ms, event_type, {_value('x')} FROM z", ("event_type",), store=tables.event_buckets)
_DAYS = f"d AS (SELECT event_type, (t // {DAY}) * {DAY} + {DAY} AS t, v FROM ev)"
_ON_DAY = f"WITH {EV}, {_DAYS}, {grid_sql(DAILY)}, x AS (SELECT g.eval_ms, d.event_type, d.v FROM g JOIN d ON d.t = g.eval_ms)"
_add("h06_histogram_count", "histogram_count(event_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("h06_histogram_sum", "histogram_sum(event_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, {_value('sum(v)')} FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("h06_histogram_avg", "histogram_avg(event_exp_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, {_value('avg(v)')} FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_NATIVE = f"{_ON_DAY}, h AS (SELECT eval_ms, event_type, le, CAST(count(CASE WHEN v <= le THEN 1 END) AS DOUBLE) AS v FROM x, (SELECT unnest([10.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL), {_QUANTILE}"
_add("h02_native_quantile", "histogram_quantile(0.9, event_daily)", f"{_NATIVE} SELECT eval_ms, event_type, {_value('x')} FROM z", ("event_type",), store=tables.event_daily)
_EXP = f"""{_ON_DAY}, i AS (SELECT eval_ms, event_type, CAST(ceil(log2(v)) AS INTEGER) - 1 AS idx, CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY ALL),
q AS (SELECT *, sum(c) OVER (PARTITION BY eval_ms, event_type ORDER BY idx) AS seen, 0.9 * sum(c) OVER (PARTITION BY eval_ms, event_type) AS r FROM i),
z AS (SELECT eval_ms, event_type, min_by(pow(2.0, idx) * pow(2.0, (r - (seen - c)) / c), idx) AS x FROM q WHERE seen >= r GROUP BY ALL)"""
_T = {"labels": ("event_type",)}
_LATER = f"eval_ms > {DAILY.start}"
_add("h03_exponential_quantile", "histogram_quantile(0.9, event_exp_daily)", f"{_EXP} SELECT eval_ms, event_type, {_value('x', 6)} FROM z", ("event_type",), digits=6, store=tables.event_daily)
_add("h04_mixed_quantile", 'histogram_quantile(0.9, {__name__=~"event_daily|event_classic_bucket"})', f"{_NATIVE} SELECT eval_ms, event_type, source, {_value('x')} FROM z, (SELECT unnest(['', 'classic']) AS source)", ("event_type", "source"), store=tables.totals_of("event_daily", "event_classic_bucket"))
_CUM = f"{_ON_DAY}, y AS (SELECT event_type, t, CAST(count(*) AS DOUBLE) AS n, sum(v) AS s FROM d GROUP BY ALL), c AS (SELECT event_type, t AS eval_ms, n AS raw, s AS raw_s, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(n) OVER o - n AS first FROM y WINDOW o AS (PARTITION BY event_type ORDER BY t)), k AS (SELECT *, 1 + least(1.0, first / raw) AS f, 1 + least(1.0, first / n) AS fh FROM c WHERE first > 0 AND eval_ms <= {DAILY.end})"
_add("h07_cumulative_count", "histogram_count(increase(event_total[2d]))", f"{_CUM} SELECT eval_ms, event_type, {_value('raw * f', 6)} FROM k", digits=6, store=tables.totals_of("event_total"), **_T)
_add("h07_cumulative_sum", "histogram_sum(increase(event_total[2d]))", f"{_CUM} SELECT eval_ms, event_type, {_value('raw_s * f', 5)} FROM k", digits=5, store=tables.totals_of("event_total"), **_T)
_add("h07_cumulative_buckets", "histogram_quantile(0.9, rate(event_total[2d]))", f"{_NATIVE} SELECT eval_ms, event_type, {_value('x', 6)} FROM z WHERE {_LATER}", digits=6, store=tables.totals_of("event_total"), **_T)
_add("h09_exponential_count", "histogram_count(increase(event_exp_total[2d]))", f"{_CUM} SELECT eval_ms, event_type, {_value('raw * f', 6)} FROM k", digits=6, store=tables.totals_of("event_exp_total"), **_T)
_add("h09_exponential_buckets", "histogram_quantile(0.9, rate(event_exp_total[2d]))", f"{_EXP} SELECT eval_ms, event_type, {_value('x', 6)} FROM z WHERE {_LATER}", digits=6, store=tables.totals_of("event_exp_total"), **_T)
_add("h11_component_hints", "histogram_count(increase(event_hinted[2d]))", f"{_CUM} SELECT eval_ms, event_type, {_value('n * fh', 6)} FROM k", digits=6, store=tables.totals_of("event_hinted"), **_T)
_add("h12_downscaled_sum", 'histogram_quantile(0.9, sum by (event_type) ({__name__=~"event_exp_daily|event_fine_daily"}))', f"{_EXP} SELECT eval_ms, event_type, {_value('x', 6)} FROM z", digits=6, store=tables.totals_of("event_exp_daily", "event_fine_daily"), **_T)
_add("h05_fraction", "histogram_fraction(50, 250, event_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, {_value('count(CASE WHEN v > 50 AND v <= 250 THEN 1 END) / count(*)')} FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("h07_native_increase", "histogram_count(increase(event_daily[1d]))", f"{_ON_DAY} SELECT eval_ms, event_type, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("h08_native_rate", "histogram_sum(rate(event_daily[1d]))", f"{_ON_DAY} SELECT eval_ms, event_type, {_value('sum(v) / 86400', 6)} FROM x GROUP BY ALL", ("event_type",), digits=6, store=tables.event_daily)
_PARTS = "{'n': count(*), 's': sum(v), 'a': count(CASE WHEN v <= 10 THEN 1 END), 'b': count(CASE WHEN v <= 50 THEN 1 END), 'c': count(CASE WHEN v <= 100 THEN 1 END), 'd': count(CASE WHEN v <= 250 THEN 1 END)}"
_DAILY_PARTS = f"WITH {EV}, {_DAYS}, y AS (SELECT event_type, t, {_PARTS} AS h FROM d GROUP BY ALL), {window_sql(DAILY, 3 * DAY, 'y')}"
_add("h10_native_changes", "changes(event_daily[3d])", f"{_DAILY_PARTS}, p AS (SELECT *, lag(h) OVER (PARTITION BY eval_ms, event_type ORDER BY t) AS before FROM w) SELECT eval_ms, event_type, CAST(count(CASE WHEN before IS NOT NULL AND before <> h THEN 1 END) AS DOUBLE) AS value FROM p GROUP BY ALL", ("event_type",), store=tables.event_daily)
_FALLS = f"""WITH {EV}, {_DAYS}, i AS (SELECT event_type, t, CAST(ceil(log2(v)) AS INTEGER) - 1 AS idx, count(*) AS c FROM d GROUP BY ALL), y AS (SELECT event_type, t, lag(t) OVER (PARTITION BY event_type ORDER BY t) AS p FROM (SELECT DISTINCT event_type, t FROM i)),
f AS (SELECT y.event_type, y.t, bool_or(coalesce(b.c, 0) < a.c) AS falls FROM y JOIN i a ON a.event_type = y.event_type AND a.t = y.p LEFT JOIN i b ON b.event_type = y.event_type AND b.t = y.t AND b.idx = a.idx GROUP BY ALL), {window_sql(DAILY, 3 * DAY, 'y')}"""
_add("h10_native_resets", "resets(event_exp_daily[3d])", f"{_FALLS} SELECT eval_ms, w.event_type, CAST(count(CASE WHEN falls AND p > eval_ms - {3 * DAY} THEN 1 END) AS DOUBLE) AS value FROM w LEFT JOIN f ON f.event_type = w.event_type AND f.t = w.t GROUP BY ALL", ("event_type",), store=tables.event_daily)
_ALL_TYPES = f"{_ON_DAY}, h AS (SELECT eval_ms, '' AS event_type, le, CAST(count(CASE WHEN v <= le THEN 1 END) AS DOUBLE) AS v FROM x, (SELECT unnest([10.0, 50.0, 100.0, 250.0, 'inf'::DOUBLE]) AS le) GROUP BY ALL), {_QUANTILE}"
_add("a12_native_sum_buckets", "histogram_quantile(0.9, sum(event_daily))", f"{_ALL_TYPES} SELECT eval_ms, {_value('x')} FROM z", (), store=tables.event_daily)
_add("a13_exponential_sum_buckets", "histogram_quantile(0.9, avg(event_exp_daily))", f"{_EXP.replace('SELECT eval_ms, event_type, CAST(ceil', """SELECT eval_ms, '' AS event_type, CAST(ceil""")} SELECT eval_ms, {_value('x', 6)} FROM z", (), digits=6, store=tables.event_daily)
_add("a12_native_sum", "histogram_count(sum(event_daily))", f"{_ON_DAY} SELECT eval_ms, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY ALL", (), store=tables.event_daily)
_add("a13_exponential_avg", "histogram_sum(avg(event_exp_daily))", f"{_ON_DAY} SELECT eval_ms, {_value('sum(v) / count(DISTINCT event_type)')} FROM x GROUP BY ALL", (), store=tables.event_daily)
_add("a14_native_count", "count(event_daily)", f"{_ON_DAY} SELECT eval_ms, CAST(count(DISTINCT event_type) AS DOUBLE) AS value FROM x GROUP BY ALL", (), store=tables.event_daily)
_add("b15_native_times_scalar", "histogram_sum(event_daily * 2 / 4)", f"{_ON_DAY} SELECT eval_ms, event_type, {_value('sum(v) / 2')} FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("b16_native_minus_native", "histogram_quantile(0.9, event_total - event_total offset 1d)", f"{_NATIVE} SELECT eval_ms, event_type, {_value('x', 6)} FROM z WHERE {_LATER}", digits=6, store=tables.totals_of("event_total"), **_T)
_add("b17_native_equal_bool", "event_total == bool on (event_type) event_daily", f"{_CUM} SELECT eval_ms, event_type, CASE WHEN first = 0 THEN 1.0 ELSE 0.0 END AS value FROM c WHERE eval_ms <= {DAILY.end}", store=tables.totals_of("event_total", "event_daily"), **_T)
_add("b16_native_plus_native", "histogram_count(event_daily + event_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, CAST(2 * count(*) AS DOUBLE) AS value FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("b17_native_equal", "histogram_count(event_daily == event_daily)", f"{_ON_DAY} SELECT eval_ms, event_type, CAST(count(*) AS DOUBLE) AS value FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("b18_mixed_kinds", "event_daily == bool on (event_type) event_exp_daily", f"{_ON_DAY} SELECT eval_ms, event_type, 0.0 AS value FROM x GROUP BY ALL", ("event_type",), store=tables.event_daily)
_add("b19_native_unless", 'histogram_count(event_daily unless on (event_type) event_total{event_type="click"})', f"{_ON_DAY} SELECT eval_ms, event_type, CAST(count(*) AS DOUBLE) AS value FROM x WHERE event_type <> 'click' GROUP BY ALL", store=tables.totals_of("event_total", "event_daily"), **_T)
_add("b19_native_and", 'histogram_count(event_daily and on (event_type) event_exp_daily{event_type="view"})', f"{_ON_DAY} SELECT eval_ms, event_type, CAST(count(*) AS DOUBLE) AS value FROM x WHERE event_type = 'view' GROUP BY ALL", store=tables.totals_of("event_exp_daily", "event_daily"), **_T)

# projections of typed metrics
_RUN = f"WITH {EV}, {_DAYS}, y AS (SELECT event_type, t, count(*) AS n, sum(v) AS s, count(CASE WHEN v <= 50 THEN 1 END) AS le50, count(CASE WHEN v <= 64 THEN 1 END) AS le64, quantile_cont(v, 0.9) AS q FROM d GROUP BY ALL), {grid_sql(DAILY)}, x AS (SELECT g.eval_ms, y.* FROM g JOIN y ON y.t = g.eval_ms), c AS (SELECT event_type, t AS eval_ms, sum(n) OVER o AS n, sum(s) OVER o AS s, sum(le50) OVER o AS le50, sum(le64) OVER o AS le64 FROM y WHERE t > {DAILY.start} - 0 WINDOW o AS (PARTITION BY event_type ORDER BY t))"
_add("v01_count_rate", "increase(event_daily_count[1d])", f"{_RUN} SELECT eval_ms, event_type, CAST(n AS DOUBLE) AS value FROM x", ("event_type",), store=tables.event_daily)
_add("v02_sum_rate", "increase(event_daily_sum[1d])", f"{_RUN} SELECT eval_ms, event_type, {_value('s')} FROM x", ("event_type",), store=tables.event_daily)
_add("v03_bucket", 'increase(event_daily_bucket{le="50"}[1d])', f"{_RUN} SELECT eval_ms, event_type, '50' AS le, CAST(le50 AS DOUBLE) AS value FROM x", ("event_type", "le"), store=tables.event_daily)
_add("v04_exponential_bucket", 'increase(event_exp_daily_bucket{le="64"}[1d])', f"{_RUN} SELECT eval_ms, event_type, '64' AS le, CAST(le64 AS DOUBLE) AS value FROM x", ("event_type", "le"), store=tables.event_daily)
_add("v05_summary_quantile", 'event_summary_daily{quantile="0.9"}', f"{_RUN} SELECT eval_ms, event_type, '0.9' AS quantile, {_value('q')} FROM x", ("event_type", "quantile"), store=tables.event_daily)
# running totals of consecutive days
_TOTAL = f"{_RUN.split(', x AS (')[0]}, f AS (SELECT event_type, t, n, s, q, t - {DAY} * row_number() OVER (PARTITION BY event_type ORDER BY t) AS run FROM y WHERE t >= {DAILY.start}), u AS (SELECT event_type, t, CAST(sum(n) OVER o AS DOUBLE) AS n, sum(s) OVER o AS s, q FROM f WINDOW o AS (PARTITION BY event_type, run ORDER BY t))"
_add("v09_delta_fragments", "last_over_time(event_daily_count[3d])", f"{_TOTAL} SELECT eval_ms, event_type, max_by(n, t) AS value FROM g JOIN u ON t > eval_ms - {3 * DAY} AND t <= eval_ms GROUP BY ALL", ("event_type",), store=tables.event_daily)
_HALF = Grid(DAILY.start + 30_000, DAILY.end + 30_000, DAY)
_add("v10_seed_read", "last_over_time(event_daily_count[1m])", f"{_TOTAL.replace(grid_sql(DAILY), grid_sql(_HALF))} SELECT eval_ms, event_type, n AS value FROM g JOIN u ON t = eval_ms - 30000", ("event_type",), _HALF, store=tables.event_daily)
_add("v06_all_projections", "event_summary_daily", f"{_TOTAL}, e AS (SELECT * FROM g JOIN u ON t = eval_ms), m AS (SELECT g.eval_ms, d.event_type, quantile_cont(v, 0.5) AS q FROM g JOIN d ON d.t = g.eval_ms GROUP BY ALL) SELECT eval_ms, 'event_summary_daily' AS name, event_type, '0.9' AS quantile, {_value('q', 6)} FROM e UNION ALL SELECT eval_ms, 'event_summary_daily', event_type, '0.5', round(q, 6) + 0.0 FROM m UNION ALL SELECT eval_ms, 'event_summary_daily_count', event_type, '', n FROM e UNION ALL SELECT eval_ms, 'event_summary_daily_sum', event_type, '', round(s, 6) + 0.0 FROM e", ("__name__", "event_type", "quantile"), digits=6, store=tables.event_daily)
_add("v07_name_pattern", 'last_over_time({__name__=~"event_daily_(count|sum)"}[1d])', f"{_TOTAL}, e AS (SELECT * FROM g JOIN u ON t = eval_ms) SELECT eval_ms, 'event_daily_count' AS name, event_type, n AS value FROM e UNION ALL SELECT eval_ms, 'event_daily_sum', event_type, round(s, 6) + 0.0 FROM e", ("__name__", "event_type"), digits=6, store=tables.event_daily)
_add("r03_rate_of_deltas", "rate(event_daily_count[2d])", f"{_RUN}, z AS (SELECT a.eval_ms, a.event_type, sum(b.n) AS n FROM x a JOIN y b ON a.event_type = b.event_type AND b.t > a.eval_ms - {2 * DAY} AND b.t <= a.eval_ms GROUP BY ALL) SELECT eval_ms, event_type, {_value('n / 172800.0', 8)} FROM z", ("event_type",), digits=8, store=tables.event_daily)


def _discover(of: Callable) -> Callable:
    return lambda spark, sf_dir: of(tables.event_count(spark, sf_dir))


OTHERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "d01_metric_names": _discover(lambda s: s.metric_names()),
    "d02_label_names": _discover(lambda s: s.label_names()),
    "d03_label_values": _discover(lambda s: s.label_values("user_id")),
    "d04_latest_window": lambda spark, sf_dir: tables.event_value(spark, sf_dir).latest_window(900_000),
    "d05_raw_window": lambda spark, sf_dir: engine.raw(spark, tables.event_value(spark, sf_dir), 'event_value{event_type="view"}', DAILY.start, DAILY.start + DAY).select("ts_ms", F.round("value", 4).alias("value")),
}
OTHERS_SQL = {
    "d01_metric_names": "SELECT unnest(['event_count_total', 'event_reset_total']) AS name",
    "d02_label_names": "SELECT unnest(['__name__', 'event_type', 'user_id']) AS name",
    "d03_label_values": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events",
    "d04_latest_window": "WITH e AS (SELECT epoch_us(ts) // 1000 AS t FROM events) SELECT min(t) AS min_ms, max(t) AS max_ms FROM e WHERE t // 900000 = (SELECT max(t) // 900000 FROM e)",
    "d05_raw_window": f"WITH {EV} SELECT t AS ts_ms, round(v, 4) AS value FROM ev WHERE event_type = 'view' AND t BETWEEN {DAILY.start} AND {DAILY.start + DAY}",
}


OTHERS |= catalog_ingest.QUERIES
OTHERS_SQL |= catalog_ingest.SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: entry.run for name, entry in ENTRIES.items()} | OTHERS


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql} | OTHERS_SQL
