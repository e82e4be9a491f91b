"""Results computed by hand: samples every 10 s from 0 to 40 s, evaluated at 40 s unless said otherwise."""

import math

import pytest

from tessellar.errors import Invalid
from tessellar.plans import engine

from .helpers import STALE, at, rows_of, series, store


@pytest.fixture(scope="module")
def held(spark):
    rows = []
    for text, values in (
        ("http_requests_total{job=api,route=/checkout,instance=a}", [0, 10, 20, 30, 40]),
        ("http_requests_total{job=api,route=/checkout,instance=b}", [0, 5, 10, 15, 20]),
        ("http_requests_total{job=api,route=/search,instance=a}", [0, 2, 4, 6, 8]),
        ("temperature{sensor=rack-a}", [10, 12, 14, 16, 18]),
        ("gauge_value{series=a}", [1, 2, 4, 8, 16]),
        ("reset_counter{job=a}", [0, 5, 10, 2, 4]),
        ("missing{env=,shard=explicit}", [1, 1, 1, 1, 1]),
        ("missing{shard=absent}", [2, 2, 2, 2, 2]),
        ("missing{env=prod,shard=prod}", [3, 3, 3, 3, 3]),
        ("stale_only{job=api}", [None, None, None, None, STALE]),
        ("stale_mid{job=api}", [0, 10, STALE, 30, 40]),
        ("odd{k=nan}", [1, 2, 3, 4, math.nan]),
        ("odd{k=inf}", [1, 2, 3, 4, math.inf]),
        ("odd{k=num}", [1, 2, 3, 4, 5]),
        ("lat_bucket{le=0.1}", [0, 1, 2, 3, 4]),
        ("lat_bucket{le=0.5}", [0, 2, 4, 6, 8]),
        ("lat_bucket{le=+Inf}", [0, 3, 6, 9, 10]),
        ("info{job=api,version=7}", [1, 1, 1, 1, 1]),
    ):
        rows += series(text, values)
    made = store(spark, rows, unique=True)
    made.samples = made.samples.cache()
    return made


CASES = [
    ("sum by (route) (rate(http_requests_total[40s]))", {"route=/checkout": 1.5, "route=/search": 0.2}),
    ("increase(reset_counter[40s])", {"job=a": (4 - 5 + 10) * (30 + 10) / 30}),
    ("resets(reset_counter[1m])", {"job=a": 1}),
    ("changes(gauge_value[1m])", {"series=a": 4}),
    ("irate(reset_counter[40s])", {"job=a": 0.2}),
    ("idelta(gauge_value[40s])", {"series=a": 8}),
    ("delta(gauge_value[40s])", {"series=a": 14 * 40 / 30}),
    ("sum_over_time(gauge_value[40s])", {"series=a": 30}),
    ("avg_over_time(gauge_value[40s])", {"series=a": 7.5}),
    ("min_over_time(gauge_value[40s])", {"series=a": 2}),
    ("max_over_time(gauge_value[40s])", {"series=a": 16}),
    ("count_over_time(gauge_value[40s])", {"series=a": 4}),
    ("present_over_time(gauge_value[40s])", {"series=a": 1}),
    ("last_over_time(gauge_value[40s])", {"__name__=gauge_value,series=a": 16}),
    ("stdvar_over_time(temperature[40s])", {"sensor=rack-a": 5}),
    ("quantile_over_time(0.5, temperature[1m])", {"sensor=rack-a": 14}),
    ("deriv(temperature[1m])", {"sensor=rack-a": 0.2}),
    ("predict_linear(temperature[1m], 10)", {"sensor=rack-a": 20}),
    ("double_exponential_smoothing(temperature[1m], 0.5, 0.5)", {"sensor=rack-a": 18}),
    ("holt_winters(temperature[1m], 1, 0)", {"sensor=rack-a": 18}),
    ('missing{env=""}', {"__name__=missing,env=,shard=explicit": 1, "__name__=missing,shard=absent": 2}),
    ("stale_only", {}),
    ("absent(stale_only)", {"": 1}),
    ('absent(nothing{job="api",x=~"y"})', {"job=api": 1}),
    ('absent_over_time(stale_only{job="api"}[5m])', {"job=api": 1}),
    ("absent(temperature)", {}),
    ("rate(stale_mid[40s])", {"job=api": 30 * (40 / 30 / 40)}),
    ("max_over_time(odd{k='nan'}[40s])", {"k=nan": 4}),
    ("delta(odd{k='inf'}[40s])", {}),
    ("max(odd)", {"": math.inf}),
    ("min(odd{k=~'nan|num'})", {"": 5}),
    ("avg(odd{k=~'inf|num'})", {"": math.inf}),
    ("stddev(odd)", {"": math.nan}),
    ("topk(1, odd{k!='inf'})", {"__name__=odd,k=num": 5}),
    ("bottomk(2, odd{k!='inf'})", {"__name__=odd,k=num": 5, "__name__=odd,k=nan": math.nan}),
    ("count_values('v', odd)", {"v=NaN": 1, "v=+Inf": 1, "v=5": 1}),
    ("quantile(0.5, http_requests_total)", {"": 20}),
    ("group by (job) (http_requests_total)", {"job=api": 1}),
    ("histogram_quantile(0.5, lat_bucket)", {"": 0.1 + 0.4 * (5 - 4) / (8 - 4)}),
    ("histogram_quantile(0.99, lat_bucket)", {"": 0.5}),
    ("histogram_quantile(2, lat_bucket)", {"": math.inf}),
    ("histogram_count(lat_bucket)", {}),
    ("-temperature", {"sensor=rack-a": -18}),
    ("2 - temperature", {"sensor=rack-a": -16}),
    ("temperature > 20", {}),
    ("temperature >= bool 18", {"sensor=rack-a": 1}),
    ("20 > temperature", {"__name__=temperature,sensor=rack-a": 18}),
    ("temperature % 5", {"sensor=rack-a": 3}),
    ("odd == odd", {"__name__=odd,k=inf": math.inf, "__name__=odd,k=num": 5}),
    ("temperature offset 20s", {"__name__=temperature,sensor=rack-a": 14}),
    ("timestamp(temperature offset 15s)", {"sensor=rack-a": 20}),
    ("http_requests_total{route='/checkout'} * on (job) group_left (version) info", {"instance=a,job=api,route=/checkout,version=7": 40, "instance=b,job=api,route=/checkout,version=7": 20}),
    ("info * on (job) group_right (version) http_requests_total{route='/search'}", {"instance=a,job=api,route=/search,version=7": 8}),
    ("http_requests_total / ignoring (instance) group_left () sum without (instance) (http_requests_total)", {"instance=a,job=api,route=/checkout": 40 / 60, "instance=b,job=api,route=/checkout": 20 / 60, "instance=a,job=api,route=/search": 1}),
    ("http_requests_total and on (instance) http_requests_total{route='/search'}", {"__name__=http_requests_total,instance=a,job=api,route=/checkout": 40, "__name__=http_requests_total,instance=a,job=api,route=/search": 8}),
    ("http_requests_total unless on (instance) http_requests_total{route='/search'}", {"__name__=http_requests_total,instance=b,job=api,route=/checkout": 20}),
    ("info or temperature", {"__name__=info,job=api,version=7": 1, "__name__=temperature,sensor=rack-a": 18}),
    ("label_replace(info, 'v', 'x$1', 'version', '(.*)')", {"__name__=info,job=api,v=x7,version=7": 1}),
    ("label_replace(info, 'v', 'x', 'version', '8')", {"__name__=info,job=api,version=7": 1}),
    ("label_replace(info, 'j', '[$1]', 'job', 'p(.)')", {"__name__=info,job=api,j=a[i],version=7": 1}),
    ("label_join(info, 'j', '-', 'job', 'none', 'version')", {"__name__=info,j=api--7,job=api,version=7": 1}),
    ("vector(scalar(temperature) + 2)", {"": 20}),
    ("vector(scalar(odd))", {"": math.nan}),
    ("time() / 2", {"": 20}),
    ("day_of_week()", {"": 4}),
    ("hour(temperature * 3600)", {"sensor=rack-a": 18}),
    ("clamp(temperature, 5, 2)", {}),
    ("clamp_max(odd, 4)", {"k=inf": 4, "k=nan": 4, "k=num": 4}),
    ("round(temperature, 5)", {"sensor=rack-a": 20}),
    ("sgn(-temperature)", {"sensor=rack-a": -1}),
    ("{__name__=~'temp.*'}", {"__name__=temperature,sensor=rack-a": 18}),
]


@pytest.mark.parametrize("query, want", CASES, ids=[c[0] for c in CASES])
def test_instant(spark, held, query, want):
    got = at(spark, held, query)
    norm = lambda d: {",".join(sorted(k.split(","))): v for k, v in d.items()}
    got, want = norm(got), norm(want)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert math.isnan(v) and math.isnan(got[k]) or got[k] == pytest.approx(v, rel=1e-12), (k, got[k], v)


def test_range_is_instants(spark, held):
    """A range query gives at each step what an instant query gives there."""
    for query in ("rate(http_requests_total[20s])", "sum(gauge_value) + 1", "max_over_time(temperature[15s])", "changes(reset_counter[25s])", "absent_over_time(stale_mid[5s])", "gauge_value", "deriv(temperature[30s])", "predict_linear(gauge_value[30s] offset 5s, 4)", "stddev_over_time(gauge_value[40s])", "stdvar_over_time(odd[30s])", "delta(odd[30s])", "irate(reset_counter[30s])", "idelta(odd[25s])", "resets(reset_counter[35s])", "resets(odd[30s])", "delta(stale_mid[40s])", "max_over_time(odd[15s])", "avg_over_time(gauge_value[20s] offset 10s)"):
        got = rows_of(engine.range_query(spark, held, query, 5_000, 45_000, 7_000))
        want = {}
        for t in range(5_000, 45_001, 7_000):
            want |= rows_of(engine.instant(spark, held, query, t))
        assert got.keys() == want.keys(), query
        assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9, nan_ok=True) for k in want), query


@pytest.mark.parametrize(
    "query, message",
    [("http_requests_total + on (job) info", "duplicate left-hand series"), ("info + on (job) http_requests_total", "duplicate right-hand series"), ("info * on (job) group_left () http_requests_total", "group_left"), ("http_requests_total * on (job) group_right () info", "group_right")],
)
def test_cardinality(spark, held, query, message):
    with pytest.raises(Exception, match=message):
        engine.instant(spark, held, query, 40_000).collect()


def test_parameters(spark, held):
    for query in ("topk(1.5, info)", "topk(-1, info)", "quantile(scalar(info), info)", "double_exponential_smoothing(info[1m], 2, 0.5)", "round(info, time())"):
        with pytest.raises(Invalid):
            engine.instant(spark, held, query, 40_000)


def test_sort(spark, held):
    got = [r["value"] for r in engine.instant(spark, held, "sort(odd)", 40_000).collect()]
    assert got[:2] == [5, math.inf] and math.isnan(got[2])
    got = [r["value"] for r in engine.instant(spark, held, "sort_desc(odd)", 40_000).collect()]
    assert got[:2] == [math.inf, 5] and math.isnan(got[2])


def test_last_write_wins(spark):
    rows = series("m{a=b}", [1, 2, 3]) + series("m{a=b}", [None, 20], seq=5) + series("m{a=b}", [None, 30], seq=2)
    assert at(spark, store(spark, rows), "sum_over_time(m[1m])") == {"a=b": 24}


def test_plans_do_not_multiply(spark, held):
    """No nested-loop or Cartesian join, no Python; functions of neighbours shuffle once, and samples are repeated for windows only in slots."""
    for query in ("rate(http_requests_total[1m])", "irate(http_requests_total[1m])", "idelta(temperature[1m])", "delta(temperature[1m])", "resets(reset_counter[1m])", "changes(temperature[1m])", "stddev_over_time(temperature[1m])", "deriv(temperature[1m])", "max_over_time(temperature[1m])"):
        frame = engine.range_query(spark, held, query, 0, 600_000, 15_000)
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan and "collect_list" not in plan, query
        neighbours = query.split("(")[0] in ("rate", "irate", "idelta", "delta", "resets", "changes")
        assert plan.count("Exchange hashpartitioning") == (1 if neighbours else 2), query
        assert plan.index("Generate") < plan.rindex("HashAggregate"), query  # plans read from the top: slots are made before they are repeated


def test_overlapping_windows_are_not_held(spark, held):
    """Each window is made from a list of its slots: behind the rows that are repeated for windows there is no aggregate or sort, whose memory would grow with the windows."""
    for query in ("rate(http_requests_total[1m])", "delta(temperature[1m])", "resets(reset_counter[1m])", "changes(temperature[1m])", "stddev_over_time(temperature[1m])", "predict_linear(temperature[1m], 60)", "avg_over_time(temperature[1m])"):
        plan = engine.range_query(spark, held, query, 0, 600_000, 15_000)._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan.split("Generate")[0] and "Sort" not in plan.split("Generate")[0], query


def test_regression_of_samples_close_together(spark):
    """Two samples a few ms apart, in one slot or in two, at the end of a window of a day; the line through them is known."""
    hour = 3_600_000
    for first, second in ((23 * hour + 1000, 23 * hour + 1003), (23 * hour, 23 * hour + 1)):
        rows = series("m{a=b}", [100.25], step_ms=1) + series("m{a=b}", [None, 350.75], step_ms=1)
        rows = [(*r[:2], t, *r[3:]) for r, t in zip(rows, (first, second), strict=True)]
        for end in (24 * hour, 40 * hour):
            got = rows_of(engine.range_query(spark, store(spark, rows, unique=True), "predict_linear(m[1d], 3600)", end, end + hour, hour))
            slope = 250.5 / (second - first)
            want = 100.25 + slope * (end + hour - first)
            assert len(got) == 2 and got[(end, (("a", "b"),))] == pytest.approx(want, rel=1e-13)
