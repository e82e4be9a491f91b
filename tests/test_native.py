"""Typed metrics: projections, native histograms, reset hints."""

import datetime
import math

import pytest

from tessellar.functions import histograms as H
from tessellar.functions.names import NAME
from tessellar.plans import engine
from tessellar.sources import tables

from .helpers import at, row, rows_of, series, store

CUSTOM = [H.custom(5.0 * k, 5.0 * k, [1.0, 2.0], [2.0 * k, 2.0 * k, 1.0 * k]) for k in range(1, 6)]


def typed(name, hists, kind="hist", temporality="cumulative", hints=None, step=10_000, **labels):
    out = []
    for i, h in enumerate(hists):
        if h is not None:
            out.append(row({NAME: name, **labels}, i * step, kind=kind, hist=h, temporality=temporality, start_ms=(i - 1) * step if temporality == "delta" and i else (0 if temporality != "delta" else None), hint=(hints or {}).get(i)))
    return out


@pytest.fixture(scope="module")
def held(spark):
    exp = [H.exponential(6.0 * k, 10.0 * k, 0, 0.0, 1.0 * k, {0: 2.0 * k, 1: 3.0 * k}, {}) for k in range(1, 6)]
    rows = typed("lat", CUSTOM, job="a") + typed("lat", [H.times(h, 2.0) for h in CUSTOM], job="b") + typed("exp", exp, kind="exphist", job="a")
    rows += typed("wide", [H.custom(5.0, None, [1.0, 3.0], [2.0, 2.0, 1.0])] * 5, job="c")
    rows += typed("delta", [H.custom(3.0, 6.0, [1.0], [1.0, 2.0])] * 5, temporality="delta", job="a")
    rows += typed("drop", [CUSTOM[0], CUSTOM[2], CUSTOM[1], CUSTOM[3], CUSTOM[4]], job="a")
    rows += [row({NAME: "s", "job": "a"}, 10_000 * i, kind="summary", summary=(10.0 * i, 5.0 * i, [(0.5, 1.0), (0.9, 2.0 + i)])) for i in range(5)]
    rows += series("plain{job=a}", [1, 2, 3, 4, 5])
    return store(spark, rows, unique=True, typed=True, boundaries=(2.0,))


CASES = [
    ("lat_count", {"__name__=lat_count,job=a": 25, "__name__=lat_count,job=b": 50}),
    ("lat_sum{job='a'}", {"__name__=lat_sum,job=a": 25}),
    ("lat_bucket{job='a'}", {"__name__=lat_bucket,job=a,le=1": 10, "__name__=lat_bucket,job=a,le=2": 20, "__name__=lat_bucket,job=a,le=+Inf": 25}),
    ("lat_bucket{job='a',le=~'1|2.*'}", {"__name__=lat_bucket,job=a,le=1": 10, "__name__=lat_bucket,job=a,le=2": 20}),
    ("exp_bucket", {"__name__=exp_bucket,job=a,le=2": 15, "__name__=exp_bucket,job=a,le=+Inf": 30}),
    ("s{quantile='0.9'}", {"__name__=s,job=a,quantile=0.9": 6}),
    ("s", {"__name__=s,job=a,quantile=0.5": 1, "__name__=s,job=a,quantile=0.9": 6, "__name__=s_count,job=a": 40, "__name__=s_sum,job=a": 20}),
    ("{__name__=~'lat_(count|sum)',job='a'}", {"__name__=lat_count,job=a": 25, "__name__=lat_sum,job=a": 25}),
    ("rate(lat_count{job='a'}[40s])", {"job=a": 0.5}),
    ("histogram_count(lat)", {"job=a": 25, "job=b": 50}),
    ("histogram_sum(wide)", {}),
    ("histogram_avg(lat)", {"job=a": 1, "job=b": 1}),
    ("histogram_count(rate(lat[40s]))", {"job=a": 0.5, "job=b": 1}),
    ("histogram_sum(increase(lat{job='a'}[40s]))", {"job=a": 20}),
    ("histogram_quantile(0.5, lat{job='a'})", {"job=a": 1 + (12.5 - 10) / 10}),
    ("histogram_quantile(0.9, lat{job='a'})", {"job=a": 2}),
    ("histogram_quantile(0.5, exp)", {"job=a": 2.0}),
    ("histogram_fraction(0, 1, lat{job='a'})", {"job=a": 0.4}),
    ("histogram_fraction(1, 2, exp)", {"job=a": 1 / 3}),
    ("histogram_count(sum(lat))", {"": 75}),
    ("histogram_count(avg(lat))", {"": 37.5}),
    ("histogram_quantile(0.4, sum({__name__=~'lat|wide'}))", {"": 1}),
    ("histogram_sum(sum({__name__=~'lat|wide'}))", {}),
    ("count({__name__=~'lat|plain'})", {"": 3}),
    ("histogram_count(lat * 2)", {"job=a": 50, "job=b": 100}),
    ("histogram_count(2 / lat)", {}),
    ("histogram_count(lat{job='a'} / 5)", {"job=a": 5}),
    ("histogram_count(lat - lat)", {"job=a": 0, "job=b": 0}),
    ("lat == bool on (job) lat", {"job=a": 1, "job=b": 1}),
    ("lat != bool on (job) exp", {"job=a": 1}),
    ("histogram_count(lat and on (job) exp)", {"job=a": 25}),
    ("histogram_count(lat unless on (job) exp)", {"job=b": 50}),
    ("resets(drop[1m])", {"job=a": 1}),
    ("changes(lat{job='a'}[1m])", {"job=a": 4}),
    ("last_over_time(delta_count[1m])", {"__name__=delta_count,job=a": 15}),
    ("increase(delta_count[20s])", {"job=a": 6}),
    ("histogram_sum(increase(delta[20s]))", {"job=a": 12}),
    ("histogram_count(rate(delta[10s]))", {"job=a": 0.3}),
    ("abs(lat)", {}),
    ("plain + on (job) lat_count{job='a'}", {"job=a": 30}),
    ("absent(lat)", {}),
]


@pytest.mark.parametrize("query, want", CASES, ids=[c[0] for c in CASES])
def test_typed(spark, held, query, want):
    norm = lambda d: {",".join(sorted(k.split(","))): v for k, v in d.items()}
    got, want = norm(at(spark, held, query)), norm(want)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v) for k, v in want.items()), got


def test_histogram_functions():
    h = H.exponential(10.0, None, 0, 0.5, 2.0, {0: 4.0}, {0: 4.0})
    assert H.quantile(h, 0.0) == -2.0 and H.quantile(h, 0.5) == 0.0 and H.quantile(h, 1.0) == 2.0
    assert H.quantile(h, 0.8) == pytest.approx(2**0.5)
    assert H.fraction(h, -0.5, 0.5) == pytest.approx(0.2) and H.fraction(h, -math.inf, math.inf) == 1 and H.fraction(h, 2, 1) == 0
    coarse = H.downscale(H.exponential(4.0, None, 1, 0.0, 0.0, {-3: 1.0, -2: 1.0, 0: 1.0, 1: 1.0}, {}), 0)
    assert coarse["pos"] == [{"idx": -2, "cnt": 1.0}, {"idx": -1, "cnt": 1.0}, {"idx": 0, "cnt": 2.0}]
    assert H.add(CUSTOM[0], h) is None and H.add(h, H.exponential(1.0, None, 0, 0.1, 1.0, {}, {})) is None
    both = H.add(CUSTOM[0], H.custom(5.0, 1.0, [2.0, 4.0], [3.0, 1.0, 1.0]))
    assert both["bounds"] == [2.0] and both["counts"] == [7.0, 3.0] and both["sum"] == 6.0
    assert math.isnan(H.quantile(H.custom(0.0, 0.0, [1.0], [0.0, 0.0]), 0.5))
    assert H.equal(CUSTOM[1], H.times(CUSTOM[0], 2.0)) and not H.equal(CUSTOM[0], CUSTOM[1])


def test_columns_agree(spark):
    """Quantiles, fractions, scaling and equality as Columns against the same on dictionaries, on random histograms."""
    import random

    from pyspark.sql import functions as F

    from tessellar.functions import hist_columns as C
    from tessellar.model import HIST

    rng = random.Random(4)
    made = [CUSTOM[0], H.custom(0.0, 0.0, [1.0], [0.0, 0.0]), H.custom(4.0, None, [], [4.0])]
    for _ in range(30):
        if rng.random() < 0.5:
            bounds = sorted(rng.sample([-5.0, -1.0, 0.0, 0.5, 1.0, 2.5, 10.0], rng.randrange(1, 6)))
            counts = [float(rng.randrange(0, 5)) for _ in range(len(bounds) + 1)]
            made.append(H.custom(sum(counts), rng.choice([None, 3.0]), bounds, counts))
        else:
            side = lambda: {i: float(rng.randrange(0, 4)) for i in rng.sample(range(-4, 6), rng.randrange(0, 5))}
            pos, neg, zeros = side(), side(), float(rng.randrange(0, 3))
            made.append(H.exponential(sum(pos.values()) + sum(neg.values()) + zeros, 1.5, rng.randrange(-1, 3), rng.choice([0.0, 0.1]), zeros, pos, neg))
    frame = spark.createDataFrame(list(enumerate(made)), f"i int, h {HIST}")
    h, qs, ranges = F.col("h"), (-1.0, 0.0, 0.3, 0.5, 0.95, 1.0, 2.0), ((0.0, 1.0), (-2.0, 0.7), (1.0, math.inf), (-math.inf, 2.0), (3.0, 1.0), (-math.inf, math.inf))
    columns = [C.quantile(h, q).alias(f"q{k}") for k, q in enumerate(qs)] + [C.fraction(h, *x).alias(f"f{k}") for k, x in enumerate(ranges)]
    rows = frame.select("i", *columns, C.mapped(h, lambda c: c * 2.0).alias("twice"), C.mapped(h, lambda c: C.ieee.div(c, F.lit(4.0))).alias("quarter"), C.equal(h, C.mapped(h, lambda c: c * 2.0)).alias("same"), C.equal(h, h).alias("self")).collect()
    close = lambda a, b: math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-9, abs=1e-12)
    for r in rows:
        one = made[r["i"]]
        assert all(close(r[f"q{k}"], H.quantile(one, q)) for k, q in enumerate(qs)), (one, r)
        assert all(close(r[f"f{k}"], H.fraction(one, *x)) for k, x in enumerate(ranges)), (one, r)
        assert r["twice"].asDict(True) == H.times(one, 2.0) and r["quarter"].asDict(True) == H.over(one, 4.0)
        assert r["same"] == H.equal(one, H.times(one, 2.0)) and r["self"]


def test_no_python_for_one_histogram(spark, held):
    for query in ("histogram_quantile(0.9, lat)", "histogram_fraction(0, 1, exp)", "lat * 2", "lat == bool on (job) lat", "count_over_time(lat[1m])", "last_over_time(lat[1m])"):
        plan = engine.instant(spark, held, query, 40_000)._jdf.queryExecution().executedPlan().toString()
        assert "Arrow" not in plan and "Python" not in plan, query


def test_hints(spark):
    """A stored hint decides over values: a reset without decrease counts, a decrease that is none voids."""
    rows = typed("h", CUSTOM, hints={3: 1}) + typed("k", [CUSTOM[1], CUSTOM[0], CUSTOM[2], CUSTOM[3], CUSTOM[4]], hints={1: 2})
    held = store(spark, rows, unique=True, typed=True)
    got = at(spark, held, "histogram_count(increase(h[1m]))")
    assert got[""] > 25
    assert at(spark, held, "histogram_count(increase(k[1m]))") == {}


def test_conflict(spark):
    rows = typed("x", CUSTOM) + series("x_count", [1, 2, 3, 4, 5])
    with pytest.raises(Exception, match="same labels"):
        engine.instant(spark, store(spark, rows, unique=True, typed=True), "x_count", 40_000).collect()


def test_range_of_typed(spark, held):
    got = rows_of(engine.range_query(spark, held, "histogram_count(rate(lat{job='a'}[20s]))", 20_000, 40_000, 10_000))
    assert [v for _, v in sorted(got.items())] == [pytest.approx(0.5)] * 3


def test_values_of_zero_have_a_bucket(spark, tmp_path):
    """An exponential histogram of a table counts 0 apart and negative values on their own side, and queries over it count all of them."""
    values = [0.0, 0.0, 1.0, 3.0, -3.0]
    rows = [(i, datetime.datetime(2024, 1, 1 + day, 6, 0, i), 1, "click", v) for day in (0, 1) for i, v in enumerate(values + [0.0] * (day == 0))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    end = 1_704_067_200_000 + 2 * tables.DAY
    for held in (tables.event_daily(spark, str(tmp_path)), tables.event_totals(spark, str(tmp_path), ("event_exp_daily",))):
        first = held.samples.filter("metric = 'event_exp_daily'").orderBy("ts_ms").first()["hist"]
        assert (first["count"], first["zero_count"], [tuple(b) for b in first["pos"]]) == (6.0, 3.0, [(-1, 1.0), (1, 1.0)])
        assert at(spark, held, "histogram_sum(avg(event_exp_daily))", end) == {"": 1.0}
        assert at(spark, held, "resets(event_exp_daily[3d])", end) == {"event_type=click": 1.0}
    daily = tables.event_daily(spark, str(tmp_path))
    assert [tuple(b) for b in daily.samples.filter("metric = 'event_exp_daily'").orderBy("ts_ms").first()["hist"]["neg"]] == [(1, 1.0)]
    assert at(spark, daily, "histogram_quantile(0.5, sum(event_exp_daily))", end) == {"": 0.0}
    assert at(spark, daily, 'increase(event_exp_daily_bucket{le="64"}[1d])', end) == {"event_type=click,le=64": 5.0}
