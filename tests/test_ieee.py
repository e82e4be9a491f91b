import math

import pytest
from pyspark.sql import functions as F

from tessellar.functions import ieee

INF, NAN = math.inf, math.nan


def same(a, b):
    return a == b and math.copysign(1, a) == math.copysign(1, b) or math.isnan(a) and math.isnan(b)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_truth_tables(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        pairs = [(1.0, -0.0), (-3.0, 0.0), (0.0, 0.0), (INF, 0.0), (1.0, NAN), (6.0, 4.0), (-7.0, 3.0), (INF, INF), (5.0, INF)]
        frame = spark.createDataFrame(pairs, "a double, b double")
        a, b = F.col("a"), F.col("b")
        got = frame.select(ieee.div(a, b), ieee.mod(a, b), *(ieee.COMPARE[op](a, b) for op in ("==", "!=", ">", "<", ">=", "<="))).collect()
        for (x, y), row in zip(pairs, got, strict=True):
            want = NAN if math.isnan(y) or x == 0 and y == 0 or math.isinf(x) and math.isinf(y) else math.copysign(INF, x) * math.copysign(1, y) if y == 0 else x / y
            assert same(row[0], want), (x, y, row)
            assert same(row[1], NAN if y == 0 or math.isnan(y) or math.isinf(x) else math.fmod(x, y)), (x, y, row)
            assert list(row[2:]) == [x == y, x != y, x > y, x < y, x >= y, x <= y]
        values = [NAN, INF, -INF, 1e300, -1e300, 0.5, -0.5, 2.5, -2.5, 0.0]
        frame = spark.createDataFrame([(v,) for v in values], "x double")
        x = F.col("x")
        for v, row in zip(values, frame.select(ieee.floor(x), ieee.ceil(x), ieee.ln(x), ieee.sgn(x), ieee.clamp(x, -1.0, 1.0), ieee.round_to(x, 1.0)).collect(), strict=True):
            whole = (lambda f, v=v: float(f(v)) if math.isfinite(v) else v)
            assert same(row[0], whole(math.floor)) and same(abs(row[1]), abs(whole(math.ceil))), (v, row)
            assert same(row[2], NAN if math.isnan(v) or v < 0 else -INF if v == 0 else INF if v == INF else math.log(v))
            assert same(row[3], NAN if math.isnan(v) else float((v > 0) - (v < 0)))
            assert row[4] == (-1.0 if math.isnan(v) else min(1.0, max(-1.0, v)))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_group_values(spark):
    frame = spark.createDataFrame([(1.7e308,), (1.7e308,)], "x double")
    assert frame.agg(ieee.mean(F.col("x"))).first()[0] == 1.7e308
    frame = spark.createDataFrame([(NAN,), (1.0,), (3.0,)], "x double")
    assert frame.agg(ieee.max_ignoring_nan(F.col("x"))).first()[0] == 3.0
    assert math.isnan(frame.agg(ieee.quantile(F.col("x"), 0.1)).first()[0])
    assert frame.agg(ieee.quantile(F.col("x"), 0.75)).first()[0] == 2.0
    assert frame.agg(ieee.quantile(F.col("x"), 2.0)).first()[0] == INF


def test_calendar(spark):
    frame = spark.createDataFrame([(1_706_745_599.9,), (-1.0,), (NAN,)], "x double")
    got = frame.select(*(ieee.calendar(n, F.col("x")) for n in ieee.CALENDAR)).collect()
    assert list(got[0]) == [59, 23, 31, 3, 31, 31, 1, 2024]
    assert list(got[1]) == [59, 23, 31, 3, 365, 31, 12, 1969]
    assert all(math.isnan(v) for v in got[2])
