"""Double arithmetic as IEEE 754 has it, whatever the session's ANSI mode: Spark's own raises or gives NULL at zero divisors
and outside domains, holds NaN equal to itself and above all numbers, and rounds into longs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")
_BIG = float(1 << 52)


def const(x: float) -> Column:
    return F.lit(float(x))


def is_nan(x: Column) -> Column:
    return F.isnan(x)


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != INF)


def div(a: Column, b: Column) -> Column:
    quotient = a / F.nullif(b, F.lit(0.0))
    at_zero = F.when(F.isnan(a) | (a == 0.0), NAN).otherwise(F.signum(a) * F.pow(b, F.lit(-1.0)))
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(b == 0.0, at_zero).otherwise(quotient)


def mod(a: Column, b: Column) -> Column:
    bad = F.isnan(a) | F.isnan(b) | (b == 0.0) | (F.abs(a) == INF)
    return F.when(bad, NAN).when(F.abs(b) == INF, a).otherwise(a % F.nullif(b, F.lit(0.0)))


def eq(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a) & ~F.isnan(b)


def ne(a: Column, b: Column) -> Column:
    return ~eq(a, b)


def gt(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a > b)


def lt(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def ge(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a >= b)


def le(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a <= b)


COMPARE = {"==": eq, "!=": ne, ">": gt, "<": lt, ">=": ge, "<=": le}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": div, "%": mod, "^": lambda a, b: F.pow(a, b)}


def floor(x: Column) -> Column:
    whole = F.when(is_finite(x) & (F.abs(x) < _BIG), x).otherwise(0.0)
    return F.when(is_finite(x) & (F.abs(x) < _BIG), F.when(x == 0.0, x).otherwise(F.floor(whole).cast("double"))).otherwise(x)


def ceil(x: Column) -> Column:
    return -floor(-x)


def round_to(x: Column, n: float) -> Column:
    if n == 0 or math.isnan(n):
        return F.lit(NAN)
    return floor(x / n + 0.5) * n


def _log(f):
    def log(x: Column) -> Column:
        return F.when(F.isnan(x) | (x < 0.0), NAN).when(x == 0.0, -INF).when(x == INF, INF).otherwise(f(F.when(x > 0.0, x).otherwise(1.0)))

    return log


ln, log2, log10 = _log(F.ln), _log(F.log2), _log(F.log10)


def sgn(x: Column) -> Column:
    return F.when(F.isnan(x), NAN).when(x > 0.0, 1.0).when(x < 0.0, -1.0).otherwise(0.0)


def clamp(x: Column, low: float | None, high: float | None) -> Column:
    """A NaN input becomes the lower bound, or the upper where there is no lower."""
    if low is not None:
        x = F.when(F.isnan(x) | (x < low), const(low)).otherwise(x)
    if high is not None:
        x = F.when(F.isnan(x) | (x > high), const(high)).otherwise(x)
    return x


def max_ignoring_nan(x: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(x), x)), F.when(F.count(x) > 0, NAN))


def mean(x: Column) -> Column:
    """The mean of a group; on overflow of the sum it is taken of scaled values."""
    scale = 2.0**-64
    return F.when((F.abs(F.avg(x)) == INF) & (F.max(F.abs(x)) < INF), F.avg(x * scale) / scale).otherwise(F.avg(x))


def quantile(x: Column, q: float) -> Column:
    """Of a group, with linear interpolation between ranks; NaN values rank lowest."""
    if math.isnan(q):
        return F.when(F.count(x) > 0, NAN)
    if q < 0 or q > 1:
        return F.when(F.count(x) > 0, const(-math.inf if q < 0 else math.inf))
    nans = F.sum(F.when(F.isnan(x), 1).otherwise(0))
    low = F.floor(F.lit(q) * (F.count(x) - 1))
    return F.when(low < nans, NAN).otherwise(F.percentile(F.when(F.isnan(x), -INF).otherwise(x), F.lit(q)))


def quantile_of(values: Column, q: float) -> Column:
    """The same of an array."""
    n = F.size(values)
    if math.isnan(q) or q < 0 or q > 1:
        return F.when(n > 0, F.lit(NAN) if math.isnan(q) else const(-math.inf if q < 0 else math.inf))
    low_first = F.transform(values, lambda v: F.struct(F.when(F.isnan(v), 0).otherwise(1).alias("k"), v.alias("v")))
    rank = F.lit(q) * (n - 1)
    low = F.floor(rank).cast("int")
    at = lambda i: F.get(F.array_sort(low_first), i)["v"]
    weight = rank - low
    return F.when(n > 0, at(low) * (1 - weight) + F.when(weight > 0, at(F.least(low + 1, n - 1)) * weight).otherwise(0.0))


UNARY = {
    "abs": F.abs, "ceil": ceil, "floor": floor, "ln": ln, "log2": log2, "log10": log10, "sgn": sgn,
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh,
    "cos": F.cos, "cosh": F.cosh, "sin": F.sin, "sinh": F.sinh, "tan": F.tan, "tanh": F.tanh,
    "deg": lambda x: x * 180.0 / math.pi, "rad": lambda x: x * math.pi / 180.0,
}


def calendar(name: str, seconds: Column) -> Column:
    """Parts of the UTC date of a Unix time, without the session's time zone; NaN where the time is not finite."""
    whole = F.floor(F.when(is_finite(seconds) & (F.abs(seconds) < 1e11), seconds).otherwise(0.0)).cast("long")
    day = F.floor(whole / F.lit(86400)).cast("long")
    rest = whole - day * 86400
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    part = {
        "minute": F.floor(rest % 3600 / 60), "hour": F.floor(rest / 3600), "day_of_month": F.dayofmonth(date), "day_of_week": F.dayofweek(date) - 1,
        "day_of_year": F.dayofyear(date), "days_in_month": F.dayofmonth(F.last_day(date)), "month": F.month(date), "year": F.year(date),
    }[name]
    return F.when(is_finite(seconds), part.cast("double")).otherwise(NAN)


CALENDAR = ("minute", "hour", "day_of_month", "day_of_week", "day_of_year", "days_in_month", "month", "year")
