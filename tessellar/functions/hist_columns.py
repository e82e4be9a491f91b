"""Arithmetic of single native histograms as Columns over structs of model.HIST; what needs several in one layout is in histograms.py."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import BUCKETS, HIST
from ..operators.classic import quantile_of_buckets
from . import ieee

_SPANS = "array<struct<low: double, high: double, cnt: double, line: boolean>>"


def mapped(h: Column, change: Callable[[Column], Column]) -> Column:
    """Every count and the sum of h changed; buckets without counts go."""
    side = lambda s: F.filter(F.transform(s, lambda b: F.struct(b["idx"].alias("idx"), change(b["cnt"]).alias("cnt"))), lambda b: b["cnt"] != 0)
    some = lambda x: F.when(x.isNotNull(), change(x))
    out = {"exp": h["exp"], "count": change(h["count"]), "sum": some(h["sum"]), "bounds": h["bounds"], "counts": F.transform(h["counts"], change), "scale": h["scale"], "zero_threshold": h["zero_threshold"], "zero_count": some(h["zero_count"]), "pos": side(h["pos"]), "neg": side(h["neg"])}
    return F.struct(*(v.alias(k) for k, v in out.items())).cast(HIST)


def equal(a: Column, b: Column) -> Column:
    """Whether two are alike in layout, counts and sum; nothing is equal to NaN."""
    same = lambda k: a[k].eqNullSafe(b[k])
    numbers = lambda x: F.coalesce(~(F.isnan(x["count"]) | F.coalesce(F.isnan(x["sum"]), F.lit(False)) | F.coalesce(F.exists(x["counts"], F.isnan), F.lit(False)) | F.exists(F.concat(F.coalesce(x["pos"], F.array().cast(BUCKETS)), F.coalesce(x["neg"], F.array().cast(BUCKETS))), lambda y: F.isnan(y["cnt"]))), F.lit(True))
    out = numbers(a)
    for k in ("exp", "count", "sum", "bounds", "counts", "scale", "zero_threshold", "zero_count", "pos", "neg"):
        out = out & same(k)
    return out


def _edge(scale: Column, idx: Column) -> Column:
    return F.pow(F.lit(2.0), idx * F.pow(F.lit(2.0), -scale))


def spans(h: Column) -> Column:
    """The buckets with their bounds, in order of value; of exponential ones those with counts, line for buckets whose values lie evenly."""
    row = lambda low, high, cnt, line: F.struct(low.alias("low"), high.alias("high"), cnt.alias("cnt"), F.lit(line).alias("line"))
    first = F.when(F.get(h["bounds"], F.lit(0)) > 0, 0.0).otherwise(-math.inf)
    explicit = F.transform(h["counts"], lambda c, i: row(F.when(i == 0, first).otherwise(F.get(h["bounds"], i - 1)), F.coalesce(F.get(h["bounds"], i), F.lit(math.inf)), c, True))
    t = F.coalesce(h["zero_threshold"], F.lit(0.0))
    held = lambda s: F.filter(F.coalesce(h[s], F.array().cast(BUCKETS)), lambda b: b["cnt"] != 0)
    neg, pos = held("neg"), held("pos")
    below = F.transform(F.reverse(F.array_sort(neg)), lambda b: row(-_edge(h["scale"], b["idx"] + 1), F.least(-_edge(h["scale"], b["idx"]), -t), b["cnt"], False))
    above = F.transform(F.array_sort(pos), lambda b: row(F.greatest(_edge(h["scale"], b["idx"]), t), _edge(h["scale"], b["idx"] + 1), b["cnt"], False))
    has_neg, has_pos = F.size(h["neg"]) > 0, F.size(h["pos"]) > 0
    zero = F.when(h["zero_count"] != 0, F.array(row(F.when(has_pos & ~has_neg, 0.0).otherwise(-t), F.when(has_neg & ~has_pos, 0.0).otherwise(t), h["zero_count"], True))).otherwise(F.array().cast(_SPANS))
    return F.when(h["exp"], F.concat(below.cast(_SPANS), zero.cast(_SPANS), above.cast(_SPANS))).otherwise(explicit.cast(_SPANS))


def _within(x: Column, f: Column) -> Column:
    even = x["line"] | (x["low"] == 0) | (x["high"] == 0)
    return F.when(even, x["low"] + (x["high"] - x["low"]) * f).otherwise(x["low"] * F.pow(ieee.div(x["high"], x["low"]), f))


def running(h: Column) -> Column:
    """Cumulative counts at the explicit bounds and at infinity."""
    every = F.concat(h["bounds"], F.array(F.lit(math.inf)))
    return F.transform(every, lambda b, i: F.struct(b.alias("le"), F.aggregate(F.slice(h["counts"], F.lit(1), i + 1), F.lit(0.0), lambda s, c: s + c).alias("v")))


def quantile(h: Column, q: float, running_: Column | None = None, spans_: Column | None = None) -> Column:
    """running_ and spans_ may be columns that hold what the functions of these names give, so that each is made once a row."""
    if math.isnan(q):
        return F.lit(ieee.NAN)
    none = (h["count"] == 0) | F.isnan(h["count"])
    if q < 0 or q > 1:
        return F.when(none, ieee.NAN).otherwise(ieee.const(-math.inf if q < 0 else math.inf))
    running_, spans_ = running(h) if running_ is None else running_, spans(h) if spans_ is None else spans_
    rank = F.lit(float(q)) * h["count"]
    zero = F.struct(F.lit(0.0).alias("seen"), F.lit(ieee.NAN).alias("last"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, x: Column) -> Column:
        hit = s["at"].isNull() & (s["seen"] + x["cnt"] >= rank)
        return F.struct((s["seen"] + x["cnt"]).alias("seen"), x["high"].alias("last"), F.when(hit, _within(x, ieee.div(rank - s["seen"], x["cnt"]))).otherwise(s["at"]).alias("at"))

    exponential = F.aggregate(spans_, zero, step, lambda s: F.coalesce(s["at"], s["last"]))
    return F.when(none, ieee.NAN).when(h["exp"], exponential).otherwise(quantile_of_buckets(running_, q))


def fraction(h: Column, low: float, high: float, spans_: Column | None = None) -> Column:
    spans_ = spans(h) if spans_ is None else spans_
    none = (h["count"] == 0) | F.isnan(h["count"])
    if math.isnan(low) or math.isnan(high):
        return F.lit(ieee.NAN)
    if low >= high or low == -math.inf and high == math.inf:
        return F.when(none, ieee.NAN).otherwise(0.0 if low >= high else 1.0)

    def below(v: float) -> Column:
        if v == math.inf:
            return h["count"]
        at = ieee.const(v)
        zero = F.struct(F.lit(0.0).alias("seen"), F.lit(False).alias("done"))

        def step(s: Column, x: Column) -> Column:
            even = x["line"] | (x["low"] == 0) | (x["high"] == 0)
            endless = (F.abs(x["low"]) == math.inf) | (F.abs(x["high"]) == math.inf)
            share = F.when(endless, 0.0).when(even, ieee.div(at - x["low"], x["high"] - x["low"])).otherwise(ieee.div(ieee.ln(ieee.div(at, x["low"])), ieee.ln(ieee.div(x["high"], x["low"]))))
            more = F.when(s["done"], 0.0).when(at >= x["high"], x["cnt"]).when(at <= x["low"], 0.0).otherwise(x["cnt"] * share)
            return F.struct((s["seen"] + more).alias("seen"), (s["done"] | (at < x["high"])).alias("done"))

        return F.aggregate(spans_, zero, step, lambda s: s["seen"])

    share = ieee.div(below(high) - below(low), h["count"])
    return F.when(none, ieee.NAN).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))
