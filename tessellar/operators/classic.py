"""Quantiles of classic histograms: float series whose label le is an upper bound."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.names import NAME
from ..model import drop, label


def bound(text: Column) -> Column:
    return F.when(text.isin("+Inf", "Inf", "inf", "+inf"), ieee.INF).when(text.isin("-Inf", "-inf"), -ieee.INF).otherwise(F.expr("try_cast(_le as double)"))


def quantile_of_buckets(buckets: Column, q: float) -> Column:
    """Of sorted (le, v), v cumulative and not decreasing; le must end in +Inf."""
    n = F.size(buckets)
    get = lambda i: F.get(buckets, i)
    total = get(n - 1)["v"]
    if math.isnan(q):
        return F.lit(ieee.NAN)
    if q < 0 or q > 1:
        return ieee.const(-math.inf if q < 0 else math.inf)
    rank = F.lit(q) * total
    at = F.size(F.filter(F.slice(buckets, F.lit(1), n - 1), lambda x: x["v"] < rank))  # the first bucket that reaches the rank
    end = get(at)["le"]
    below, start = F.when(at > 0, get(at - 1)["v"]).otherwise(0.0), F.when(at > 0, get(at - 1)["le"]).otherwise(0.0)
    inside = start + (end - start) * ieee.div(rank - below, get(at)["v"] - below)
    value = F.when(at == n - 1, get(n - 2)["le"]).when((at == 0) & (end <= 0.0), end).otherwise(inside)
    return F.when((n < 2) | (get(n - 1)["le"] != float("inf")) | (total == 0.0) | F.isnan(total), ieee.NAN).otherwise(value)


def histogram_quantile(vector: DataFrame, q: float) -> DataFrame:
    """(labels, eval_ms, value) from bucket series (labels with le, eval_ms, value); a group's buckets are one row's array."""
    rows = vector.select("eval_ms", drop(F.col("labels"), [NAME, "le"]).alias("labels"), label(F.col("labels"), "le").alias("_le"), "value")
    rows = rows.withColumn("le", bound(F.col("_le"))).filter(F.col("le").isNotNull() & ~F.isnan("le") & ieee.is_finite(F.col("value")))
    rows = rows.groupBy("eval_ms", "labels", "le").agg(F.sum("value").alias("v"))  # equal bounds count together
    groups = rows.groupBy("eval_ms", "labels").agg(F.array_sort(F.collect_list(F.struct("le", "v"))).alias("b"))
    zero = F.struct(F.lit(-math.inf).alias("most"), F.array().cast("array<struct<le: double, v: double>>").alias("b"))
    step = lambda s, x: F.struct(F.greatest(s["most"], x["v"]).alias("most"), F.array_append(s["b"], F.struct(x["le"].alias("le"), F.greatest(s["most"], x["v"]).alias("v"))).alias("b"))
    groups = groups.withColumn("b", F.aggregate("b", zero, step, lambda s: s["b"]))
    return groups.select("labels", "eval_ms", quantile_of_buckets(F.col("b"), q).alias("value"))
