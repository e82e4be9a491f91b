"""Float series that typed metrics show: X_count, X_sum, X_bucket{le}, X{quantile}."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import NAME, float_column
from ..model import DELTA, EXPONENTIAL, FLOAT, HISTOGRAM, RESET, SUMMARY_KIND, label, put

#: What every projected row has.
COLUMNS = ("labels", "ts_ms", "value", "is_stale", "start_ms", "temporality", "reset_hint", "delta_raw")
SUFFIXES = ("_count", "_sum", "_bucket")


def _renamed(labels: Column, suffix: str) -> Column:
    return put(labels, NAME, F.concat(label(labels, NAME), F.lit(suffix)))


def _stitched(rows: DataFrame) -> DataFrame:
    """Running totals of delta series within fragments: a new one begins at the first sample, after a stale one, at a stored reset, or where an
    interval does not start at the sample before. Others stay."""
    series = Window.partitionBy("labels").orderBy("ts_ms")
    before, stale_before = F.lag("ts_ms").over(series), F.coalesce(F.lag("is_stale").over(series), F.lit(False))
    fresh = before.isNull() | stale_before | F.col("start_ms").isNull() | (F.col("start_ms") != before) | (F.coalesce("reset_hint", F.lit(0)) == RESET) | F.col("is_stale")
    delta = F.coalesce(F.col("temporality"), F.lit("")) == DELTA
    rows = rows.withColumn("_new", fresh.cast("int")).withColumn("_fragment", F.sum("_new").over(series))
    total = F.sum(F.when(~F.col("is_stale"), F.col("value"))).over(Window.partitionBy("labels", "_fragment").orderBy("ts_ms"))
    hint = F.when(F.col("_new") == 1, RESET).otherwise(2)
    return rows.select("labels", "ts_ms", F.when(delta, total).otherwise(F.col("value")).alias("value"), "is_stale", "start_ms", "temporality", F.when(delta, hint).otherwise(F.col("reset_hint")).alias("reset_hint"), F.when(delta, F.col("value")).alias("delta_raw"))


def floats(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == FLOAT).select("labels", "ts_ms", "value", "is_stale", "start_ms", F.lit(None).cast("string").alias("temporality"), "reset_hint", F.lit(None).cast("double").alias("delta_raw"))


def counts(rows: DataFrame, stitch: bool = True) -> DataFrame:
    count = F.coalesce("hist.count", "summary.count")
    out = rows.filter(F.col("kind") != FLOAT).select(_renamed(F.col("labels"), "_count").alias("labels"), "ts_ms", count.alias("value"), "is_stale", "start_ms", "temporality", "reset_hint")
    return _stitched(out)


def sums(rows: DataFrame) -> DataFrame:
    out = rows.filter(F.col("kind") != FLOAT).select(_renamed(F.col("labels"), "_sum").alias("labels"), "ts_ms", F.coalesce("hist.sum", "summary.sum").alias("value"), "is_stale", "start_ms", "temporality", "reset_hint")
    return _stitched(out.filter(F.col("value").isNotNull() | F.col("is_stale")))


def _upper(scale: Column, idx: Column) -> Column:
    return F.pow(F.lit(2.0), (idx + 1) * F.pow(F.lit(2.0), -scale))


def buckets(rows: DataFrame, boundaries: tuple[float, ...] = ()) -> DataFrame:
    """Cumulative counts: at the explicit bounds, or of exponential histograms at the given boundaries; and +Inf."""
    explicit = F.transform("hist.bounds", lambda b, i: F.struct(b.alias("le"), F.aggregate(F.slice("hist.counts", F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x).alias("v")))
    zero = F.lit(0.0)

    def at(b: float) -> Column:
        le = F.lit(float(b))
        up = F.aggregate(F.filter("hist.pos", lambda x: _upper(F.col("hist.scale"), x["idx"]) <= le), zero, lambda a, x: a + x["cnt"])
        down = F.aggregate(F.filter("hist.neg", lambda x: -_upper(F.col("hist.scale"), x["idx"] - 1) <= le), zero, lambda a, x: a + x["cnt"])
        return F.struct(le.alias("le"), F.least(F.col("hist.count"), F.coalesce(up, zero) + F.coalesce(down, zero) + F.when(le >= F.col("hist.zero_threshold"), F.col("hist.zero_count")).otherwise(0.0)).alias("v"))

    exponential = F.array(*(at(b) for b in sorted(boundaries) if not math.isinf(b))).cast("array<struct<le: double, v: double>>")
    every = F.concat(F.when(F.col("kind") == HISTOGRAM, explicit).otherwise(exponential), F.array(F.struct(F.lit(math.inf).alias("le"), F.col("hist.count").alias("v"))))
    typed = rows.filter(F.col("kind").isin(HISTOGRAM, EXPONENTIAL)).withColumn("_b", F.explode(every))
    named = put(_renamed(F.col("labels"), "_bucket"), "le", float_column(F.col("_b.le")))
    return _stitched(typed.select(named.alias("labels"), "ts_ms", F.col("_b.v").alias("value"), "is_stale", "start_ms", "temporality", "reset_hint"))


def quantiles(rows: DataFrame) -> DataFrame:
    typed = rows.filter(F.col("kind") == SUMMARY_KIND).withColumn("_q", F.explode("summary.quantiles"))
    named = put(F.col("labels"), "quantile", float_column(F.col("_q.q")))
    return typed.select(named.alias("labels"), "ts_ms", F.col("_q.v").alias("value"), "is_stale", "start_ms", F.lit(None).cast("string").alias("temporality"), "reset_hint", F.lit(None).cast("double").alias("delta_raw"))


def conflict_free(real: DataFrame, virtual: DataFrame) -> DataFrame:
    """Both, unless a series is in either: then the query fails."""
    both = real.select("labels").distinct().join(virtual.select("labels").distinct(), "labels")
    out = real.unionByName(virtual)
    bad = both.select(F.col("labels").alias("_both"), F.raise_error(F.lit("a stored series and a projected one have the same labels")).cast("int").alias("_x"))
    return out.join(bad, F.col("labels") == F.col("_both"), "left").filter(F.col("_x").isNull()).drop("_both", "_x")

