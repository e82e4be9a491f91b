"""The samples table and helpers for label sets.

A row is a sample. Label sets are arrays of (name, value) sorted by name, so they can be compared, grouped and joined; the metric's name
is the label __name__ and, so that scans can be pruned by it, the column metric. Stale markers are a column, as NaN payloads
do not survive a shuffle. Of samples alike in labels, kind and time the one of the largest write_seq counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.names import NAME

LABELS = "array<struct<name: string, value: string>>"
BUCKETS = "array<struct<idx: int, cnt: double>>"
#: A native histogram: with explicit bounds (exp false), or exponential.
HIST = f"struct<exp: boolean, count: double, sum: double, bounds: array<double>, counts: array<double>, scale: int, zero_threshold: double, zero_count: double, pos: {BUCKETS}, neg: {BUCKETS}>"
SUMMARY = "struct<count: double, sum: double, quantiles: array<struct<q: double, v: double>>>"
FLOAT, HISTOGRAM, EXPONENTIAL, SUMMARY_KIND = "float", "hist", "exphist", "summary"
#: Temporality and reset hints as they are stored.
DELTA, CUMULATIVE, UNSPECIFIED = "delta", "cumulative", "unspecified"
UNKNOWN, RESET, NOT_RESET, GAUGE = 0, 1, 2, 3
SAMPLES = f"labels {LABELS}, metric string, ts_ms bigint, kind string, value double, is_stale boolean, start_ms bigint, temporality string, reset_hint int, hist {HIST}, summary {SUMMARY}, write_seq bigint"


def labels_of(metric: str, **columns: Column | str) -> Column:
    """A label set of a metric's name and labels from columns; a constant order keeps it sorted by name."""
    pairs = sorted({NAME: F.lit(metric), **{k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}}.items())
    return F.array(*(F.struct(F.lit(k).alias("name"), v.cast("string").alias("value")) for k, v in pairs))


def floats(rows: DataFrame, metric: str, ts: Column, value: Column, stale: Column | None = None, seq: Column | None = None, **columns: Column | str) -> DataFrame:
    """Samples of a float metric from a flat table."""
    nothing = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        labels_of(metric, **columns).alias("labels"), F.lit(metric).alias("metric"), ts.cast("bigint").alias("ts_ms"), F.lit(FLOAT).alias("kind"), value.cast("double").alias("value"),
        (F.lit(False) if stale is None else stale).alias("is_stale"), nothing("bigint").alias("start_ms"), nothing("string").alias("temporality"), nothing("int").alias("reset_hint"),
        nothing(HIST).alias("hist"), nothing(SUMMARY).alias("summary"), (F.lit(0) if seq is None else seq).cast("bigint").alias("write_seq"),
    )


def label(labels: Column, name: str) -> Column:
    """A label's value, empty where it is absent."""
    return F.coalesce(F.get(F.filter(labels, lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def keep(labels: Column, names) -> Column:
    names = list(names)
    return F.filter(labels, lambda x: x["name"].isin(names)) if names else F.array().cast(LABELS)


def drop(labels: Column, names) -> Column:
    names = list(names)
    return F.filter(labels, lambda x: ~x["name"].isin(names)) if names else labels


def drop_name(labels: Column) -> Column:
    return F.filter(labels, lambda x: x["name"] != NAME)


def put(labels: Column, name: str, value: Column) -> Column:
    """labels with one set (or replaced), sorted."""
    return F.array_sort(F.concat(F.filter(labels, lambda x: x["name"] != name), F.array(F.struct(F.lit(name).alias("name"), value.alias("value")))))


def flat(frame: DataFrame, *names: str) -> DataFrame:
    """A result's rows with the named labels as columns instead of the array."""
    return frame.select("eval_ms", *(label(F.col("labels"), n).alias(n.strip("_") if n == NAME else n) for n in names), "value")
