"""Scans of a samples table: matchers, time bounds, last-write-wins, and discovery of metrics and labels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LimitExceeded
from ..functions.names import NAME, label_name
from ..model import label
from ..plans.syntax import Matcher


def literal_prefix(pattern: str) -> str:
    """What every text that a pattern matches whole begins with."""
    m = re.match(r"\^?((?:[A-Za-z0-9_:\- ]|\\[.\-])*)", pattern)
    head = m[1].replace("\\", "") if m else ""
    rest = pattern[m.end() :] if m else pattern
    if rest[:1] in ("*", "?", "{"):
        head = head[:-1]
    return "" if "|" in pattern else head


def matches(value: Column, m: Matcher) -> Column:
    """Whether a label's value (empty if absent) satisfies a matcher; patterns match whole values."""
    if m.op == "=":
        return value == m.value
    if m.op == "!=":
        return value != m.value
    hit = value.rlike(rf"\A(?:{m.value})\z")
    if m.op == "!~":
        return ~hit
    prefix = literal_prefix(m.value)
    return F.startswith(value, F.lit(prefix)) & hit if prefix else hit


@dataclass
class Store:
    """A samples table (see model). unique says that no two samples are alike in labels, kind and time, which spares the scan a
    shuffle; typed that there are histograms or summaries; columns names flat columns that hold a label, to push matchers down."""

    samples: DataFrame
    unique: bool = False
    typed: bool = False
    columns: dict[str, str] = field(default_factory=dict)
    boundaries: tuple[float, ...] = ()  # for the buckets that exponential histograms show

    def scan(self, matchers: tuple[Matcher, ...], low: int | None, high: int | None, metric: Column | None = None) -> DataFrame:
        """Samples whose labels satisfy all matchers and whose time is in [low, high]."""
        rows = self.samples
        if low is not None:
            rows = rows.filter(F.col("ts_ms") >= low)
        if high is not None:
            rows = rows.filter(F.col("ts_ms") <= high)
        for m in matchers:
            flat = F.col("metric") if m.name == NAME else F.coalesce(F.col(self.columns[m.name]), F.lit("")) if m.name in self.columns else label(F.col("labels"), m.name)
            rows = rows.filter(matches(flat, m))
        return self.last_written(rows)

    def limited(self, samples: int | None = None, series: int | None = None, values: int | None = None) -> Store:
        """The same store for queries that may read at most so many samples and series, and expand a pattern to at most so many values."""
        return LimitedStore(self.samples, self.unique, self.typed, self.columns, self.boundaries, samples, series, values)

    def last_written(self, rows: DataFrame) -> DataFrame:
        if self.unique:
            return rows
        newest = Window.partitionBy("labels", "kind", "ts_ms").orderBy(F.desc("write_seq"))
        return rows.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")

    def _between(self, start: int | None, end: int | None) -> DataFrame:
        return self.scan((), start, end) if self.unique else Store(self.samples, True).scan((), start, end)

    def metric_names(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return self._between(start, end).select(F.col("metric").alias("name")).distinct().orderBy("name")

    def label_names(self, start: int | None = None, end: int | None = None) -> DataFrame:
        return self._between(start, end).select("labels").distinct().select(F.explode("labels.name").alias("name")).distinct().orderBy("name")

    def label_values(self, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
        name = label_name(name)
        rows = self._between(start, end)
        if name == NAME:
            return rows.select(F.col("metric").alias("value")).distinct().orderBy("value")
        held = F.filter("labels", lambda x: x["name"] == name)
        return rows.select(F.explode(F.transform(held, lambda x: x["value"])).alias("value")).distinct().orderBy("value")

    def latest_window(self, window_ms: int) -> DataFrame:
        """The smallest and largest time of samples in the newest window, by windows: a small aggregate."""
        windows = self.samples.groupBy(F.floor(F.col("ts_ms") / window_ms).cast("bigint").alias("w")).agg(F.min("ts_ms").alias("min_ms"), F.max("ts_ms").alias("max_ms"))
        return windows.agg(F.max_by(F.struct("min_ms", "max_ms"), "w").alias("x")).select("x.min_ms", "x.max_ms")


@dataclass
class LimitedStore(Store):
    """Counts what a scan matches before it is used, at most one more than allowed, and refuses the query beyond that."""

    max_samples: int | None = None
    max_series: int | None = None
    max_values: int | None = None

    def scan(self, matchers: tuple[Matcher, ...], low: int | None, high: int | None, metric: Column | None = None) -> DataFrame:
        rows = super().scan(matchers, low, high, metric)

        def guard(counted: DataFrame, most: int | None, what: str) -> None:
            if most is not None and counted.limit(most + 1).count() > most:
                raise LimitExceeded(f"the query reads more than {most} {what}")

        for m in matchers:
            if m.op in ("=~", "!~"):
                guard(rows.select(F.col("metric") if m.name == NAME else label(F.col("labels"), m.name)).distinct(), self.max_values, f"values of {m.name}")
        guard(rows.select("labels").distinct(), self.max_series, "series")
        guard(rows.select("ts_ms"), self.max_samples, "samples")
        return rows
