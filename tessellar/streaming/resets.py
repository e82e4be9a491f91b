"""Reset hints: whether a cumulative sample comes after a reset of its series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import CUMULATIVE, DELTA, FLOAT, NOT_RESET, RESET, UNKNOWN


def _less(a: Column, b: Column) -> Column:
    return F.coalesce(a < b, F.lit(False))


def _hint(now: Column, before: Column) -> Column:
    """Of two cumulative histograms or summaries in turn (structs of hist, summary, start_ms)."""
    h, g = now["hist"], before["hist"]
    layout = ~(h["exp"].eqNullSafe(g["exp"]) & h["bounds"].eqNullSafe(g["bounds"]) & h["scale"].eqNullSafe(g["scale"]) & h["zero_threshold"].eqNullSafe(g["zero_threshold"]))
    buckets = F.coalesce(F.exists(F.zip_with(h["counts"], g["counts"], lambda a, b: a < b), lambda x: x), F.lit(False))
    count = lambda s, i: F.coalesce(F.get(F.filter(s, lambda b: b["idx"] == i), F.lit(0))["cnt"], F.lit(0.0))
    side = lambda name: F.coalesce(F.exists(g[name], lambda b: count(h[name], b["idx"]) < b["cnt"]), F.lit(False))
    down = _less(h["count"], g["count"]) | _less(h["sum"], g["sum"]) | _less(h["zero_count"], g["zero_count"]) | buckets | side("pos") | side("neg") | _less(now["summary"]["count"], before["summary"]["count"]) | _less(now["summary"]["sum"], before["summary"]["sum"])
    started = _less(before["start_ms"], now["start_ms"])
    return F.when(started | down & ~layout, RESET).when(layout, UNKNOWN).otherwise(NOT_RESET)


def stamp(samples: DataFrame) -> DataFrame:
    """samples with reset_hint set for typed kinds: cumulative ones are compared with the newest before them, in write order, that is not stale; delta
    ones never reset; others stay unknown, and so does the first of a series."""
    order = Window.partitionBy("labels", "kind").orderBy("write_seq")
    state = F.struct("hist", "summary", "start_ms")
    fresh = F.when(~F.col("is_stale"), state)
    before = F.last(fresh, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = samples.withColumn("_before", before)
    hint = F.when((F.col("kind") == FLOAT) | F.col("is_stale"), F.col("reset_hint")).when(F.col("temporality") == DELTA, NOT_RESET).when(F.coalesce("temporality", F.lit("")) != CUMULATIVE, UNKNOWN).when(F.col("_before").isNull(), UNKNOWN)
    return rows.withColumn("reset_hint", hint.otherwise(_hint(state, F.col("_before"))).cast("int")).drop("_before")
