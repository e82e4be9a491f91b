"""Operators over vectors with native histograms. Rows meet by joins and aggregates; what happens to one histogram is Columns (functions.hist_columns), what brings several into
one layout Arrow batches through functions.histograms (Arrow, as NaN would become NULL through pandas)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hist_columns as C
from ..functions import histograms as H
from ..functions import ieee
from ..model import HIST, LABELS, drop_name
from ..plans.syntax import SET_OPS, Aggregate, Binary
from . import aggregate as plain
from . import binary as joins
from . import ranges
from .grid import Grid

_BUCKETS = pa.list_(pa.struct([("idx", pa.int32()), ("cnt", pa.float64())]))
_HIST = pa.struct(
    [("exp", pa.bool_()), ("count", pa.float64()), ("sum", pa.float64()), ("bounds", pa.list_(pa.float64())), ("counts", pa.list_(pa.float64())), ("scale", pa.int32()), ("zero_threshold", pa.float64()), ("zero_count", pa.float64()), ("pos", _BUCKETS), ("neg", _BUCKETS)]
)
_LABELS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_OUT = pa.schema([("labels", _LABELS), ("eval_ms", pa.int64()), ("value", pa.float64()), ("hist", _HIST)])
_OUT_SQL = f"labels {LABELS}, eval_ms bigint, value double, hist {HIST}"
#: Groups that a task adds up at a time.
MOST_GROUPS = 20_000
#: Range functions of histograms.
RANGE = ("rate", "increase", "changes", "resets", "last_over_time", "count_over_time", "present_over_time")


def with_histograms(floats: DataFrame, hists: DataFrame) -> DataFrame:
    a = floats if "hist" in floats.columns else floats.withColumn("hist", F.lit(None).cast(HIST))
    b = hists if "hist" in hists.columns else hists.withColumn("hist", F.lit(None).cast(HIST))
    if "src_ms" in a.columns and "src_ms" not in b.columns:
        a = a.drop("src_ms")
    if "src_ms" in b.columns and "src_ms" not in a.columns:
        b = b.drop("src_ms")
    return a.unionByName(b)


def _each(rows: DataFrame, function: Callable[[dict], tuple[float | None, dict | None] | None]) -> DataFrame:
    """rows (labels, eval_ms, ...) with what the function makes of the other columns: a number, a histogram, or None to drop the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [function(row) for row in batch.to_pylist()]
            kept = [i for i, x in enumerate(out) if x is not None]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at).cast(_LABELS), batch.column(1).take(at), pa.array([out[i][0] for i in kept], pa.float64()), pa.array([out[i][1] for i in kept], _HIST)], schema=_OUT)

    return rows.mapInArrow(run, _OUT_SQL)


def latest(rows: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    w = ranges.latest(rows.select("labels", "ts_ms", "is_stale", "hist"), grid, length, offset, ("is_stale", "hist"))
    return w.filter("not is_stale and hist is not null").select("labels", "eval_ms", F.lit(None).cast("double").alias("value"), "src_ms", "hist")


def over_range(name: str, rows: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    if name in ("last_over_time", "count_over_time", "present_over_time"):
        fresh = rows.filter("not is_stale and hist is not null")
        if name == "last_over_time":
            return latest(fresh, grid, length, offset).select("labels", "eval_ms", "value", "hist")
        n = ranges.evaluate(name, fresh.select("labels", "ts_ms", F.lit(0.0).alias("value")), grid, length, offset)
        return n.select(drop_name(F.col("labels")).alias("labels"), "eval_ms", "value")
    sample = F.struct("ts_ms", "is_stale", F.coalesce("temporality", F.lit("")).alias("temporality"), "start_ms", "reset_hint", "hist")
    keyed = rows.withColumn("eval_ms", F.explode(grid.times(F.col("ts_ms"), length, offset)))
    w = keyed.groupBy("labels", "eval_ms").agg(F.collect_list(sample).alias("w"))
    labels = drop_name(F.col("labels"))

    def window(row: dict):
        every = sorted(row["w"], key=lambda s: s["ts_ms"])
        fresh = [s for s in every if not s["is_stale"] and s["hist"] is not None]
        if not fresh:
            return None
        if name in ("rate", "increase"):
            end = row["eval_ms"] - offset
            out = H.increase(fresh, end - length, end, length / 1000.0 if name == "rate" else None)
            return None if out is None else (None, out)
        stale = max((i for i, s in enumerate(every) if s["is_stale"]), default=-1)
        hs = [s["hist"] for s in every[stale + 1 :] if s["hist"] is not None]
        if not hs:
            return None
        n = H.changes(hs) if name == "changes" else H.resets(hs)
        return None if n is None else (n, None)

    return _each(w.select(labels.alias("labels"), "eval_ms", "w"), window)


def function(name: str, v: DataFrame, params: tuple[float, ...]) -> DataFrame:
    """histogram_* of a vector of histograms only."""
    rows = v.select(drop_name(F.col("labels")).alias("labels"), "eval_ms", "hist")
    if name in ("histogram_count", "histogram_sum", "histogram_avg"):
        value = {"histogram_count": F.col("hist.count"), "histogram_sum": F.col("hist.sum"), "histogram_avg": ieee.div(F.col("hist.sum"), F.col("hist.count"))}[name]
        return rows.select("labels", "eval_ms", value.alias("value")).filter("value is not null")
    h = F.col("hist")
    rows = rows.withColumn("_spans", C.spans(h))
    if name == "histogram_fraction":
        return rows.select("labels", "eval_ms", C.fraction(h, *params, F.col("_spans")).alias("value"))
    return rows.withColumn("_running", C.running(h)).select("labels", "eval_ms", C.quantile(h, *params, F.col("_running"), F.col("_spans")).alias("value"))


def aggregate(node: Aggregate, v: DataFrame, param) -> DataFrame:
    floats = v.filter("hist is null").select("labels", "eval_ms", "value")
    hists = v.filter("hist is not null")
    if node.op in ("count", "group"):
        return plain.evaluate(node, v.select("labels", "eval_ms", F.coalesce("value", F.lit(0.0)).alias("value")), param)
    out = plain.evaluate(node, floats, param)
    if node.op not in ("sum", "avg"):
        return out
    rows = hists.select(plain.grouping(node).alias("labels"), "eval_ms", "hist")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}  # group: [its labels, how many, their sum, or None if they have no common layout]

        def flush() -> pa.RecordBatch:
            got = [(x[0], key[1], float(x[1]) if x[2] is not None else -1.0, x[2]) for key, x in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], f.type) for k, f in enumerate(_OUT)], schema=_OUT)

        for batch in batches:
            for row in batch.to_pylist():
                key = (tuple((x["name"], x["value"]) for x in row["labels"]), row["eval_ms"])
                have = held.get(key)
                if have is None:
                    held[key] = [row["labels"], 1, row["hist"]]
                else:
                    have[1], have[2] = have[1] + 1, None if have[2] is None else H.combine([have[2], row["hist"]])
            if len(held) > MOST_GROUPS:
                yield flush()
        if held:
            yield flush()

    # each task adds up its own rows before the shuffle, so a large group is a histogram a task
    halves = rows.mapInArrow(partial, _OUT_SQL)
    whole = halves.groupBy("labels", "eval_ms").agg(F.collect_list("hist").alias("hs"), F.sum("value").alias("n"), F.min("value").alias("least"))

    def final(row: dict):
        got = H.combine(row["hs"]) if row["least"] >= 0 else None
        return None if got is None else (None, H.times(got, 1.0 / row["n"]) if node.op == "avg" else got)

    both = with_histograms(out, _each(whole.select("labels", "eval_ms", "hs", "n", "least"), final))
    # a group of floats and histograms together has no sum
    kinds = both.groupBy("labels", "eval_ms").agg(F.count("*").alias("k"), F.first("value").alias("value"), F.first("hist").alias("hist"))
    return kinds.filter("k = 1").select("labels", "eval_ms", "value", "hist")


def scaled(op: str, v: DataFrame, scalar_left: bool) -> DataFrame | None:
    """Histograms times or over a scalar column s; other operators drop them."""
    if not (op == "*" or op == "/" and not scalar_left):
        return None
    by = F.col("s")
    change = (lambda c: c * by) if op == "*" else (lambda c: ieee.div(c, by))
    return v.select(drop_name(F.col("labels")).alias("labels"), "eval_ms", F.lit(None).cast("double").alias("value"), C.mapped(F.col("hist"), change).alias("hist"))


def _side(v: DataFrame, key: Column, prefix: str, message: str | None) -> DataFrame:
    side = v.select("eval_ms", key.alias("key"), F.col("labels").alias(f"{prefix}labels"), F.col("value").alias(f"{prefix}value"), F.col("hist").alias(f"{prefix}hist"))
    return joins.checked(side, ["eval_ms", "key"], message, [f"{prefix}labels", f"{prefix}value", f"{prefix}hist"]) if message else side


def binary(node: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
    whole = lambda v: (v if "hist" in v.columns else v.withColumn("hist", F.lit(None).cast(HIST))).select("labels", "eval_ms", "value", "hist")
    left, right = whole(left), whole(right)
    if node.op in SET_OPS:
        return joins.sets(node, left, right)
    of_floats = lambda v: v.filter("hist is null").select("labels", "eval_ms", "value")
    out = joins.vectors(node, of_floats(left), of_floats(right))
    if node.op not in ("+", "-", "==", "!="):
        return out
    m = node.matching
    key = joins.match_key(m, F.col("labels"))
    of_hists = lambda v: v.filter("hist is not null")
    right_message = joins.TOO_MANY["right"] if m.many is None else joins.TOO_MANY["group_left"] if m.many == "left" else None
    left_message = joins.TOO_MANY["left"] if m.many is None else joins.TOO_MANY["group_right"] if m.many == "right" else None
    both = _side(of_hists(left), key, "l_", left_message).join(_side(of_hists(right), key, "r_", right_message), ["eval_ms", "key"])
    if m.many is None:
        labels = joins._result_labels(node)
    else:
        many, one = ("l_", "r_") if m.many == "left" else ("r_", "l_")
        labels = F.col(f"{many}labels") if node.op in ("==", "!=") and not node.bool_ else drop_name(F.col(f"{many}labels"))
        if m.include:
            labels = F.array_sort(F.concat(joins.drop(labels, m.include), F.filter(joins.keep(F.col(f"{one}labels"), m.include), lambda x: x["value"] != "")))

    rows = both.select(labels.alias("labels"), "eval_ms", "l_hist", "r_hist")
    if node.op in ("==", "!="):
        hit = C.equal(F.col("l_hist"), F.col("r_hist")) == F.lit(node.op == "==")
        if node.bool_:
            return with_histograms(out, rows.select("labels", "eval_ms", hit.cast("double").alias("value")))
        return with_histograms(out, rows.filter(hit).select("labels", "eval_ms", F.lit(None).cast("double").alias("value"), F.col("l_hist").alias("hist")))

    def meet(row: dict):
        got = H.add(row["l_hist"], row["r_hist"], 1.0 if node.op == "+" else -1.0)
        return None if got is None else (None, got)

    return with_histograms(out, _each(rows, meet))
