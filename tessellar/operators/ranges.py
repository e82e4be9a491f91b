"""Range functions over float samples, for every evaluation time at once.

Windows that slide by less than their length overlap; so what can be merged (sums, extremes, moments, counters, edges) is first
aggregated into slots, the greatest pieces that all windows are made of. Each slot has a list of those before it in a window's length, and makes the windows whose newest it is; nothing holds all windows. Functions of
neighbours (counters, changes, resets, irate, idelta, delta) see each sample's predecessor once, by a window over the series, before anything is repeated: what the first sample in a window
adds is taken off again. As that window deals out by labels, the aggregates after it need no further shuffle. Only quantiles and smoothing, which need all values in order, take
windows of samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..model import GAUGE, NOT_RESET, RESET
from .grid import Grid

#: A slot is worth its aggregate if a window holds at most so many.
MOST_SLOTS = 512


def _slot_end(grid: Grid, length: int, offset: int) -> Column:
    """The end of a sample's slot, which is in the slot."""
    g = grid.slot(length)
    s = grid.start - offset
    shift = -(-(max(s, 0) + length) // g) + 1
    return (F.call_function("div", F.col("ts_ms") - F.lit(s) + F.lit(g - 1 + shift * g), F.lit(g).cast("bigint")) - shift) * g + s


def _slots(rows: DataFrame, grid: Grid, length: int, offset: int, parts: dict[str, Column], *also: str) -> DataFrame:
    """rows (labels, ts_ms, ...) aggregated by series, slot and the columns of also, and each slot once for every evaluation time whose window has it."""
    g = grid.slot(length)
    if length // g > MOST_SLOTS:
        return rows.withColumn("eval_ms", F.explode(grid.times(F.col("ts_ms"), length, offset))).groupBy("labels", "eval_ms", *also).agg(*(v.alias(k) for k, v in parts.items()))
    slots = rows.withColumn("slot", _slot_end(grid, length, offset)).groupBy("labels", "slot", *also).agg(*(v.alias(k) for k, v in parts.items()))
    return slots.withColumn("eval_ms", F.explode(grid.times(F.col("slot"), length - g + 1, offset))).drop("slot")


def _windows(rows: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    return rows.withColumn("eval_ms", F.explode(grid.times(F.col("ts_ms"), length, offset)))


def _overlap(grid: Grid, length: int) -> bool:
    """Whether windows share slots, so that aggregating those first spares repeating samples."""
    return grid.size > 1 and grid.step < length and length // grid.slot(length) <= MOST_SLOTS


def _dealt(rows: DataFrame, *also: str) -> DataFrame:
    """rows by series, and the columns of also, over as many tasks as the session's shuffles have. Spark would put partitions together by their compressed sizes, which labels make far too low."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "labels", *also)


def _by_slot(rows: DataFrame, grid: Grid, length: int, offset: int, parts: dict[str, Column]) -> DataFrame:
    """rows by series and slot: dealt out by both, so that a series of very many samples is many tasks' work, then slots by series."""
    rows = _dealt(rows.withColumn("slot", _slot_end(grid, length, offset)), "slot")
    return _dealt(rows.groupBy("labels", "slot").agg(*(v.alias(k) for k, v in parts.items())))


def _lists(slots: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    """(labels, eval_ms, w): of overlapping windows each one's slots, rows (labels, slot, ...) dealt out by labels, in order. Each slot has those of a window's length up to it beside it and makes
    a row for each evaluation time whose newest it is; so what is held is a series' slots, and no task holds its windows."""
    g = grid.slot(length)
    series = Window.partitionBy("labels").orderBy("slot")
    held = F.collect_set(F.struct(*(c for c in slots.columns if c != "labels"))).over(series.rangeBetween(g - length, 0))
    rows = slots.select("labels", "slot", F.sort_array(held).alias("_held"), F.lead("slot").over(series).alias("_next"))
    newest = F.filter(grid.times(F.col("slot"), length - g + 1, offset), lambda e: F.col("_next").isNull() | (e < F.col("_next") + offset))
    rows = rows.select("labels", "_held", F.explode(newest).alias("eval_ms"))
    return rows.select("labels", "eval_ms", F.filter("_held", lambda x: x["slot"] > F.col("eval_ms") - (offset + length)).alias("w"))


def _all(w: Column, name: str) -> Column:
    return F.transform(w, lambda x: x[name])


def _total(w: Column, name: str) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda s, x: s + x[name].cast("double"))


def _first(w: Column, name: str) -> Column:
    return F.get(w, F.lit(0))[name]


def _last(w: Column, name: str) -> Column:
    return F.get(w, F.size(w) - 1)[name]


def _last_of_steps(rows: DataFrame, grid: Grid, length: int, offset: int, columns: tuple[str, ...]) -> DataFrame:
    """Of the samples of a series between two evaluation times only the newest, where windows overlap: no window's newest sample is another."""
    if not (grid.size > 1 and grid.step < length):
        return rows
    s, p = grid.start - offset, grid.step
    shift = -(-(max(s, 0) + length) // p) + 1
    step = F.call_function("div", F.col("ts_ms") - F.lit(s) + F.lit(p - 1 + shift * p), F.lit(p).cast("bigint"))
    return rows.groupBy("labels", step.alias("slot")).agg(*(F.max_by(c, "ts_ms").alias(c) for c in columns), F.max("ts_ms").alias("ts_ms"))


def latest(rows: DataFrame, grid: Grid, length: int, offset: int, columns: tuple[str, ...] = ("value", "is_stale")) -> DataFrame:
    """(labels, eval_ms, src_ms, value, is_stale): the newest sample in each window; of a step's samples only the last is repeated."""
    rows = _last_of_steps(rows, grid, length, offset, columns)
    return _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(F.max("ts_ms").alias("src_ms"), *(F.max_by(c, "ts_ms").alias(c) for c in columns))


def _moments(rows, grid, length, offset, needed: tuple[str, ...]) -> DataFrame:
    """The aggregates that a function needs, merged over slots."""
    v = F.col("value")
    parts = {"n": F.count("*"), "s": F.sum("value"), "scaled": F.sum(v * 2.0**-64), "finite": F.max(F.when(ieee.is_finite(v), 0).otherwise(1)), "low": F.min("value"), "high": F.max(F.when(~F.isnan(v), v)), "last": F.max_by("value", "ts_ms"), "at": F.max("ts_ms")}
    merged = {"n": F.sum("n").cast("double"), "s": F.sum("s"), "scaled": F.sum("scaled"), "finite": F.max("finite"), "low": F.min("low"), "high": F.max("high"), "last": F.max_by("last", "at")}
    kept = {*needed, "at"} if "last" in needed else {*needed}
    if _overlap(grid, length):
        w = F.col("w")
        of = {"n": _total(w, "n"), "s": _total(w, "s"), "scaled": _total(w, "scaled"), "finite": F.array_max(_all(w, "finite")), "low": F.array_min(_all(w, "low")), "high": F.array_max(_all(w, "high")), "last": _last(w, "last")}
        slots = _by_slot(rows, grid, length, offset, {k: p for k, p in parts.items() if k in kept})
        return _lists(slots, grid, length, offset).select("labels", "eval_ms", *(of[k].alias(k) for k in needed))
    slots = _slots(rows, grid, length, offset, {k: p for k, p in parts.items() if k in kept})
    return slots.groupBy("labels", "eval_ms").agg(*(merged[k].alias(k) for k in needed))


#: function: (the aggregates that it needs, its value)
_MOMENTS = {
    "sum_over_time": (("s",), lambda: F.col("s")),
    "count_over_time": (("n",), lambda: F.col("n")),
    "present_over_time": (("n",), lambda: F.lit(1.0)),
    "avg_over_time": (("s", "n", "scaled", "finite"), lambda: F.when((F.abs("s") == float("inf")) & (F.col("finite") == 0), F.col("scaled") / F.col("n") * 2.0**64).otherwise(F.col("s") / F.col("n"))),
    "min_over_time": (("low",), lambda: F.col("low")),
    "max_over_time": (("high",), lambda: F.coalesce("high", F.lit(ieee.NAN))),
    "last_over_time": (("last",), lambda: F.col("last")),
}


def _adjusted(previous: Column, value: Column, hint: Column) -> tuple[Column, Column]:
    """What a sample adds for a reset before it, and whether its hint makes the window invalid."""
    less = ieee.lt(value, previous)
    hint = F.coalesce(hint, F.lit(0))
    add = F.when(previous.isNull(), 0.0).when((hint == RESET) | less, previous).otherwise(0.0)
    bad = previous.isNotNull() & ((hint == GAUGE) | (hint == NOT_RESET) & less)
    return add, bad.cast("int")


def factor(n: Column, first: Column, last: Column, start: Column, end: Column, first_value: Column | None, raw: Column | None) -> Column:
    """How much longer than from its first to its last sample a window counts, relative to that. All times in ms."""
    sampled = (last - first) / 1000.0
    gap = sampled / F.nullif(n - 1, F.lit(0))
    to_start, to_end = (first - start) / 1000.0, (end - last) / 1000.0
    to_start = F.when(to_start >= gap * 1.1, gap / 2.0).otherwise(to_start)
    if raw is not None:
        to_zero = sampled * ieee.div(first_value, raw)
        to_start = F.when(ieee.gt(raw, F.lit(0.0)) & ieee.ge(first_value, F.lit(0.0)) & (to_zero < to_start), to_zero).otherwise(to_start)
    to_end = F.when(to_end >= gap * 1.1, gap / 2.0).otherwise(to_end)
    return (sampled + to_start + to_end) / F.nullif(sampled, F.lit(0.0))


def counter(rows: DataFrame, grid: Grid, length: int, offset: int, per_second: bool) -> DataFrame:
    series = Window.partitionBy("labels").orderBy("ts_ms")
    add, bad = _adjusted(F.lag("value").over(series), F.col("value"), F.col("reset_hint"))
    rows = _dealt(rows).withColumns({"add": add, "bad": bad})
    parts = {"n": F.count("*"), "t0": F.min("ts_ms"), "t1": F.max("ts_ms"), "v0": F.min_by("value", "ts_ms"), "v1": F.max_by("value", "ts_ms"), "add": F.sum("add"), "add0": F.min_by("add", "ts_ms"), "bad": F.sum("bad"), "bad0": F.min_by("bad", "ts_ms")}
    if _overlap(grid, length):
        slots, w = rows.groupBy("labels", _slot_end(grid, length, offset).alias("slot")).agg(*(v.alias(k) for k, v in parts.items())), F.col("w")
        grown = {"n": _total(w, "n"), "v0": _first(w, "v0"), "v1": _last(w, "v1"), "adds": _total(w, "add") - _first(w, "add0"), "bads": _total(w, "bad") - _first(w, "bad0"), "t0": _first(w, "t0"), "t1": _last(w, "t1")}
        return _extrapolated(_lists(slots, grid, length, offset).select("labels", "eval_ms", *(v.alias(k) for k, v in grown.items())), length, offset, per_second)
    slots = _slots(rows, grid, length, offset, parts)
    w = slots.groupBy("labels", "eval_ms").agg(
        F.sum("n").alias("n"), F.min_by("v0", "t0").alias("v0"), F.max_by("v1", "t1").alias("v1"), (F.sum("add") - F.min_by("add0", "t0")).alias("adds"), (F.sum("bad") - F.min_by("bad0", "t0")).alias("bads"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    return _extrapolated(w, length, offset, per_second)


def _extrapolated(w: DataFrame, length: int, offset: int, per_second: bool) -> DataFrame:
    w = w.filter((F.col("n") >= 2) & (F.col("t1") > F.col("t0")) & (F.col("bads") == 0)).withColumn("raw", F.col("v1") - F.col("v0") + F.col("adds"))
    end = F.col("eval_ms") - offset
    f = factor(F.col("n"), F.col("t0"), F.col("t1"), end - length, end, F.col("v0"), F.col("raw"))
    return w.withColumn("value", F.col("raw") * (f / (length / 1000.0) if per_second else f))


def delta_counter(rows: DataFrame, grid: Grid, length: int, offset: int, per_second: bool) -> DataFrame:
    """Of series that report intervals (delta_raw since start_ms): the sum of those that a window meets; one without a start makes it void."""
    w = _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(F.sum("delta_raw").alias("value"), F.max((F.col("start_ms").isNull() | (F.col("start_ms") >= F.col("ts_ms"))).cast("int")).alias("bad"))
    return w.filter("bad = 0").withColumn("value", F.col("value") / (length / 1000.0) if per_second else F.col("value"))


def _changes(rows: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    before = F.lag("value").over(Window.partitionBy("labels").orderBy("ts_ms"))
    changed = F.when(before.isNull(), 0).otherwise((~(ieee.eq(before, F.col("value")) | F.isnan(before) & F.isnan("value"))).cast("int"))
    rows, parts = _dealt(rows).withColumn("c", changed), {"t0": F.min("ts_ms"), "c": F.sum("c"), "c0": F.min_by("c", "ts_ms")}
    if _overlap(grid, length):
        slots, w = rows.groupBy("labels", _slot_end(grid, length, offset).alias("slot")).agg(*(v.alias(k) for k, v in parts.items())), F.col("w")
        return _lists(slots, grid, length, offset).select("labels", "eval_ms", (_total(w, "c") - _first(w, "c0")).alias("value"))
    slots = _slots(rows, grid, length, offset, parts)
    return slots.groupBy("labels", "eval_ms").agg((F.sum("c") - F.min_by("c0", "t0")).cast("double").alias("value"))


def _neighbours(rows: DataFrame) -> DataFrame:
    """rows with their predecessors in the series (pv, pt) and seg, how many samples that are not finite the series has had, the sample included."""
    series = Window.partitionBy("labels").orderBy("ts_ms")
    bad = (~ieee.is_finite(F.col("value"))).cast("int")
    return _dealt(rows).withColumns({"pv": F.lag("value").over(series), "pt": F.lag("ts_ms").over(series), "seg": F.sum(bad).over(series), "hint": F.coalesce("reset_hint", F.lit(0))})


def _after_odd(rows: DataFrame, grid: Grid, length: int, offset: int, parts: dict[str, Column], merged: dict[str, Column], of: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Of each window what stands after its last sample that is not finite: parts by slot and seg, merged by seg, of which the last counts. Of overlapping windows' slots only the last seg can be
    that of a window's last; of makes from a list of slots what merged makes from a group."""
    if _overlap(grid, length):
        slots = rows.groupBy("labels", _slot_end(grid, length, offset).alias("slot"), "seg").agg(*(v.alias(k) for k, v in parts.items()))
        slots = slots.groupBy("labels", "slot").agg(F.max(F.struct("seg", *parts)).alias("x")).select("labels", "slot", "x.*")
        w = _lists(slots, grid, length, offset)
        w = w.select("labels", "eval_ms", F.filter("w", lambda x: x["seg"] == _last(F.col("w"), "seg")).alias("w"))
        return w.select("labels", "eval_ms", *(v.alias(k) for k, v in of(F.col("w")).items()))
    slots = _slots(rows, grid, length, offset, parts, "seg")
    by_seg = slots.groupBy("labels", "eval_ms", "seg").agg(*(v.alias(k) for k, v in merged.items()))
    return by_seg.groupBy("labels", "eval_ms").agg(*(F.max_by(k, "seg").alias(k) for k in merged))


def _delta(rows, grid, length, offset) -> DataFrame:
    fine = ieee.is_finite(F.col("value"))
    at, v = F.when(fine, F.col("ts_ms")), F.when(fine, F.col("value"))
    parts = {"n": F.count(v), "t0": F.min(at), "t1": F.max(at), "v0": F.min_by(v, at), "v1": F.max_by(v, at), "odd": F.max(F.when(~fine, F.col("ts_ms")))}
    merged = {"n": F.sum("n"), "v0": F.min_by("v0", "t0"), "v1": F.max_by("v1", "t1"), "t0": F.min("t0"), "t1": F.max("t1"), "odd": F.max("odd")}

    def of(w: Column) -> dict[str, Column]:
        some = F.filter(w, lambda x: x["n"] > 0)
        return {"n": _total(w, "n"), "v0": _first(some, "v0"), "v1": _last(some, "v1"), "t0": _first(some, "t0"), "t1": _last(some, "t1"), "odd": F.array_max(_all(w, "odd"))}

    w = _after_odd(_neighbours(rows).drop("pv", "pt"), grid, length, offset, parts, merged, of).filter("n >= 2")
    end = F.col("eval_ms") - offset
    f = factor(F.col("n"), F.col("t0"), F.col("t1"), F.greatest(end - length, F.col("odd")), end, None, None)
    return w.withColumn("value", (F.col("v1") - F.col("v0")) * f)


def _last_two(rows, grid, length, offset, rate: bool) -> DataFrame:
    """The newest sample of each window with its predecessor, if that is in the window and both are finite."""
    rows = _last_of_steps(_neighbours(rows), grid, length, offset, ("value", "pv", "pt", "hint"))
    w = _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(*(F.max_by(c, "ts_ms").alias(c) for c in ("value", "pv", "pt", "hint")), F.max("ts_ms").alias("ts_ms"))
    w = w.filter(ieee.is_finite(F.col("value")) & ieee.is_finite(F.col("pv")) & (F.col("pt") > F.col("eval_ms") - offset - length))
    v, before, hint = F.col("value"), F.col("pv"), F.col("hint")
    if not rate:
        return w.withColumn("value", v - before)
    less = v < before
    grown = F.when((hint == GAUGE) | (hint == NOT_RESET) & less, F.lit(None)).when((hint == RESET) | less, v).otherwise(v - before)
    return w.withColumn("value", grown / ((F.col("ts_ms") - F.col("pt")) / 1000.0))


def _resets(rows, grid, length, offset) -> DataFrame:
    fine = ieee.is_finite(F.col("value"))
    pair, less = fine & ieee.is_finite(F.col("pv")), F.col("value") < F.col("pv")
    reset = F.coalesce(pair & ((F.col("hint") == RESET) | less), F.lit(False)).cast("int")
    void = F.coalesce(pair & ((F.col("hint") == GAUGE) | (F.col("hint") == NOT_RESET) & less), F.lit(False)).cast("int")
    rows = _neighbours(rows).withColumns({"fine": fine.cast("int"), "reset": reset, "void": void})
    first = lambda c: F.min_by(c, "ts_ms")
    parts = {"n": F.sum("fine"), "t0": F.min("ts_ms"), "r": F.sum("reset"), "r0": first("reset"), "x": F.sum("void"), "x0": first("void")}
    merged = {"n": F.sum("n"), "r": F.sum("r") - F.min_by("r0", "t0"), "x": F.sum("x") - F.min_by("x0", "t0")}
    of = lambda w: {"n": _total(w, "n"), "r": _total(w, "r") - _first(w, "r0"), "x": _total(w, "x") - _first(w, "x0")}
    return _after_odd(rows, grid, length, offset, parts, merged, of).filter("n >= 1 and x = 0").withColumn("value", F.col("r").cast("double"))


def _ordered(rows: DataFrame, grid: Grid, length: int, offset: int) -> DataFrame:
    """Each window's samples in order, as w; bad tells whether one is not finite."""
    w = _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("w"), F.max(~ieee.is_finite(F.col("value"))).alias("bad"))
    return w.filter(F.size("w") >= 2)


def _smooth(rows, grid, length, offset, sf: float, tf: float) -> DataFrame:
    w = _ordered(rows, grid, length, offset)
    v = lambda i: F.get("w", F.lit(i))["value"]
    zero = F.struct(v(0).alias("s"), (v(1) - v(0)).alias("t"))

    def step(state: Column, x: Column) -> Column:
        smooth = sf * x["value"] + (1.0 - sf) * (state["s"] + state["t"])
        return F.struct(smooth.alias("s"), (tf * (smooth - state["s"]) + (1.0 - tf) * state["t"]).alias("t"))

    smoothed = F.aggregate(F.slice("w", F.lit(2), F.size("w")), zero, step, lambda s: s["s"])
    return w.withColumn("value", F.when(F.col("bad"), ieee.NAN).otherwise(smoothed))


def _variance(rows, grid, length, offset) -> DataFrame:
    """Population variances. Overlapping windows merge slots' counts, means and squared deviations from these, so that large values lose no digits."""
    v = F.col("value")
    if not _overlap(grid, length):
        return _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(F.var_pop(v).alias("value"))
    slots = _by_slot(rows, grid, length, offset, {"n": F.count("*").cast("double"), "mean": F.avg(v), "m2": F.var_pop(v) * F.count("*")})
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, x: Column) -> Column:
        n, d = a["n"] + x["n"], F.when(a["n"] == 0.0, x["mean"]).otherwise(x["mean"] - a["mean"])
        return F.struct(n.alias("n"), (a["mean"] + d * (x["n"] / n)).alias("mean"), (a["m2"] + x["m2"] + F.when(a["n"] == 0.0, 0.0).otherwise(d * d * (a["n"] * x["n"] / n))).alias("m2"))

    return _lists(slots, grid, length, offset).select("labels", "eval_ms", F.aggregate("w", zero, step, lambda a: a["m2"] / a["n"]).alias("value"))


def _regression(rows, grid, length, offset, ahead: float | None) -> DataFrame:
    """Least squares over x, whole ms from the window's end or, in slots, from theirs, so that no x is rounded; means and deviations from them are merged, so that samples close together keep their digits."""
    fine = ieee.is_finite(F.col("value"))
    y = F.when(fine, F.col("value")).otherwise(0.0)
    n = F.count("*").cast("double")
    parts = lambda x: {"n": n, "x": F.avg(x), "y": F.avg(y), "xx": F.var_pop(x) * n, "xy": F.covar_pop(x, y) * n, "bad": F.max((~fine).cast("int"))}
    if _overlap(grid, length):
        slots = _by_slot(rows, grid, length, offset, parts((F.col("ts_ms") - F.col("slot")).cast("double")))
        zero = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "xy")))

        def step(a: Column, b: Column) -> Column:
            n, x = a["n"] + b["n"], b["x"] + (b["slot"] + offset - F.col("eval_ms")).cast("double")
            dx, dy, part = x - a["x"], b["y"] - a["y"], a["n"] * b["n"] / n
            return F.struct(n.alias("n"), (a["x"] + dx * (b["n"] / n)).alias("x"), (a["y"] + dy * (b["n"] / n)).alias("y"), (a["xx"] + b["xx"] + dx * dx * part).alias("xx"), (a["xy"] + b["xy"] + dx * dy * part).alias("xy"))

        w = _lists(slots, grid, length, offset).select("labels", "eval_ms", F.aggregate("w", zero, step).alias("m"), F.array_max(_all(F.col("w"), "bad")).alias("bad")).select("labels", "eval_ms", "m.*", "bad")
    else:
        w = _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(*(v.alias(k) for k, v in parts((F.col("ts_ms") + offset - F.col("eval_ms")).cast("double")).items()))
    slope = F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0))
    out = slope * 1000.0 if ahead is None else F.col("y") + slope * (ahead * 1000.0 - offset - F.col("x"))
    return w.filter("bad = 1 or n >= 2").withColumn("value", F.when(F.col("bad") == 1, ieee.NAN).otherwise(out))


#: Results that are not finite are dropped for these.
DROP_NOT_FINITE = ("delta", "irate", "idelta", "changes", "resets", "count_over_time", "present_over_time")


def evaluate(name: str, rows: DataFrame, grid: Grid, length: int, offset: int = 0, params: tuple[float, ...] = ()) -> DataFrame:
    """(labels, eval_ms, value) of a range function over float samples (labels, ts_ms, value, reset_hint) that are not stale."""
    if name in _MOMENTS:
        needed, value = _MOMENTS[name]
        out = _moments(rows, grid, length, offset, needed).withColumn("value", value())
    elif name in ("rate", "increase"):
        out = counter(rows, grid, length, offset, name == "rate")
    elif name == "delta":
        out = _delta(rows, grid, length, offset)
    elif name in ("irate", "idelta"):
        out = _last_two(rows, grid, length, offset, name == "irate")
    elif name == "changes":
        out = _changes(rows, grid, length, offset)
    elif name == "resets":
        out = _resets(rows, grid, length, offset)
    elif name in ("stddev_over_time", "stdvar_over_time"):
        out = _variance(rows, grid, length, offset)
        if name == "stddev_over_time":
            out = out.withColumn("value", F.sqrt("value"))
    elif name == "quantile_over_time":
        out = _windows(rows, grid, length, offset).groupBy("labels", "eval_ms").agg(ieee.quantile(F.col("value"), params[0]).alias("value"))
    elif name in ("deriv", "predict_linear"):
        out = _regression(rows, grid, length, offset, params[0] if params else None)
    else:
        out = _smooth(rows, grid, length, offset, *params)
    out = out.select("labels", "eval_ms", "value").filter("value is not null")
    return out.filter(ieee.is_finite(F.col("value"))) if name in DROP_NOT_FINITE else out
