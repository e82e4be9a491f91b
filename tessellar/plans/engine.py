"""From a syntax tree to one DataFrame plan.

An instant vector is a DataFrame (labels, eval_ms, value), with a column hist (null for floats) where histograms can occur. Nothing runs
before the result is read; no step of the grid is planned on its own."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Invalid, LimitExceeded
from ..functions import ieee
from ..functions.names import NAME, float_text, label_name
from ..model import FLOAT, LABELS, drop_name, label, put
from ..operators import aggregate, binary, classic, native, projection, ranges
from ..operators.grid import Grid
from ..sources.store import Store, matches
from .syntax import RANGE_FUNCTIONS, Aggregate, Binary, Call, Matcher, Negative, Selector, constant, fold, is_scalar, parse, text_of

LOOKBACK_MS = 300_000
MAX_STEPS = 11_000


@dataclass
class Scalar:
    """A number for each evaluation time: an expression of eval_ms, or a frame (eval_ms, s)."""

    column: Column | None = None
    frame: DataFrame | None = None


class Evaluator:
    def __init__(self, spark: SparkSession, store: Store, grid: Grid):
        self.spark, self.store, self.grid = spark, store, grid

    # selectors

    def _metric(self, s: Selector) -> str | None:
        return next((m.value for m in s.matchers if m.name == NAME and m.op == "="), None)

    def _float_rows(self, s: Selector, low: int | None, high: int | None, every: bool = True) -> DataFrame:
        """Float samples of a selector, projected ones included."""
        name, others = self._metric(s), tuple(m for m in s.matchers if m.name != NAME)
        if not self.store.typed:
            rows = self.store.scan(s.matchers, low, high)
            return projection.floats(rows)
        if name is None:
            rows = self.store.scan(tuple(m for m in others if m.name not in ("le", "quantile")), low, high)
            named = [m for m in s.matchers if m.name == NAME or m.name in ("le", "quantile")]
            out = projection.floats(rows)
            for part in (projection.counts(rows), projection.sums(rows), projection.buckets(rows, self.store.boundaries), projection.quantiles(rows)):
                out = out.unionByName(part)
            return self._narrowed(out, named)
        out = projection.floats(self.store.scan(s.matchers, low, high))
        virtual = None
        plain = tuple(m for m in others if m.name not in ("le", "quantile"))
        special = [m for m in others if m.name in ("le", "quantile")]
        for suffix, project in (("_count", projection.counts), ("_sum", projection.sums), ("_bucket", lambda r: projection.buckets(r, self.store.boundaries))):
            if name.endswith(suffix):
                base = (Matcher(NAME, "=", name.removesuffix(suffix)), *plain)
                virtual = self._narrowed(project(self.store.scan(base, low, high)), special)
        if virtual is not None:
            out = projection.conflict_free(out, virtual)
        base = self.store.scan((Matcher(NAME, "=", name), *plain), low, high)
        if len({m.name for m in special}) < len(special):
            raise Invalid("le or quantile is matched twice")
        if any(m.name == "quantile" and m.op != "=" for m in special):
            raise Invalid("quantile can only be matched by equality")
        if any(m.name == "quantile" for m in special) or not special:
            out = out.unionByName(self._narrowed(projection.quantiles(base), special))
        if every and not special:
            for part in (projection.counts(base), projection.sums(base), projection.buckets(base, self.store.boundaries)):
                out = out.unionByName(part)
        return out

    def _narrowed(self, rows: DataFrame, matchers: list[Matcher]) -> DataFrame:
        for m in matchers:
            value = label(F.col("labels"), m.name)
            if m.name == "le" and m.op in ("=", "!="):
                m = replace(m, value=_number_text(m.value))
            if m.name == "quantile" and m.op == "=":
                m = replace(m, value=_number_text(m.value))
            rows = rows.filter(matches(value, m))
        return rows

    def _typed_rows(self, s: Selector, low: int | None, high: int | None) -> DataFrame:
        return self.store.scan(s.matchers, low, high).filter(F.col("hist").isNotNull() | F.col("is_stale") & (F.col("kind") != FLOAT))

    def instant(self, s: Selector, top: bool = False) -> DataFrame:
        length = LOOKBACK_MS + 1
        low, high = self.grid.bounds(length, s.offset_ms)
        rows = self._float_rows(s, low, high, every=top)
        out = ranges.latest(rows.select("labels", "ts_ms", "value", "is_stale"), self.grid, length, s.offset_ms).filter("not is_stale").select("labels", "eval_ms", "value", "src_ms")
        if self.store.typed and not top:
            out = native.with_histograms(out, native.latest(self._typed_rows(s, low, high), self.grid, length, s.offset_ms))
        return out

    # scalars

    def scalar(self, node) -> Scalar:
        value = fold(node)
        if value is not None:
            return Scalar(ieee.const(value))
        if isinstance(node, Negative):
            return self._scalar_op(lambda a: -a, self.scalar(node.arg))
        if isinstance(node, Binary):
            op = (lambda a, b: F.when(ieee.COMPARE[node.op](a, b), 1.0).otherwise(0.0)) if node.op in ieee.COMPARE else ieee.ARITHMETIC[node.op]
            return self._scalar_op(op, self.scalar(node.left), self.scalar(node.right))
        if isinstance(node, Call) and node.name == "time":
            return Scalar(F.col("eval_ms") / 1000.0)
        if isinstance(node, Call) and node.name == "scalar":
            v = self._floats_only(self.vector(node.args[0])).groupBy("eval_ms").agg(F.count("*").alias("n"), F.first("value").alias("v"))
            steps = self.grid.frame(self.spark)
            return Scalar(frame=steps.join(v, "eval_ms", "left").select("eval_ms", F.when(F.col("n") == 1, F.col("v")).otherwise(ieee.NAN).alias("s")))
        raise Invalid("expected a scalar")

    def _scalar_op(self, op, *args: Scalar) -> Scalar:
        if all(a.frame is None for a in args):
            return Scalar(op(*(a.column for a in args)))
        frame = self.grid.frame(self.spark)
        for k, a in enumerate(args):
            frame = frame.withColumn(f"s{k}", a.column) if a.frame is None else frame.join(a.frame.withColumnRenamed("s", f"s{k}"), "eval_ms")
        return Scalar(frame=frame.select("eval_ms", op(*(F.col(f"s{k}") for k in range(len(args)))).alias("s")))

    def _with_scalar(self, vector: DataFrame, s: Scalar) -> DataFrame:
        """A column s beside vector; a frame of scalars has at most MAX_STEPS rows, so it may be broadcast."""
        return vector.withColumn("s", s.column) if s.frame is None else vector.join(F.broadcast(s.frame), "eval_ms")

    def _scalar_frame(self, s: Scalar) -> DataFrame:
        return self._with_scalar(self.grid.frame(self.spark), s)

    # vectors

    def _floats_only(self, v: DataFrame) -> DataFrame:
        return v.filter("hist is null") if "hist" in v.columns else v

    def _mapped(self, v: DataFrame, value: Column) -> DataFrame:
        return self._floats_only(v).select(drop_name(F.col("labels")).alias("labels"), "eval_ms", value.alias("value"))

    def vector(self, node, top: bool = False) -> DataFrame:
        if isinstance(node, Selector):
            return self.instant(node, top)
        if isinstance(node, Negative):
            return self._mapped(self.vector(node.arg), -F.col("value"))
        if isinstance(node, Aggregate):
            return self.aggregate(node)
        if isinstance(node, Binary):
            return self.binary(node)
        if isinstance(node, Call):
            return self.call(node)
        raise Invalid("expected an instant vector")

    def aggregate(self, node: Aggregate) -> DataFrame:
        param: float | str | None = None
        if node.op == "count_values":
            param = label_name(text_of(node.param, "the label of count_values"))
        elif node.param is not None:
            param = constant(node.param, f"the parameter of {node.op}", finite=True)
            if node.op in ("topk", "bottomk"):
                if param < 0 or param != int(param):
                    raise Invalid(f"{node.op} needs a non-negative whole number")
        v = self.vector(node.arg)
        if "hist" in v.columns:
            return native.aggregate(node, v, param)
        return aggregate.evaluate(node, v, param)

    def binary(self, node: Binary) -> DataFrame:
        left_scalar, right_scalar = is_scalar(node.left), is_scalar(node.right)
        if not left_scalar and not right_scalar:
            left, right = self.vector(node.left), self.vector(node.right)
            if "hist" in left.columns or "hist" in right.columns:
                return native.binary(node, left, right)
            plain = lambda v: v.select("labels", "eval_ms", "value")
            return binary.sets(node, plain(left), plain(right)) if node.op in ("and", "or", "unless") else binary.vectors(node, plain(left), plain(right))
        v, s = self.vector(node.right if left_scalar else node.left), self.scalar(node.left if left_scalar else node.right)
        scaled = native.scaled(node.op, self._with_scalar(v.filter("hist is not null"), s), left_scalar) if "hist" in v.columns else None
        v = self._with_scalar(self._floats_only(v), s)
        a, b = (F.col("s"), F.col("value")) if left_scalar else (F.col("value"), F.col("s"))
        if node.op in ieee.COMPARE and not node.bool_:
            return v.filter(ieee.COMPARE[node.op](a, b)).select("labels", "eval_ms", "value")
        out = v.select(drop_name(F.col("labels")).alias("labels"), "eval_ms", binary.apply(node.op, a, b, node.bool_).alias("value"))
        return out if scaled is None else native.with_histograms(out, scaled)

    def range_call(self, node: Call) -> DataFrame:
        name = "double_exponential_smoothing" if node.name == "holt_winters" else node.name
        s: Selector = node.args[1 if name == "quantile_over_time" else 0]
        params: tuple[float, ...] = ()
        if name == "quantile_over_time":
            params = (constant(node.args[0], "the quantile"),)
        elif name == "predict_linear":
            params = (constant(node.args[1], "the seconds of predict_linear", finite=True),)
        elif name == "double_exponential_smoothing":
            params = tuple(constant(a, "a smoothing factor", finite=True) for a in node.args[1:])
            if not all(0 <= p <= 1 for p in params):
                raise Invalid("smoothing factors must be in [0, 1]")
        low, high = self.grid.bounds(s.range_ms, s.offset_ms)
        # projections of delta series are stitched from before the range on
        seed = min(low, self.grid.start - s.offset_ms - LOOKBACK_MS) if self.store.typed else low
        rows = self._float_rows(s, seed, high, every=False)
        if name == "absent_over_time":
            present = rows.filter("not is_stale").select("ts_ms")
            if self.store.typed:
                present = present.unionByName(self._typed_rows(s, low, high).filter("not is_stale").select("ts_ms"))
            found = present.withColumn("eval_ms", F.explode(self.grid.times(F.col("ts_ms"), s.range_ms, s.offset_ms))).select("eval_ms").distinct()
            return self._absent(found, s)
        rows = rows.filter("not is_stale").filter(F.col("ts_ms") >= low)
        delta = None
        if self.store.typed:
            is_delta = F.coalesce(F.col("temporality"), F.lit("")) == "delta"
            if name in ("rate", "increase"):
                mixed = rows.groupBy("labels").agg((F.min(is_delta) != F.max(is_delta)).alias("_mixed"))
                rows = rows.join(mixed, "labels").filter("not _mixed")
                delta = ranges.delta_counter(rows.filter(is_delta), self.grid, s.range_ms, s.offset_ms, name == "rate").select("labels", "eval_ms", "value")
                rows = rows.filter(~is_delta)
            elif name in ("delta", "irate", "idelta"):
                rows = rows.filter(~is_delta)
        out = ranges.evaluate(name, rows.select("labels", "ts_ms", "value", "reset_hint"), self.grid, s.range_ms, s.offset_ms, params)
        if delta is not None:
            out = out.unionByName(delta)
        if name != "last_over_time":
            out = out.withColumn("labels", drop_name(F.col("labels")))
        if self.store.typed and name in native.RANGE:
            typed = self._typed_rows(s, low, high)
            out = native.with_histograms(out, native.over_range(name, typed, self.grid, s.range_ms, s.offset_ms))
        return out

    def _absent(self, found: DataFrame, s) -> DataFrame:
        pairs: dict[str, str | None] = {}
        if isinstance(s, Selector):
            for m in s.matchers:
                if m.name != NAME:
                    pairs[m.name] = m.value if m.op == "=" and m.name not in pairs else None
        labels = F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("value")) for k, v in sorted(pairs.items()) if v)).cast(LABELS)
        return self.grid.frame(self.spark).join(found, "eval_ms", "left_anti").select(labels.alias("labels"), "eval_ms", F.lit(1.0).alias("value"))

    def call(self, node: Call) -> DataFrame:
        name, args = node.name, node.args
        if name in RANGE_FUNCTIONS:
            return self.range_call(node)
        value = F.col("value")
        if name in ieee.UNARY:
            return self._mapped(self.vector(args[0]), ieee.UNARY[name](value))
        if name in ieee.CALENDAR:
            if not args:
                return self._scalar_frame(Scalar(F.col("eval_ms") / 1000.0)).select(F.array().cast(LABELS).alias("labels"), "eval_ms", ieee.calendar(name, F.col("s")).alias("value"))
            return self._mapped(self.vector(args[0]), ieee.calendar(name, value))
        if name == "round":
            return self._mapped(self.vector(args[0]), ieee.round_to(value, constant(args[1], "the multiple of round", finite=True) if len(args) > 1 else 1.0))
        if name.startswith("clamp"):
            bounds = [constant(a, f"a bound of {name}") for a in args[1:]]
            low, high = {"clamp": bounds, "clamp_min": [bounds[0], None], "clamp_max": [None, bounds[0]]}[name]
            out = self._mapped(self.vector(args[0]), ieee.clamp(value, low, high))
            return out.filter(F.lit(False)) if name == "clamp" and low > high else out
        if name == "timestamp":
            v = self.vector(args[0])
            return v.select(drop_name(F.col("labels")).alias("labels"), "eval_ms", ((F.col("src_ms") if "src_ms" in v.columns else F.col("eval_ms")) / 1000.0).alias("value"))
        if name == "vector":
            return self._scalar_frame(self.scalar(args[0])).select(F.array().cast(LABELS).alias("labels"), "eval_ms", F.col("s").alias("value"))
        if name == "label_replace":
            dst, repl, src, pattern = (text_of(a, "label_replace's argument") for a in args[1:])
            return self._relabel(self.vector(args[0]), label_name(dst), _replaced(label(F.col("labels"), label_name(src)), pattern, repl))
        if name == "label_join":
            dst, sep, *src = (text_of(a, "label_join's argument") for a in args[1:])
            if not src:
                raise Invalid("label_join needs a source label")
            return self._relabel(self.vector(args[0]), label_name(dst), F.concat_ws(sep, *(label(F.col("labels"), label_name(s)) for s in src)))
        if name in ("sort", "sort_desc"):
            v = self._floats_only(self.vector(args[0])).select("labels", "eval_ms", "value")
            return v.orderBy("eval_ms", F.isnan("value"), value.desc() if name == "sort_desc" else value.asc(), "labels")
        if name == "absent":
            return self._absent(self.vector(args[0]).select("eval_ms").distinct(), args[0])
        if name == "histogram_quantile":
            q = fold(args[0])
            if q is None:
                raise Invalid("the quantile must be a constant")
            v = self.vector(args[1])
            if "hist" in v.columns:
                return native.function(name, v.filter("hist is not null"), (q,)).unionByName(classic.histogram_quantile(self._floats_only(v), q))
            return classic.histogram_quantile(v, q)
        if name.startswith("histogram_"):
            params = tuple(constant(a, f"a bound of {name}") for a in args[:-1])
            v = self.vector(args[-1])
            if "hist" not in v.columns:
                return v.select("labels", "eval_ms", "value").filter(F.lit(False))
            return native.function(name, v.filter("hist is not null"), params)
        raise Invalid(f"{name} is no instant vector")

    def _relabel(self, v: DataFrame, dst: str, new: Column) -> DataFrame:
        return v.withColumn("labels", F.when(new.isNotNull(), put(F.col("labels"), dst, new)).otherwise(F.col("labels")))


def _number_text(text: str) -> str:
    try:
        return float_text(float(text))
    except ValueError:
        return text


def _replaced(src: Column, pattern: str, replacement: str) -> Column:
    """Where the pattern is found in src: src with the first match replaced; NULL elsewhere."""
    java = re.sub(r"\$\{(\w+)\}", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", replacement.replace("\\", "\\\\"))
    whole = rf"(?s)\A(.*?)(?:{pattern})(.*)\z"
    try:
        groups = re.compile(pattern).groups
    except re.error as e:
        raise Invalid(f"bad pattern {pattern!r}: {e}") from e
    shifted = re.sub(r"\$(\d+)", lambda m: f"${int(m[1]) + 1}" if int(m[1]) else "", java)
    return F.when(src.rlike(pattern), F.regexp_replace(src, whole, f"$1{shifted}${groups + 2}"))


def evaluate(spark: SparkSession, store: Store, query: str, grid: Grid) -> DataFrame:
    """(labels, eval_ms, value[, hist]) of a query; scalars come without labels."""
    if grid.size > MAX_STEPS:
        raise LimitExceeded(f"a query has at most {MAX_STEPS} steps")
    node = parse(query)
    run = Evaluator(spark, store, grid)
    if is_scalar(node):
        return run._scalar_frame(run.scalar(node)).select(F.array().cast(LABELS).alias("labels"), "eval_ms", F.col("s").alias("value"))
    out = run.vector(node, top=isinstance(node, Selector))
    return out.select("labels", "eval_ms", "value", *(["hist"] if "hist" in out.columns else []))


def instant(spark: SparkSession, store: Store, query: str, time_ms: int) -> DataFrame:
    return evaluate(spark, store, query, Grid(time_ms, time_ms))


def range_query(spark: SparkSession, store: Store, query: str, start_ms: int, end_ms: int, step_ms: int) -> DataFrame:
    if step_ms <= 0:
        raise Invalid("zero or negative query resolution step widths are not accepted")
    if end_ms < start_ms:
        raise Invalid("end timestamp must not be before start time")
    return evaluate(spark, store, query, Grid(start_ms, end_ms, step_ms))


def raw(spark: SparkSession, store: Store, query: str, start_ms: int, end_ms: int) -> DataFrame:
    """All float samples of a bare selector in [start, end], without lookback."""
    node = parse(query)
    if not isinstance(node, Selector):
        raise Invalid("a raw window needs a bare selector")
    run = Evaluator(spark, store, Grid(end_ms, end_ms))
    return run._float_rows(node, start_ms, end_ms).filter("not is_stale").select("labels", "ts_ms", "value")

