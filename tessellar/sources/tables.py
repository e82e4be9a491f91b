"""Samples from the star-schema test tables: the metrics that the registered queries read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import label_name, metric_name
from ..model import DELTA, EXPONENTIAL, HIST, HISTOGRAM, SUMMARY, floats, labels_of
from .store import Store

DAY = 86_400_000
BOUNDS = (10.0, 50.0, 100.0, 250.0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", "event_type", F.col("user_id").cast("string").alias("user_id"), "value", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) div 1000").alias("t"))


def _store(samples: DataFrame) -> Store:
    return Store(samples, unique=True)


def event_value(spark: SparkSession, sf_dir: str) -> Store:
    return _store(floats(_events(spark, sf_dir), "event_value", F.col("t"), F.col("value"), event_type="event_type", user_id="user_id"))


def event_value_again(spark: SparkSession, sf_dir: str) -> Store:
    """event_value written twice, the second time with 1 added and a later write_seq: the later one counts."""
    rows = _events(spark, sf_dir)
    twice = floats(rows, "event_value", F.col("t"), F.col("value"), seq=F.col("event_id"), event_type="event_type", user_id="user_id")
    again = floats(rows, "event_value", F.col("t"), F.col("value") + 1.0, seq=F.col("event_id") + 1_000_000_000, event_type="event_type", user_id="user_id")
    return Store(twice.unionByName(again))


def event_stale(spark: SparkSession, sf_dir: str) -> Store:
    """event_value where every tenth event is a stale marker."""
    rows = _events(spark, sf_dir)
    return _store(floats(rows, "event_value", F.col("t"), F.col("value"), stale=F.col("event_id") % 10 == 0, event_type="event_type", user_id="user_id"))


def event_count(spark: SparkSession, sf_dir: str) -> Store:
    """Counters: event_count_total grows by 1 with each event of a type and user, event_reset_total starts anew at every seventh of a type."""
    rows = _events(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("t", "event_id"))
    m = F.row_number().over(Window.partitionBy("event_type").orderBy("t", "event_id"))
    total = floats(rows.withColumn("n", n), "event_count_total", F.col("t"), F.col("n"), event_type="event_type", user_id="user_id")
    reset = floats(rows.withColumn("n", m % 7), "event_reset_total", F.col("t"), F.col("n"), event_type="event_type")
    return Store(total.unionByName(reset), unique=True)


def event_buckets(spark: SparkSession, sf_dir: str) -> Store:
    """Classic histograms: at each event of a type, the running count of values up to each bound."""
    rows = _events(spark, sf_dir).withColumn("b", F.explode(F.array(*(F.struct(F.lit(t).alias("le"), F.lit(v).alias("bound")) for t, v in [("10", 10.0), ("50", 50.0), ("100", 100.0), ("250", 250.0), ("+Inf", math.inf)]))))
    running = F.sum((F.col("value") <= F.col("b.bound")).cast("double")).over(Window.partitionBy("event_type", "b.le").orderBy("t", "event_id"))
    return _store(floats(rows.withColumn("c", running), "event_value_bucket", F.col("t"), F.col("c"), event_type="event_type", le=F.col("b.le")))


def _typed(rows: DataFrame, metric: str, kind: str, hist: Column | None, summary: Column | None) -> DataFrame:
    null = lambda t: F.lit(None).cast(t)
    return rows.select(
        labels_of(metric, event_type="event_type").alias("labels"), F.lit(metric).alias("metric"), "ts_ms", F.lit(kind).alias("kind"), null("double").alias("value"), F.lit(False).alias("is_stale"),
        (F.col("ts_ms") - DAY).alias("start_ms"), F.lit(DELTA).alias("temporality"), null("int").alias("reset_hint"), (null(HIST) if hist is None else hist.cast(HIST)).alias("hist"), (null(SUMMARY) if summary is None else summary.cast(SUMMARY)).alias("summary"), F.lit(0).cast("bigint").alias("write_seq"),
    )


def event_daily(spark: SparkSession, sf_dir: str) -> Store:
    """Per day and type, reported at the day's end as deltas: event_daily with explicit bounds, event_exp_daily exponential at scale 0,
    event_summary_daily with quantiles."""
    rows = _events(spark, sf_dir).withColumn("ts_ms", F.call_function("div", F.col("t"), F.lit(DAY).cast("bigint")) * DAY + DAY)
    edges = (-math.inf, *BOUNDS, math.inf)
    v = F.col("value")
    counts = F.array(*(F.sum(((v > a) & (v <= b)).cast("double")) for a, b in zip(edges, edges[1:], strict=False)))
    days = rows.groupBy("event_type", "ts_ms").agg(F.count("*").cast("double").alias("n"), F.sum(v).alias("s"), counts.alias("counts"), F.percentile(v, F.lit(0.5)).alias("q50"), F.percentile(v, F.lit(0.9)).alias("q90"))
    null = lambda t: F.lit(None).cast(t)
    custom = F.struct(F.lit(False).alias("exp"), F.col("n").alias("count"), F.col("s").alias("sum"), F.array(*map(F.lit, BOUNDS)).alias("bounds"), "counts", null("int").alias("scale"), null("double").alias("zero_threshold"), null("double").alias("zero_count"), null("array<struct<idx: int, cnt: double>>").alias("pos"), null("array<struct<idx: int, cnt: double>>").alias("neg"))
    idx = (F.ceil(F.log2(F.abs(v))) - 1).cast("int")  # base 2: (2^i, 2^(i+1)]; NULL for 0, which is counted apart
    by_idx = rows.groupBy("event_type", "ts_ms", F.signum(v).alias("sign"), idx.alias("idx")).agg(F.count("*").cast("double").alias("cnt"), F.sum(v).alias("s"))
    of = lambda sign: F.array_sort(F.collect_list(F.when(F.col("sign") == sign, F.struct("idx", "cnt"))))
    zeros = F.coalesce(F.sum(F.when(F.col("sign") == 0, F.col("cnt"))), F.lit(0.0))
    exp_days = by_idx.groupBy("event_type", "ts_ms").agg(F.sum("cnt").alias("n"), F.sum("s").alias("s"), zeros.alias("zeros"), of(1).alias("pos"), of(-1).alias("neg"))
    exp = F.struct(F.lit(True).alias("exp"), F.col("n").alias("count"), F.col("s").alias("sum"), null("array<double>").alias("bounds"), null("array<double>").alias("counts"), F.lit(0).alias("scale"), F.lit(0.0).alias("zero_threshold"), F.col("zeros").alias("zero_count"), "pos", "neg")
    summary = F.struct(F.col("n").alias("count"), F.col("s").alias("sum"), F.array(F.struct(F.lit(0.5).alias("q"), F.col("q50").alias("v")), F.struct(F.lit(0.9).alias("q"), F.col("q90").alias("v"))).alias("quantiles"))
    parts = [_typed(days, "event_daily", HISTOGRAM, custom, None), _typed(exp_days, "event_exp_daily", EXPONENTIAL, exp, None), _typed(days, "event_summary_daily", "summary", None, summary)]
    return Store(parts[0].unionByName(parts[1]).unionByName(parts[2]), unique=True, typed=True, boundaries=(64.0, 256.0))


def _cumulative(rows: DataFrame, metric: str, kind: str, hist: Column, hint: int | None = None) -> DataFrame:
    return _typed(rows, metric, kind, hist, None).withColumns({"start_ms": F.lit(0).cast("bigint"), "temporality": F.lit("cumulative"), "reset_hint": F.lit(hint).cast("int")})


def event_totals(spark: SparkSession, sf_dir: str, metrics: tuple[str, ...]) -> Store:
    """Those of metrics that are wanted, of event_daily's and more: event_total and event_exp_total, the same as running totals; event_hinted, event_total where every sample says that it comes after a
    reset; event_fine_daily, event_exp_daily at scale 1; event_classic_bucket, event_daily as float series."""
    day = F.call_function("div", F.col("t"), F.lit(DAY).cast("bigint")) * DAY + DAY
    rows, v = _events(spark, sf_dir).withColumn("ts_ms", day), F.col("value")
    edges = (-math.inf, *BOUNDS, math.inf)
    null = lambda t: F.lit(None).cast(t)
    buckets = "array<struct<idx: int, cnt: double>>"
    at = lambda scale: (F.ceil(F.log2(v) * (1 << scale)) - 1).cast("int")
    listed = lambda name, span: F.filter(F.array(*(F.struct(F.lit(i).alias("idx"), F.col(f"{name}{i - span[0]}").alias("cnt")) for i in range(*span))), lambda b: b["cnt"] > 0)
    one, two = (-12, 14), (-24, 28)
    sums = {"n": F.count("*").cast("double"), "s": F.sum(v), "z": F.sum((v == 0).cast("double"))} | {f"b{k}": F.sum(((v > a) & (v <= b)).cast("double")) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))}
    sums |= {f"e{i - one[0]}": F.sum((at(0) == i).cast("double")) for i in range(*one)} | {f"f{i - two[0]}": F.sum((at(1) == i).cast("double")) for i in range(*two)}
    days = rows.groupBy("event_type", "ts_ms").agg(*(c.alias(k) for k, c in sums.items()))
    running = Window.partitionBy("event_type").orderBy("ts_ms").rowsBetween(Window.unboundedPreceding, 0)
    totals = days.select("event_type", "ts_ms", *(F.sum(k).over(running).alias(k) for k in sums if k[0] != "f"))
    counts = F.array(*(f"b{k}" for k in range(len(BOUNDS) + 1)))
    custom = F.struct(F.lit(False).alias("exp"), F.col("n").alias("count"), F.col("s").alias("sum"), F.array(*map(F.lit, BOUNDS)).alias("bounds"), counts.alias("counts"), null("int").alias("scale"), null("double").alias("zero_threshold"), null("double").alias("zero_count"), null(buckets).alias("pos"), null(buckets).alias("neg"))
    exp = lambda scale, name, span: F.struct(F.lit(True).alias("exp"), F.col("n").alias("count"), F.col("s").alias("sum"), null("array<double>").alias("bounds"), null("array<double>").alias("counts"), F.lit(scale).alias("scale"), F.lit(0.0).alias("zero_threshold"), F.col("z").alias("zero_count"), listed(name, span).alias("pos"), F.array().cast(buckets).alias("neg"))
    running_count = lambda k: sum((F.col(f"b{i}") for i in range(1, k + 1)), F.col("b0"))
    les = F.explode(F.array(*(F.struct(F.lit(t).alias("le"), running_count(k).alias("c")) for k, t in enumerate(["10", "50", "100", "250", "+Inf"]))))
    classic = floats(days.withColumn("x", les), "event_classic_bucket", F.col("ts_ms"), F.col("x.c"), event_type="event_type", le=F.col("x.le"), source=F.lit("classic"))
    made = {
        "event_total": lambda: _cumulative(totals, "event_total", HISTOGRAM, custom), "event_exp_total": lambda: _cumulative(totals, "event_exp_total", EXPONENTIAL, exp(0, "e", one)), "event_hinted": lambda: _cumulative(totals, "event_hinted", HISTOGRAM, custom, 1),
        "event_daily": lambda: _typed(days, "event_daily", HISTOGRAM, custom, None), "event_exp_daily": lambda: _typed(days, "event_exp_daily", EXPONENTIAL, exp(0, "e", one), None), "event_fine_daily": lambda: _typed(days, "event_fine_daily", EXPONENTIAL, exp(1, "f", two), None), "event_classic_bucket": lambda: classic,
    }
    samples = made[metrics[0]]()
    for name in metrics[1:]:
        samples = samples.unionByName(made[name]())
    return Store(samples, unique=True, typed=True)


def totals_of(*metrics: str):
    return lambda spark, sf_dir: event_totals(spark, sf_dir, metrics)


def event_dotted(spark: SparkSession, sf_dir: str) -> Store:
    """event_value under the dotted names event.value and event.type, in their canonical form."""
    labels = {label_name("event.type"): "event_type", "user_id": "user_id"}
    return _store(floats(_events(spark, sf_dir), metric_name("event.value"), F.col("t"), F.col("value"), **labels))


def orders(spark: SparkSession, sf_dir: str) -> Store:
    """order_price at each order's date by customer, status and priority; customer_info = 1 with each customer's nation and segment, daily."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("custkey"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_orderkey", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(o_orderdate AS TIMESTAMP_NTZ)) div 1000").alias("t"))
    price = floats(o, "order_price", F.col("t"), F.col("o_totalprice"), seq=F.col("o_orderkey"), custkey="custkey", status="status")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("custkey"), F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    info = floats(c, "customer_info", F.lit(ORDERS_AT), F.lit(1.0), custkey="custkey", nation="nation", segment="segment")
    return Store(price.unionByName(info))


#: 1996-01-01T00:00Z, the time that queries over orders are evaluated at.
ORDERS_AT = 820_454_400_000
