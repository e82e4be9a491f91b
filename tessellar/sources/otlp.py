"""OTLP metrics, as JSON export requests or rows of that structure, to samples.

Captures are JSON lines (seq, partition, captured_ms, payload) or Kafka records; the payload is an ExportMetricsServiceRequest in OTLP's JSON
form. Everything is explodes and projections; only names and labels, which need a hash of the original name, come from an Arrow function, which
looks at each different name of a batch once. Datapoints without a value, or of an invalid shape, are counted and left out."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import NAME, label_name, metric_name
from ..model import CUMULATIVE, DELTA, EXPONENTIAL, FLOAT, HIST, HISTOGRAM, LABELS, SUMMARY, SUMMARY_KIND, UNSPECIFIED
from . import otlp_wire
from .event_time import to_ms

NO_RECORDED_VALUE = 1
_ATTRIBUTES = "array<struct<key: string, value: struct<stringValue: string, boolValue: boolean, intValue: string, doubleValue: double>>>"
_SIDE = "struct<offset: int, bucketCounts: array<string>>"
_POINT = (
    f"struct<attributes: {_ATTRIBUTES}, startTimeUnixNano: string, timeUnixNano: string, flags: bigint, asDouble: double, asInt: string, count: string, sum: double, min: double, max: double, bucketCounts: array<string>, explicitBounds: array<double>,"
    f" scale: int, zeroCount: string, zeroThreshold: double, positive: {_SIDE}, negative: {_SIDE}, quantileValues: array<struct<quantile: double, value: double>>>"
)
_DATA = f"struct<dataPoints: array<{_POINT}>, aggregationTemporality: string, isMonotonic: boolean>"
REQUEST = f"struct<resourceMetrics: array<struct<resource: struct<attributes: {_ATTRIBUTES}>, scopeMetrics: array<struct<metrics: array<struct<name: string, gauge: {_DATA}, sum: {_DATA}, histogram: {_DATA}, exponentialHistogram: {_DATA}, summary: {_DATA}>>>>>>>"
CAPTURE = "seq bigint, partition int, captured_ms bigint, payload string"


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Replay: captured messages of all partitions, in their sequence."""
    return spark.read.schema(CAPTURE).json(path).orderBy("seq")


def stream_capture(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", max_files).json(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, assign: dict[str, list[int]] | None = None, as_json: bool = False, **options: str) -> DataFrame:
    """The same columns from Kafka (its connector must be on the class path), whose values are protobuf unless as_json; offsets are kept by the query's checkpoint.

    assign names partitions by topic, instead of a subscription to all of one."""
    where = {"assign": json.dumps(assign)} if assign else {"subscribe": topic}
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).options(**where).options(**options).load()
    rows = rows.select(F.col("offset").alias("seq"), "partition", F.unix_millis("timestamp").alias("captured_ms"), F.col("value").alias("payload"))
    return rows.withColumn("payload", F.col("payload").cast("string")) if as_json else otlp_wire.to_json(rows)


def write_capture(messages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Tee: messages as they came, by partition."""
    messages.write.mode("append").partitionBy("partition").option("compression", compression).json(path)


def _text(value: Column) -> Column:
    """An attribute's value as a label; NULL for kinds that labels can't hold."""
    number = value["doubleValue"].cast("string")
    return F.coalesce(value["stringValue"], value["boolValue"].cast("string"), value["intValue"], F.regexp_replace(number, r"\.0$", ""))


def datapoints(messages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each datapoint: message columns, metric, kind, temporality, resource and point attributes, point."""
    parsed = messages.select("seq", "partition", "captured_ms", F.from_json("payload", REQUEST).alias("r"))
    metrics = parsed.select("seq", *keep, "captured_ms", F.posexplode("r.resourceMetrics").alias("i", "rm")).select("seq", *keep, "captured_ms", "i", F.col("rm.resource.attributes").alias("resource"), F.posexplode("rm.scopeMetrics").alias("j", "sm"))
    metrics = metrics.select("seq", *keep, "captured_ms", "i", "j", "resource", F.posexplode("sm.metrics").alias("k", "m"))
    kinds = {"gauge": FLOAT, "sum": FLOAT, "histogram": HISTOGRAM, "exponentialHistogram": EXPONENTIAL, "summary": SUMMARY_KIND}
    data, kind = F.coalesce(*(F.col(f"m.{k}") for k in kinds)), F.coalesce(*(F.when(F.col(f"m.{k}").isNotNull(), F.lit(v)) for k, v in kinds.items()))
    rows = metrics.select("seq", *keep, "captured_ms", "i", "j", "k", "resource", F.col("m.name").alias("name"), kind.alias("kind"), data["aggregationTemporality"].alias("t"), F.posexplode(data["dataPoints"]).alias("l", "p"))
    temporality = F.when(F.col("t").isin("1", "AGGREGATION_TEMPORALITY_DELTA"), DELTA).when(F.col("t").isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), CUMULATIVE).otherwise(UNSPECIFIED)
    order = F.col("seq") * (1 << 20) + F.col("i") * (1 << 14) + F.col("j") * (1 << 12) + F.col("k") * (1 << 6) + F.col("l")
    return rows.select("seq", *keep, order.alias("write_seq"), "captured_ms", "resource", "name", "kind", temporality.alias("temporality"), "p", F.col("p.timeUnixNano").cast("bigint").alias("time_ns"))


def canonical(names: pa.Array, pairs: pa.Array) -> pa.Array:
    """(metric, labels) in canonical form of metrics' names and their attributes, lists of (key, value): the later over the earlier of one key, names made plain. Each different name is looked at once;
    all else is arithmetic over whole batches."""
    n = len(names)
    flat = pairs.flatten()
    of_row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(pairs), 0).to_numpy(zero_copy_only=False))
    keys, texts = flat.field("key"), flat.field("value").cast(pa.string())
    kept = pc.and_(pc.is_valid(texts), pc.fill_null(pc.and_(pc.not_equal(keys, ""), pc.not_equal(keys, NAME)), False)).to_numpy(zero_copy_only=False)
    of_row, coded, texts = of_row[kept], keys.filter(pa.array(kept)).dictionary_encode(), texts.filter(pa.array(kept))
    plain = [label_name(k) for k in coded.dictionary.to_pylist()]
    places = {name: i for i, name in enumerate(sorted({*plain, NAME}))}
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(code))
    if len({*plain}) < len(plain):  # different keys of one plain name: the one that comes first in its row later counts
        first: dict[tuple[int, int], int] = {}
        turn = np.array([first.setdefault(x, i) for i, x in enumerate(zip(of_row.tolist(), code.tolist(), strict=True))], np.int64)
    else:
        turn = np.zeros(len(code), np.int64)
    metrics = names.dictionary_encode()
    metric = pa.array([metric_name(x) for x in metrics.dictionary.to_pylist()], pa.string()).take(metrics.indices)
    of_row, place = np.concatenate((of_row, np.arange(n))), np.concatenate((np.array([places[x] for x in plain], np.int64)[code], np.full(n, places[NAME])))
    turn, at = np.concatenate((turn, np.zeros(n, np.int64))), np.concatenate((at, len(at) + np.arange(n)))
    order = np.lexsort((at, turn, place, of_row))
    last = np.ones(len(order), bool)
    last[:-1] = (of_row[order][1:] != of_row[order][:-1]) | (place[order][1:] != place[order][:-1])
    order = order[last]
    ends = np.concatenate(([0], np.cumsum(np.bincount(of_row[order], minlength=n)))).astype(np.int32)
    values = pa.concat_arrays([texts, metric]).take(pa.array(order))
    found = pa.StructArray.from_arrays([pa.array([*places], pa.string()).take(pa.array(place[order])), values], names=["name", "value"])
    return pa.StructArray.from_arrays([metric, pa.ListArray.from_arrays(pa.array(ends), found)], names=["metric", "labels"])


def _canonical(rows: DataFrame) -> DataFrame:
    """rows with labels and metric: point attributes over the resource's. Only names and attributes go through Python."""
    renamed = F.arrow_udf(canonical, f"metric string, labels {LABELS}")
    pairs = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast(_ATTRIBUTES)), lambda a: F.struct(a["key"].alias("key"), _text(a["value"]).alias("value")))
    both = rows.withColumn("_named", renamed("name", F.concat(pairs("resource"), pairs("attributes"))))
    return both.select(*(c for c in rows.columns if c not in ("resource", "attributes", "name")), "_named.metric", "_named.labels")


def samples(points: DataFrame) -> DataFrame:
    """Samples of datapoints that have passed the event-time policy; invalid ones are left out (see `refused`)."""
    p = lambda f: F.col(f"p.{f}")
    number = F.coalesce(p("asDouble"), p("asInt").cast("double"))
    counts = F.transform(p("bucketCounts"), lambda c: c.cast("double"))
    null = lambda t: F.lit(None).cast(t)
    side = lambda s: F.filter(F.transform(F.transform(F.coalesce(p(f"{s}.bucketCounts"), F.array().cast("array<string>")), lambda c: c.cast("double")), lambda c, i: F.struct((F.coalesce(p(f"{s}.offset"), F.lit(0)) + i).alias("idx"), c.alias("cnt"))), lambda b: b["cnt"] != 0)
    empty = "array<struct<idx: int, cnt: double>>"
    custom = F.struct(F.lit(False).alias("exp"), p("count").cast("double").alias("count"), p("sum").alias("sum"), F.coalesce(p("explicitBounds"), F.array().cast("array<double>")).alias("bounds"), counts.alias("counts"), null("int").alias("scale"), null("double").alias("zero_threshold"), null("double").alias("zero_count"), null(empty).alias("pos"), null(empty).alias("neg"))
    exp = F.struct(F.lit(True).alias("exp"), p("count").cast("double").alias("count"), p("sum").alias("sum"), null("array<double>").alias("bounds"), null("array<double>").alias("counts"), p("scale").alias("scale"), F.coalesce(p("zeroThreshold"), F.lit(0.0)).alias("zero_threshold"), F.coalesce(p("zeroCount").cast("double"), F.lit(0.0)).alias("zero_count"), side("positive").alias("pos"), side("negative").alias("neg"))
    hist = F.when(F.col("kind") == HISTOGRAM, custom.cast(HIST)).when(F.col("kind") == EXPONENTIAL, exp.cast(HIST))
    summary = F.when(F.col("kind") == SUMMARY_KIND, F.struct(p("count").cast("double").alias("count"), p("sum").alias("sum"), F.transform(F.coalesce(p("quantileValues"), F.array().cast("array<struct<quantile: double, value: double>>")), lambda q: F.struct(q["quantile"].alias("q"), q["value"].alias("v"))).alias("quantiles")).cast(SUMMARY))
    stale = F.coalesce(p("flags"), F.lit(0)).bitwiseAND(F.lit(NO_RECORDED_VALUE)) == 1
    start = p("startTimeUnixNano").cast("bigint")
    rows = points.withColumn("ok", valid()).filter("ok").select(
        "resource", p("attributes").alias("attributes"), to_ms(F.col("time_ns")).alias("ts_ms"), "kind", F.when(F.col("kind") == FLOAT, number).alias("value"), stale.alias("is_stale"),
        F.when(start > 0, to_ms(start)).alias("start_ms"), F.when(F.col("kind").isin(HISTOGRAM, EXPONENTIAL), F.col("temporality")).alias("temporality"), null("int").alias("reset_hint"), hist.alias("hist"), summary.alias("summary"), "write_seq", "name",
    )
    out = _canonical(rows)
    return out.select("labels", "metric", "ts_ms", "kind", "value", "is_stale", "start_ms", "temporality", "reset_hint", "hist", "summary", "write_seq")


def valid() -> Column:
    """Whether a datapoint has a value of a sound shape: ascending finite bounds, counts that fit them and add up, quantiles ascending in [0, 1]."""
    p = lambda f: F.col(f"p.{f}")
    total = lambda a: F.aggregate(F.coalesce(a, F.array().cast("array<string>")), F.lit(0.0), lambda s, c: s + c.cast("double"))
    rising = lambda a: F.forall(F.zip_with(a, F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: F.coalesce(x < y, F.lit(True))), lambda ok: ok)
    stale = F.coalesce(p("flags"), F.lit(0)).bitwiseAND(F.lit(NO_RECORDED_VALUE)) == 1
    bounds = F.coalesce(p("explicitBounds"), F.array().cast("array<double>"))
    finite = F.forall(bounds, lambda b: ~F.isnan(b) & (F.abs(b) != float("inf")))
    histogram = finite & rising(bounds) & (F.size(p("bucketCounts")) == F.size(bounds) + 1) & (total(p("bucketCounts")) == p("count").cast("double"))
    exponential = F.coalesce(p("zeroCount").cast("double"), F.lit(0.0)) + total(p("positive.bucketCounts")) + total(p("negative.bucketCounts")) == p("count").cast("double")
    qs = F.transform(F.coalesce(p("quantileValues"), F.array().cast("array<struct<quantile: double, value: double>>")), lambda q: q["quantile"])
    summary = rising(qs) & F.forall(qs, lambda q: (q >= 0) & (q <= 1)) & p("count").isNotNull()
    shape = F.when(F.col("kind") == FLOAT, p("asDouble").isNotNull() | p("asInt").isNotNull()).when(F.col("kind") == HISTOGRAM, histogram).when(F.col("kind") == EXPONENTIAL, exponential).otherwise(summary)
    return stale | F.coalesce(shape, F.lit(False))


def watermarks(messages: DataFrame) -> DataFrame:
    """(partition, min_ms, max_ms, n): how far the event times of each partition's datapoints reach."""
    times = datapoints(messages, keep=("partition",)).filter("time_ns > 0").select("partition", to_ms(F.col("time_ns")).alias("t"))
    return times.groupBy("partition").agg(F.min("t").alias("min_ms"), F.max("t").alias("max_ms"), F.count("*").alias("n"))


def refused(points: DataFrame) -> DataFrame:
    """(kind, n) of datapoints that `samples` leaves out."""
    return points.filter(~valid()).groupBy("kind").agg(F.count("*").alias("n"))


def request(metric: dict, resource: dict[str, object] | None = None) -> str:
    """A request of one metric in OTLP's JSON form, for tests and captures."""
    kind = lambda v: {"boolValue": v} if isinstance(v, bool) else {"intValue": str(v)} if isinstance(v, int) else {"doubleValue": v} if isinstance(v, float) else {"stringValue": v}
    attributes = [{"key": k, "value": kind(v)} for k, v in (resource or {}).items()]
    return json.dumps({"resourceMetrics": [{"resource": {"attributes": attributes}, "scopeMetrics": [{"metrics": [metric]}]}]})
