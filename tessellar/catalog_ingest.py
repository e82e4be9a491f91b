"""The registered queries of what stands around the query engine, and their SQL: messages, policies, streams, the table that they fill, HTTP answers, refusals, limits."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Api, fingerprint, step_ms, timestamp_ms
from .errors import QueryError
from .functions.names import NAME, metric_name
from .model import SAMPLES, label
from .operators.grid import Grid
from .plans import engine
from .scratch import new_path
from .sources import otlp, otlp_wire, tables
from .sources.event_time import EventTimePolicy
from .sources.store import Store
from .sources.tables import DAY
from .streaming.ingest import Ingest, lanes
from .streaming.resets import stamp

EV = "ev AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t, value AS v, event_id FROM events)"
WINDOW = 900_000
#: Of the table that the streams fill.
SPAN = 10 * DAY
START, END = 1_704_153_600_000, 1_706_659_200_000
HALF = 1_705_363_200_000 // SPAN * SPAN  # a window's start in the middle of January
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _registered(name: str, sql: str):
    def add(function):
        QUERIES[name], SQL[name] = function, sql
        return function

    return add


def event_messages(spark: SparkSession, sf_dir: str, change: float = 0.0) -> DataFrame:
    """An export request for each event: gauge event.value with the event's type and user; every fifth has no value. Captured up to 90 minutes after the event, or 10 before.
    They are dealt out first, as a file's row groups may be few tasks' work."""
    e = tables._events(spark, sf_dir).repartition("event_id")
    text = lambda k, v: F.struct(F.lit(k).alias("key"), F.struct(F.col(v).alias("stringValue")).alias("value"))
    point = F.struct((F.col("t") * 1_000_000).cast("string").alias("timeUnixNano"), F.when(F.col("event_id") % 5 != 0, F.col("value") + change).alias("asDouble"), F.array(text("event_type", "event_type"), text("user_id", "user_id")).alias("attributes"))
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("event.value").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return e.select(F.col("event_id").cast("bigint").alias("seq"), (F.col("event_id") % 3).cast("int").alias("partition"), (F.col("t") + (F.col("event_id") % 100) * 60_000 - 600_000).cast("bigint").alias("captured_ms"), F.to_json(request).alias("payload"))


def _values(rows: DataFrame, *more: str) -> DataFrame:
    of = lambda n: label(F.col("labels"), n).alias(n)
    return rows.select(of("event_type"), of("user_id"), "ts_ms", F.round("value", 7).alias("value"), *more)


_DECODED = f"WITH {EV} SELECT event_type, user_id, t AS ts_ms, round(v, 7) AS value FROM ev WHERE event_id % 5 <> 0"


@_registered("s04_decode", _DECODED.replace("SELECT event_type", f"SELECT '{metric_name('event.value')}' AS metric, event_type"))
def _decode(spark, sf_dir):
    return _values(otlp.samples(otlp.datapoints(event_messages(spark, sf_dir))), "metric")


@_registered("s05_points_without_value", f"WITH {EV} SELECT 'float' AS kind, count(*) AS n FROM ev WHERE event_id % 5 = 0")
def _without_value(spark, sf_dir):
    return otlp.refused(otlp.datapoints(event_messages(spark, sf_dir)))


@_registered("s01_protobuf", _DECODED)
def _protobuf(spark, sf_dir):
    """The same requests as bytes on the wire, as a topic has them."""

    def wire(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([otlp_wire.encode(json.loads(x)) for x in batch.column(3).to_pylist()], pa.binary())], names=["seq", "partition", "captured_ms", "payload"])

    raw = event_messages(spark, sf_dir).mapInArrow(wire, "seq bigint, partition int, captured_ms bigint, payload binary")
    return _values(otlp.samples(otlp.datapoints(otlp_wire.to_json(raw))))


@_registered("s03_capture_and_replay", _DECODED)
def _capture(spark, sf_dir):
    path = new_path(spark, "capture")
    otlp.write_capture(event_messages(spark, sf_dir), path)
    return _values(otlp.samples(otlp.datapoints(otlp.read_capture(spark, path))))


_HISTOGRAMS = f"WITH {EV}, d AS (SELECT event_type, (t // {DAY}) * {DAY} + {DAY} AS t, v FROM ev), y AS (SELECT event_type, t, CAST(count(*) AS DOUBLE) AS n, sum(v) AS s, [CAST(count(CASE WHEN v <= 10 THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN v > 10 AND v <= 50 THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN v > 50 AND v <= 100 THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN v > 100 AND v <= 250 THEN 1 END) AS DOUBLE), CAST(count(CASE WHEN v > 250 THEN 1 END) AS DOUBLE)] AS c FROM d GROUP BY ALL)"


def _histogram_messages(spark, sf_dir) -> DataFrame:
    """event_daily's histograms as requests that call themselves cumulative, in order of time."""
    rows = tables.event_daily(spark, sf_dir).samples.filter("metric = 'event_daily'")
    texts = F.transform("hist.counts", lambda c: c.cast("bigint").cast("string"))
    point = F.struct(
        (F.col("ts_ms") * 1_000_000).cast("string").alias("timeUnixNano"), F.lit("1000000").alias("startTimeUnixNano"), F.col("hist.count").cast("bigint").cast("string").alias("count"), F.col("hist.sum").alias("sum"), texts.alias("bucketCounts"), F.col("hist.bounds").alias("explicitBounds"),
        F.array(F.struct(F.lit("event_type").alias("key"), F.struct(label(F.col("labels"), "event_type").alias("stringValue")).alias("value"))).alias("attributes"),
    )
    data = F.struct(F.lit("2").alias("aggregationTemporality"), F.array(point).alias("dataPoints"))
    request = F.struct(F.array(F.struct(F.array(F.struct(F.array(F.struct(F.lit("h").alias("name"), data.alias("histogram"))).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))
    return rows.select(F.call_function("div", F.col("ts_ms"), F.lit(DAY).cast("bigint")).alias("seq"), F.lit(0).alias("partition"), F.col("ts_ms").alias("captured_ms"), F.to_json(request).alias("payload"))


@_registered("s06_typed_values", f"{_HISTOGRAMS} SELECT event_type, t AS ts_ms, n, round(s, 6) AS s, array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) for x in c], ',') AS c FROM y")
def _typed(spark, sf_dir):
    rows = otlp.samples(otlp.datapoints(_histogram_messages(spark, sf_dir)))
    return rows.select(label(F.col("labels"), "event_type").alias("event_type"), "ts_ms", F.col("hist.count").alias("n"), F.round("hist.sum", 6).alias("s"), F.array_join(F.transform("hist.counts", lambda c: c.cast("bigint").cast("string")), ",").alias("c"))


_JUDGED = "CASE WHEN (event_id % 100) * 60000 - 600000 > 3600000 THEN 'too_old' WHEN (event_id % 100) * 60000 - 600000 < -300000 THEN 'too_new' ELSE 'accepted' END"


@_registered("s07_event_time_policy", f"SELECT {_JUDGED} AS decision, count(*) AS n FROM events GROUP BY ALL")
def _policy(spark, sf_dir):
    points = otlp.datapoints(event_messages(spark, sf_dir))
    return points.groupBy(EventTimePolicy().decision(F.col("time_ns"), F.col("captured_ms")).alias("decision")).agg(F.count("*").alias("n"))


_HINTS = f"{_HISTOGRAMS}, p AS (SELECT *, lag(n) OVER o AS pn, lag(s) OVER o AS ps, lag(c) OVER o AS pc FROM y WINDOW o AS (PARTITION BY event_type ORDER BY t)) SELECT event_type, t AS ts_ms, CASE WHEN pn IS NULL THEN 0 WHEN n < pn OR s < ps OR c[1] < pc[1] OR c[2] < pc[2] OR c[3] < pc[3] OR c[4] < pc[4] OR c[5] < pc[5] THEN 1 ELSE 2 END AS reset_hint FROM p"


@_registered("s08_reset_hints", _HINTS)
def _hints(spark, sf_dir):
    rows = stamp(otlp.samples(otlp.datapoints(_histogram_messages(spark, sf_dir))))
    return rows.select(label(F.col("labels"), "event_type").alias("event_type"), "ts_ms", "reset_hint")


@_registered("t09_hints_across_batches", _HINTS)
def _hints_of_batches(spark, sf_dir):
    """The state of one batch decides the first hints of the next."""
    taken = Ingest(spark, new_path(spark, "hints"), EventTimePolicy(drop_outdated=False), window_ms=SPAN, ooo_window_ms=DAY)
    messages = _histogram_messages(spark, sf_dir)
    for k, part in enumerate((messages.filter(F.col("captured_ms") < HALF), messages.filter(F.col("captured_ms") >= HALF))):
        taken.take(part, k)
    return taken.read().select(label(F.col("labels"), "event_type").alias("event_type"), "ts_ms", "reset_hint")


def _filled(spark, sf_dir) -> Ingest:
    """Events in two batches of those with odd and even ids, then every tenth again with 1 added, late."""
    taken = Ingest(spark, new_path(spark, "table"), EventTimePolicy(drop_outdated=False), window_ms=SPAN, ooo_window_ms=400 * DAY)
    messages = event_messages(spark, sf_dir)
    taken.take(messages.filter("seq % 2 = 1"), 0)
    taken.take(messages.filter("seq % 2 = 0"), 1)
    taken.take(event_messages(spark, sf_dir, 1.0).filter("seq % 10 = 3"), 2)
    return taken


_LATE = "CASE WHEN event_id % 10 = 3 THEN v + 1 ELSE v END"
_FILLED = f"WITH {EV} SELECT event_type, user_id, t AS ts_ms, (t // {SPAN}) * {SPAN} AS window_start, round({_LATE}, 7) AS value FROM ev WHERE event_id % 5 <> 0"


@_registered("s09_head_append", _FILLED)
def _append(spark, sf_dir):
    rows = _filled(spark, sf_dir).read()
    return _values(Store(rows).last_written(rows), "window_start")


@_registered("s10_seal", f"{_FILLED} AND (t // {SPAN}) * {SPAN} + {SPAN} <= {HALF}")
def _seal(spark, sf_dir):
    taken, target = _filled(spark, sf_dir), new_path(spark, "sealed")
    taken.compact(HALF, target)
    return _values(spark.read.parquet(target), "window_start")


@_registered("s11_retention", f"{_FILLED} AND (t // {SPAN}) * {SPAN} + {SPAN} > {HALF}")
def _retain(spark, sf_dir):
    taken = _filled(spark, sf_dir)
    taken.retain(HALF)
    rows = taken.read()
    return _values(Store(rows).last_written(rows), "window_start")


@_registered("s12_restart", f"WITH {EV} SELECT event_type, user_id, t AS ts_ms, round(v, 7) AS value FROM ev WHERE event_id % 5 <> 0 AND event_id % 4 <> 3")
def _restart(spark, sf_dir):
    """A stream that ends and begins again from its checkpoint takes each message once."""
    source, checkpoint = new_path(spark, "source"), new_path(spark, "offsets")
    taken = Ingest(spark, new_path(spark, "restarted"), EventTimePolicy(drop_outdated=False), window_ms=SPAN, ooo_window_ms=400 * DAY)
    for part in ("seq % 4 in (0, 1)", "seq % 4 = 2"):
        event_messages(spark, sf_dir).filter(part).write.mode("append").json(source)
        query = taken.start(otlp.stream_capture(spark, source), checkpoint)
        query.awaitTermination()
    rows = taken.read()
    return _values(Store(rows).last_written(rows))


_SUMS = f"WITH {EV}, g AS (SELECT unnest(range({START}, {END + 1}, {DAY})) AS eval_ms) SELECT eval_ms, event_type, round(sum({_LATE}), 5) + 0.0 AS value FROM g JOIN ev ON t > eval_ms - {DAY} AND t <= eval_ms WHERE event_id % 5 <> 0 AND event_type = 'click'"


def _asked(spark, store) -> DataFrame:
    out = engine.evaluate(spark, store, 'sum by (event_type) (sum_over_time(event.value{event_type="click"}[1d]))', Grid(START, END, DAY))
    return out.select("eval_ms", label(F.col("labels"), "event_type").alias("event_type"), (F.round("value", 5) + F.lit(0.0)).alias("value"))


@_registered("s13_sealed_scan", f"{_SUMS} GROUP BY ALL")
def _sealed_scan(spark, sf_dir):
    taken, target = _filled(spark, sf_dir), new_path(spark, "sealed")
    taken.compact(END + 2 * SPAN, target)
    return _asked(spark, Store(spark.read.parquet(target), unique=True))


@_registered("s14_head_scan", f"{_SUMS} GROUP BY ALL")
def _head_scan(spark, sf_dir):
    return _asked(spark, _filled(spark, sf_dir).store(typed=False))


@_registered("t01_tumbling_windows", f"WITH {EV} SELECT (t // {SPAN}) * {SPAN} AS window_start, count(*) AS n FROM ev WHERE event_id % 5 <> 0 GROUP BY ALL")
def _tumbling(spark, sf_dir):
    taken = _filled(spark, sf_dir)
    return taken.read().filter("batch < 2").groupBy("window_start").agg(F.count("*").alias("n"))


_LANES = f"WITH {EV}, l AS (SELECT *, max(t) OVER (PARTITION BY event_type, user_id ORDER BY event_id % 100, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM ev) SELECT event_type, user_id, t AS ts_ms, CASE WHEN last IS NULL THEN 'in_order' WHEN t < last - {5 * DAY} THEN 'too_late' WHEN t < last OR t // {WINDOW} < last // {WINDOW} THEN 'out_of_order' ELSE 'in_order' END AS lane FROM l"


def _laned(spark, sf_dir) -> DataFrame:
    rows = tables.floats(tables._events(spark, sf_dir), "m", F.col("t"), F.col("value"), seq=F.col("event_id") % 100 * 10**9 + F.col("event_id"), event_type="event_type", user_id="user_id")
    return _values(lanes(rows, None, 5 * DAY, WINDOW), "lane").drop("value")


@_registered("t02_out_of_order_bound", f"{_LANES} WHERE last IS NOT NULL AND t < last - {5 * DAY}")
def _too_late(spark, sf_dir):
    return _laned(spark, sf_dir).filter("lane = 'too_late'")


@_registered("t03_lanes", _LANES)
def _all_lanes(spark, sf_dir):
    return _laned(spark, sf_dir)


@_registered("t04_co_sealing", f"WITH {EV} SELECT (t // {SPAN}) * {SPAN} AS window_start, count(*) AS n, round(sum({_LATE}), 5) AS total FROM ev WHERE event_id % 5 <> 0 GROUP BY ALL")
def _co_sealed(spark, sf_dir):
    taken, target = _filled(spark, sf_dir), new_path(spark, "sealed")
    taken.compact(END + 2 * SPAN, target)
    return spark.read.parquet(target).groupBy("window_start").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


@_registered("t05_late_data", f"WITH {EV} SELECT (t // {SPAN}) * {SPAN} AS window_start, count(*) AS n FROM ev WHERE event_id % 5 <> 0 AND event_id % 10 = 3 GROUP BY ALL")
def _late(spark, sf_dir):
    """Windows that were written before get another set of files, of a later batch; nothing is opened again."""
    return _filled(spark, sf_dir).read().filter("batch = 2").groupBy("window_start").agg(F.count("*").alias("n"))


@_registered("t06_watermarks", 'SELECT CAST(event_id % 3 AS INTEGER) AS "partition", min(epoch_us(ts) // 1000) AS min_ms, max(epoch_us(ts) // 1000) AS max_ms, count(*) AS n FROM events GROUP BY ALL')
def _watermarks(spark, sf_dir):
    return otlp.watermarks(event_messages(spark, sf_dir))


def _outcomes(spark, run: Callable[[str], str], asked: list[str]) -> DataFrame:
    return spark.createDataFrame([(q, run(q)) for q in asked], "query string, outcome string")


def _literal(rows: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in rows.items()) + ") x(query, outcome)"


def _refusals(name: str, store: Callable, expected: dict[str, str]) -> None:
    """Queries that must fail, each with its status and kind, or with words of its message (after a :)."""

    def run(spark, sf_dir):
        held = store(spark, sf_dir)

        def one(query: str) -> str:
            try:
                engine.instant(spark, held, query, START).collect()
                return "answered"
            except QueryError as e:
                return f"{e.status} {e.kind}"
            except Exception as e:
                words = expected[query].removeprefix(": ")
                return f": {words}" if words in str(e) else str(e)[:200]

        return _outcomes(spark, one, [*expected])

    QUERIES[name], SQL[name] = run, _literal(expected)


_refusals("p08_refused_selectors", tables.event_value, {"{}": "400 bad_data", '{event_type=""}': "400 bad_data", 'event_value{event_type="a" or user_id="1"}': "422 execution", "event_value @ 5": "422 execution", '{__name__="a",__name__="b"}': "400 bad_data", '{__name__!="a",user_id="1"}': "422 execution"})
_refusals("p12_refused_forms", tables.event_value, {"event_value[5m]": "422 execution", "rate(event_value[5m:1m])": "422 execution", '"text"': "422 execution", "exp(event_value)": "422 execution", "event_value +": "400 bad_data"})
_refusals("p13_virtual_matchers", tables.event_daily, {'event_daily_bucket{le="1",le="2"}': "400 bad_data", 'event_summary_daily{quantile!="0.5"}': "400 bad_data", 'event_summary_daily{quantile=~"0.5"}': "400 bad_data"})
_refusals("b13_set_restrictions", tables.event_value, {"event_value and bool event_value": "400 bad_data", "event_value and on (user_id) group_left event_value": "400 bad_data", "1 and event_value": "400 bad_data", "event_value or 2": "400 bad_data"})
_COUNTED = "last_over_time(event_value[1d])"
_refusals(
    "b14_cardinality",
    lambda spark, sf_dir: Store(tables.event_value(spark, sf_dir).samples.withColumn("ts_ms", F.lit(START)).dropDuplicates(["labels"]), unique=True),
    {
        f"{_COUNTED} + on (event_type) sum by (event_type) ({_COUNTED})": ": duplicate left-hand series",
        f"sum by (event_type) ({_COUNTED}) + on (event_type) {_COUNTED}": ": duplicate right-hand series",
        f"{_COUNTED} + on (event_type) group_left {_COUNTED}": ": group_left",
        f"{_COUNTED} + on (event_type) group_right {_COUNTED}": ": group_right",
    },
)


def _conflicting(spark, sf_dir) -> Store:
    base = tables.event_daily(spark, sf_dir)
    real = tables.floats(spark.range(1), "event_daily_count", F.lit(START), F.lit(1.0), event_type=F.lit("click"))
    return Store(base.samples.unionByName(real), unique=True, typed=True)


_refusals("v08_conflict", _conflicting, {"event_daily_count": ": same labels", "event_daily_sum": "answered"})


def _limits(spark, sf_dir):
    store = tables.event_value(spark, sf_dir)
    limited = {"samples": store.limited(samples=10), "series": store.limited(series=3), "values": store.limited(values=1), "enough": store.limited(10**9, 10**9, 10**9), "steps": store}

    def one(which: str) -> str:
        try:
            grid = Grid(0, engine.MAX_STEPS + 1) if which == "steps" else Grid(END, END)
            return str(engine.evaluate(spark, limited[which], 'count(last_over_time(event_value{event_type=~"c.*|v.*"}[30d]))', grid).count())
        except QueryError as e:
            return f"{e.status} {type(e).__name__}"

    return _outcomes(spark, one, [*limited])


QUERIES["t11_query_limits"], SQL["t11_query_limits"] = _limits, _literal({"samples": "422 LimitExceeded", "series": "422 LimitExceeded", "values": "422 LimitExceeded", "enough": "1", "steps": "422 LimitExceeded"})


def _five(spark) -> Store:
    """m{a="b"}: 1 to 5, every 10 s from 0 on."""
    pairs = [{"name": NAME, "value": "m"}, {"name": "a", "value": "b"}]
    return Store(spark.createDataFrame([(pairs, "m", 10_000 * i, "float", float(i + 1), False, None, None, None, None, None, 0) for i in range(5)], SAMPLES), unique=True)


def _http(name: str, expected: dict[str, str]) -> None:
    def run(spark, sf_dir):
        api, cold = Api(spark, _five(spark), now_ms=40_000), Api(spark, None)

        def one(request: str) -> str:
            method, path, parameters = [*request.split(" "), ""][:3]
            status, body = (cold if method == "COLD" else api).handle("GET" if method == "COLD" else method, path, parameters)
            return f"{status} {body.get('errorType') or json.dumps(body['data'], sort_keys=True) if isinstance(body, dict) else body}"

        return _outcomes(spark, one, [*expected])

    QUERIES[name], SQL[name] = run, _literal(expected)


_http("s16_http_answers", {
    "GET /api/v1/query query=m&time=40": '200 {"result": [{"metric": {"__name__": "m", "a": "b"}, "value": [40.0, "5"]}], "resultType": "vector"}',
    "POST /api/v1/query query=1%2B1": '200 {"result": [40.0, "2"], "resultType": "scalar"}',
    "GET /api/v1/query_range query=m&start=1970-01-01T00:00:20Z&end=40&step=10s": '200 {"result": [{"metric": {"__name__": "m", "a": "b"}, "values": [[20.0, "3"], [30.0, "4"], [40.0, "5"]]}], "resultType": "matrix"}',
    "GET /-/healthy": "200 ok",
    "GET /-/ready": "200 ready",
})
_http("s18_http_errors", {"GET /api/v1/query query=m{": "400 bad_data", "GET /api/v1/query query=exp(m)": "422 execution", "GET /api/v1/query": "400 bad_data", "GET /api/v1/query_range query=m&start=0&end=40&step=0": "400 bad_data", "GET /nothing": "404 not_found", "COLD /api/v1/query query=m": "503 unavailable"})
_http("t10_live_publication", {"COLD /-/ready": "503 not ready", "GET /-/ready": "200 ready", "COLD /api/v1/query query=m": "503 unavailable"})


def _parameters(spark, sf_dir):
    def one(text: str) -> str:
        try:
            kind, _, value = text.partition(" ")
            return str(timestamp_ms(value) if kind == "time" else step_ms(value))
        except QueryError as e:
            return f"{e.status} {e.kind}"

    return _outcomes(spark, one, [*_PARAMETERS])


_PARAMETERS = {"time 1.0005": "1001", "time 2024-01-01T00:00:00+01:00": "1704063600000", "time x": "400 bad_data", "time nan": "400 bad_data", "step 15": "15000", "step 1h30m": "5400000", "step 2w": "1209600000", "step 0": "400 bad_data", "step 5q": "400 bad_data"}
QUERIES["s17_http_parameters"], SQL["s17_http_parameters"] = _parameters, _literal(_PARAMETERS)


def _fingerprints(spark, sf_dir):
    frame = engine.instant(spark, tables.event_value(spark, sf_dir), "last_over_time(event_value[1d])", HALF)
    mark, other = fingerprint(frame.coalesce(1)), fingerprint(frame.repartition(7))
    changed = fingerprint(frame.withColumn("value", F.col("value") + 1))
    ordered = fingerprint(frame.orderBy("labels"), ordered=True)
    found = {"same rows in another order": mark == other, "other values": mark == changed, "ordered, twice": ordered == fingerprint(frame.repartition(5).orderBy("labels"), ordered=True)}
    return _outcomes(spark, lambda q: str(found[q]).lower(), [*found])


QUERIES["s20_fingerprint"], SQL["s20_fingerprint"] = _fingerprints, _literal({"same rows in another order": "true", "other values": "false", "ordered, twice": "true"})
