"""Messages to samples: decoding, the event-time policy, reset hints, lanes, streams, and queries over what they wrote."""

import json
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellar.api import Api, step_ms, timestamp_ms
from tessellar.errors import Invalid, NotReady
from tessellar.functions.names import NAME, label_name, metric_name
from tessellar.sources import otlp
from tessellar.sources.event_time import EventTimePolicy
from tessellar.sources.store import Store
from tessellar.streaming.ingest import Ingest, lanes
from tessellar.streaming.resets import stamp

from .helpers import at, row, series, store

NS = 1_000_000


def gauge(name, value, t, **attributes):
    point = {"timeUnixNano": str(t * NS), "attributes": [{"key": k, "value": {"stringValue": v}} for k, v in attributes.items()]}
    if value is not None:
        point["asDouble" if isinstance(value, float) else "asInt"] = value if isinstance(value, float) else str(value)
    return {"name": name, "gauge": {"dataPoints": [point]}}


def histogram(name, count, total, counts, t, start=0, temporality=2, bounds=(1.0, 2.0)):
    return {"name": name, "histogram": {"aggregationTemporality": str(temporality), "dataPoints": [{"timeUnixNano": str(t * NS), "startTimeUnixNano": str(start * NS), "count": str(count), "sum": total, "bucketCounts": [str(c) for c in counts], "explicitBounds": list(bounds)}]}}


def messages(spark, metrics, captured=50_000, resource=None):
    rows = [(i, 0, captured, otlp.request(m, resource)) for i, m in enumerate(metrics)]
    return spark.createDataFrame(rows, otlp.CAPTURE)


def test_decode(spark):
    exp = {"name": "e", "exponentialHistogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [{"timeUnixNano": str(5_000 * NS), "startTimeUnixNano": "1", "count": "4", "sum": 8.0, "scale": 1, "zeroCount": "1", "positive": {"offset": 2, "bucketCounts": ["1", "0", "2"]}}]}}
    summary = {"name": "q", "summary": {"dataPoints": [{"timeUnixNano": "999999", "count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}}
    metrics = [gauge("cpu.usage", 2.5, 1_000, pod="x"), gauge("n", 7, 1_000), gauge("empty", None, 1_000), histogram("h", 3, 4.0, [1, 1, 1], 2_000), histogram("bad", 3, 4.0, [1, 1], 2_000), histogram("bad2", 9, 4.0, [1, 1, 1], 2_000), exp, summary]
    points = otlp.datapoints(messages(spark, metrics, resource={"service.name": "api", "pod": "y", "up": True, "n": 3, "x": 1.5}))
    got = {r["metric"]: r for r in otlp.samples(points).collect()}
    assert sorted(otlp.refused(points).collect()) == [("float", 1), ("hist", 2)]
    cpu = next(v for k, v in got.items() if k.startswith("cpu_usage_x"))
    labels = {x["name"]: x["value"] for x in cpu["labels"]}
    assert cpu["value"] == 2.5 and labels["pod"] == "x" and labels["service_name_x55e50a58f9befba7"] == "api" and labels["up"] == "true" and labels["n"] == "3" and labels["x"] == "1.5"
    assert [x["name"] for x in cpu["labels"]] == sorted(labels)
    assert got["n"]["value"] == 7.0
    assert got["h"]["hist"]["counts"] == [1.0, 1.0, 1.0] and got["h"]["temporality"] == "cumulative"
    assert [tuple(b) for b in got["e"]["hist"]["pos"]] == [(2, 1.0), (4, 2.0)] and got["e"]["temporality"] == "delta" and got["e"]["start_ms"] == 0
    assert got["q"]["ts_ms"] == 0 and got["q"]["summary"]["quantiles"][0]["v"] == 1.0
    assert len(got) == 5


def test_policy(spark):
    times = [0, 1, 39_999 * NS, 40_000 * NS, 50_000 * NS, 51_000 * NS, 51_001 * NS]
    rows = spark.createDataFrame([(t, 50_000) for t in times], "time_ns bigint, captured_ms bigint")
    kept, refused = EventTimePolicy(10_000, 1_000).split(rows)
    assert [r["time_ns"] for r in kept.collect()] == times[3:6]
    assert [r["decision"] for r in refused.collect()] == ["missing_timestamp", "too_old", "too_old", "too_new"]
    kept, refused = EventTimePolicy(10_000, 1_000, drop_outdated=False).split(rows)
    assert kept.count() == 6 and refused.count() == 1


def test_reset_hints(spark):
    metrics = [histogram("h", 3, 4.0, [1, 1, 1], 1_000, 500), histogram("h", 6, 8.0, [2, 2, 2], 2_000, 500), histogram("h", 2, 1.0, [2, 0, 0], 3_000, 500), histogram("h", 5, 9.0, [5, 0, 0], 4_000, start=3_500), histogram("h", 5, 9.0, [5, 0], 5_000, start=3_500, bounds=(1.0,)), histogram("d", 1, 1.0, [1, 0, 0], 1_000, temporality=1)]
    rows = stamp(otlp.samples(otlp.datapoints(messages(spark, metrics)))).orderBy("write_seq").collect()
    assert [r["reset_hint"] for r in rows] == [0, 2, 1, 1, 0, 2]


def test_lanes(spark):
    rows = series("m{a=b}", [1, 2, 3]) + [row({"__name__": "m", "a": "b"}, t, 9.0, seq=s) for t, s in ((15_000, 10), (5_000, 11), (30_000, 12))]
    rows = [r[:-1] + (i,) for i, r in enumerate(rows)]
    frame = store(spark, rows).samples
    got = [r["lane"] for r in lanes(frame, None, 10_000, 60_000).orderBy("write_seq").collect()]
    assert got == ["in_order"] * 3 + ["out_of_order", "too_late", "in_order"]
    known = spark.createDataFrame([(rows[0][0], 100_000)], "labels array<struct<name: string, value: string>>, last_ms bigint")
    assert {r["lane"] for r in lanes(frame, known, 10_000, 60_000).collect()} == {"too_late"}


def test_stream(spark, tmp_path):
    """Files of messages, taken in one by one, give the same answers as the batch; a replayed batch changes nothing; late data come second but win."""
    source, first = tmp_path / "source", None
    source.mkdir()
    all_messages = []
    for k in range(3):
        metrics = [gauge("g", float(10 * k + j), 1_000 * (3 * k + j) + 1_000) for j in range(3)] + [histogram("h", 3 * (k + 1), 4.0 * (k + 1), [k + 1] * 3, 3_000 * k + 3_000)]
        rows = [{"seq": 10 * k + i, "partition": 0, "captured_ms": 10_000, "payload": otlp.request(m, {"job": "a"})} for i, m in enumerate(metrics)]
        if k == 1:
            rows.append({"seq": 19, "partition": 0, "captured_ms": 10_000, "payload": otlp.request(gauge("g", 99.0, 2_000), {"job": "a"})})
        all_messages += rows
        (source / f"{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age
    ingest = Ingest(spark, str(tmp_path / "table"), EventTimePolicy(60_000, 60_000), window_ms=5_000, ooo_window_ms=60_000, capture=str(tmp_path / "copy"))
    with pytest.raises(NotReady):
        ingest.read()
    query = ingest.start(otlp.stream_capture(spark, str(source), max_files=1), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    first = at(spark, ingest.store(), "sum_over_time(g[1m])", 10_000)
    assert first == {"job=a": sum([0, 1, 2, 10, 11, 12, 20, 21, 22]) - 1 + 99}
    batch = Store(otlp.samples(otlp.datapoints(otlp.read_capture(spark, str(source)))), typed=True)
    assert at(spark, batch, "sum_over_time(g[1m])", 10_000) == first
    assert at(spark, ingest.store(), "histogram_count(h)", 10_000) == {"job=a": 9} == at(spark, batch, "histogram_count(h)", 10_000)
    hints = {(r["ts_ms"], r["kind"]): r["reset_hint"] for r in ingest.read().collect()}
    assert [hints[t, "hist"] for t in (3_000, 6_000, 9_000)] == [0, 2, 2]  # compared across batches
    n = ingest.read().count()
    ingest.take(otlp.read_capture(spark, str(source / "2.json")), 2)
    assert ingest.read().count() == n
    assert otlp.read_capture(spark, str(tmp_path / "copy")).count() >= len(all_messages)
    ingest.compact(10_000, str(tmp_path / "sealed"))
    sealed = Store(spark.read.parquet(str(tmp_path / "sealed")), typed=True)
    assert at(spark, sealed, "sum_over_time(g[1m])", 10_000) == first
    assert ingest.retain(5_000).agg(F.min("window_start")).first()[0] == 5_000


def test_discovery(spark):
    held = store(spark, series("cpu{ns=a,pod=1}", [1, 2]) + series("mem{ns=b}", [None, None, 1]))
    names = lambda f: [r[0] for r in f.collect()]
    assert names(held.metric_names()) == ["cpu", "mem"] and names(held.metric_names(0, 10_000)) == ["cpu"]
    assert names(held.label_names()) == ["__name__", "ns", "pod"] and names(held.label_values("ns", 15_000, 30_000)) == ["b"]
    assert names(held.label_values("__name__")) == ["cpu", "mem"]
    assert tuple(held.latest_window(15_000).first()) == (20_000, 20_000)


def test_api(spark):
    api = Api(spark, store(spark, series("m{a=b}", [1, 2, 3, 4, 5]), unique=True), now_ms=40_000)
    assert api.handle("GET", "/api/v1/query", "query=m&time=40") == (200, {"status": "success", "data": {"resultType": "vector", "result": [{"metric": {"__name__": "m", "a": "b"}, "value": [40.0, "5"]}]}})
    assert api.handle("POST", "/api/v1/query", "query=1%2B1")[1]["data"] == {"resultType": "scalar", "result": [40.0, "2"]}
    data = api.handle("GET", "/api/v1/query_range", "query=m&start=1970-01-01T00:00:20Z&end=40&step=10s")[1]["data"]
    assert data == {"resultType": "matrix", "result": [{"metric": {"__name__": "m", "a": "b"}, "values": [[20.0, "3"], [30.0, "4"], [40.0, "5"]]}]}
    assert api.handle("GET", "/api/v1/query", "query=m{")[0] == 400 and api.handle("GET", "/api/v1/query", "query=exp(m)")[0] == 422
    assert api.handle("GET", "/api/v1/query", "")[0] == 400 and api.handle("GET", "/nothing")[0] == 404
    assert api.handle("GET", "/-/ready")[0] == 200 and Api(spark, None).handle("GET", "/-/ready")[0] == 503
    assert Api(spark, None).handle("GET", "/api/v1/query", "query=m")[0] == 503
    assert api.handle("GET", "/api/v1/query_range", "query=m&start=0&end=40&step=0")[0] == 400
    assert timestamp_ms("1.0005") == 1001 and timestamp_ms("2024-01-01T00:00:00+01:00") == 1_704_063_600_000 and step_ms("1h30m") == 5_400_000
    for bad in ("x", "nan", "2024-01-01"):
        with pytest.raises(Invalid):
            timestamp_ms(bad)


def test_a_batch_is_decoded_once(spark, tmp_path):
    """The files' ranges, the files and the state are three passes over a batch, but its messages are read once."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    point = {"timeUnixNano": str(10**15), "asDouble": 1.0}
    rows = [(i, 0, 10**9, otlp.request({"name": "m", "gauge": {"dataPoints": [point]}}, {"k": f"v{i}"})) for i in range(40)]
    messages = spark.createDataFrame(rows, otlp.CAPTURE).mapInArrow(counted, otlp.CAPTURE)
    taken = Ingest(spark, f"{tmp_path}/table", EventTimePolicy(drop_outdated=False))
    taken.take(messages, 0)
    assert seen.value == 40
    assert taken.read().count() == 40 and taken.state(1).count() == 40


def test_labels_of_whole_batches():
    """Names and labels of a batch at once against one row after the other: keys twice, plain names of several keys, nulls, empty lists, slices."""
    rng = random.Random(3)
    keys = ["a", "b.c", label_name("b.c"), "__x", "", NAME, None, "é", "0a", "z", "A"]
    names = [rng.choice(["m", "x.y", "é", "a:b"]) for _ in range(300)]
    pairs = [None if rng.random() < 0.1 else [{"key": rng.choice(keys), "value": rng.choice(["1", "", None, "q"])} for _ in range(rng.randrange(7))] for _ in names]

    def one(name, attributes):
        merged = {p["key"]: p["value"] for p in attributes or [] if p["key"] and p["key"] != NAME and p["value"] is not None}
        labels = {label_name(k): v for k, v in merged.items()} | {NAME: metric_name(name)}
        return {"metric": labels[NAME], "labels": [{"name": k, "value": v} for k, v in sorted(labels.items())]}

    kind = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
    want = [one(*x) for x in zip(names, pairs, strict=True)]
    for part in (slice(0, 300), slice(7, 90), slice(5, 5)):
        assert otlp.canonical(pa.array(names, pa.string())[part], pa.array(pairs, kind)[part]).to_pylist() == want[part]
