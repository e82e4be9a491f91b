"""Protobuf requests: by hand, round trips, and messages that are cut off or overflow."""

import json

import pytest

from tessellar.sources import otlp, otlp_wire


def test_by_hand():
    """gauge "g" = 1.5 at 7 ns, with an unknown field: bytes written out after the public format."""
    point = b"\x19" + (7).to_bytes(8, "little") + b"\x21\x00\x00\x00\x00\x00\x00\xf8\x3f" + b"\x9a\x06\x03abc"
    metric = b"\x0a\x01g" + b"\x2a" + bytes([len(point) + 2]) + b"\x0a" + bytes([len(point)]) + point
    scope = b"\x12" + bytes([len(metric)]) + metric
    resource = b"\x12" + bytes([len(scope)]) + scope
    raw = b"\x0a" + bytes([len(resource)]) + resource
    assert otlp_wire.decode(raw) == {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "7", "asDouble": 1.5}]}}]}]}]}
    for bad in (raw[:-1], raw + b"\x0a", b"\x08" + b"\xff" * 9 + b"\x7f", b"\x0b", b"\x0a\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01"):
        with pytest.raises(otlp_wire.Malformed):
            otlp_wire.decode(bad)


def test_packed():
    side = b"\x08\x03" + b"\x12\x03\x01\xac\x02"
    assert otlp_wire.decode(side, "Side") == {"offset": -2, "bucketCounts": ["1", "300"]}
    assert otlp_wire.decode(b"\x08\x03\x10\x05\x10\x06", "Side") == {"offset": -2, "bucketCounts": ["5", "6"]}


def test_same_as_json(spark):
    """Samples of protobuf payloads equal those of the same requests in JSON."""
    exp = {"attributes": [{"key": "a", "value": {"intValue": "-3"}}], "timeUnixNano": "9000000", "startTimeUnixNano": "1", "count": "6", "sum": 2.5, "scale": -1, "zeroCount": "1", "positive": {"offset": -2, "bucketCounts": ["2", "3"]}, "negative": {"offset": 0, "bucketCounts": []}}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "5000000", "asInt": "-7", "attributes": [{"key": "up", "value": {"boolValue": True}}]}]}},
        {"name": "h", "histogram": {"aggregationTemporality": "2", "dataPoints": [{"timeUnixNano": "6000000", "count": "3", "sum": 4.0, "bucketCounts": ["1", "2"], "explicitBounds": [1.5], "flags": 0}]}},
        {"name": "e", "exponentialHistogram": {"aggregationTemporality": "1", "dataPoints": [exp]}},
        {"name": "q", "summary": {"dataPoints": [{"timeUnixNano": "8000000", "count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}]}]}},
    ]
    texts = [otlp.request(m, {"service": "x", "share": 0.5}) for m in metrics]
    as_json = spark.createDataFrame([(i, 0, 50, t) for i, t in enumerate(texts)], otlp.CAPTURE)
    raw = [(i, 0, 50, bytearray(otlp_wire.encode(json.loads(t)))) for i, t in enumerate(texts)] + [(9, 0, 50, bytearray(b"\x0a\x05x")), (10, 0, 50, None)]
    as_bytes = otlp_wire.to_json(spark.createDataFrame(raw, "seq bigint, partition int, captured_ms bigint, payload binary"))
    read = lambda m: sorted(map(repr, otlp.samples(otlp.datapoints(m)).collect()))
    assert read(as_bytes) == read(as_json) and len(read(as_json)) == 4
    assert as_bytes.filter("payload is null").count() == 2
    assert [tuple(r) for r in otlp.watermarks(as_bytes).collect()] == [(0, 5, 9, 4)]
