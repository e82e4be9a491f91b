"""OTLP export requests in protobuf's wire format, to the JSON form that `otlp.datapoints` reads. Field numbers and types are those of the public
opentelemetry-proto; unknown fields are skipped. A truncated or overlong message gives NULL, so it is counted and left out."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Message: {field number: (name, kind)}; a kind ending in * repeats, a capital one is a message.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "Request": {1: ("resourceMetrics", "ResourceMetrics*")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "ScopeMetrics*")},
    "Resource": {1: ("attributes", "KeyValue*")},
    "ScopeMetrics": {2: ("metrics", "Metric*")},
    "Metric": {1: ("name", "string"), 5: ("gauge", "Data"), 7: ("sum", "Data"), 9: ("histogram", "HistogramData"), 10: ("exponentialHistogram", "ExponentialData"), 11: ("summary", "SummaryData")},
    "Data": {1: ("dataPoints", "Number*"), 2: ("aggregationTemporality", "enum"), 3: ("isMonotonic", "bool")},
    "HistogramData": {1: ("dataPoints", "Histogram*"), 2: ("aggregationTemporality", "enum")},
    "ExponentialData": {1: ("dataPoints", "Exponential*"), 2: ("aggregationTemporality", "enum")},
    "SummaryData": {1: ("dataPoints", "Summary*")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double")},
    "Number": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 6: ("asInt", "sfixed64"), 7: ("attributes", "KeyValue*"), 8: ("flags", "uint32")},
    "Histogram": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("bucketCounts", "fixed64*"), 7: ("explicitBounds", "double*"), 9: ("attributes", "KeyValue*"), 10: ("flags", "uint32"), 11: ("min", "double"), 12: ("max", "double")},
    "Exponential": {1: ("attributes", "KeyValue*"), 2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("scale", "sint32"), 7: ("zeroCount", "fixed64"), 8: ("positive", "Side"), 9: ("negative", "Side"), 10: ("flags", "uint32"), 12: ("min", "double"), 13: ("max", "double"), 14: ("zeroThreshold", "double")},
    "Side": {1: ("offset", "sint32"), 2: ("bucketCounts", "uint64*")},
    "Summary": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("quantileValues", "Quantile*"), 7: ("attributes", "KeyValue*"), 8: ("flags", "uint32")},
    "Quantile": {1: ("quantile", "double"), 2: ("value", "double")},
}
_FIXED = {"fixed64": "<Q", "sfixed64": "<q", "double": "<d"}
#: 64-bit integers are strings in the JSON form.
_TEXT = ("fixed64", "sfixed64", "int64", "uint64", "enum")


class Malformed(ValueError):
    """The bytes are no message."""


def _varint(raw: bytes, at: int, end: int) -> tuple[int, int]:
    out = 0
    for shift in range(0, 70, 7):
        if at >= end:
            raise Malformed("cut off")
        byte = raw[at]
        at += 1
        out |= (byte & 127) << shift
        if byte < 128:
            if out >> 64:
                raise Malformed("a number of over 64 bits")
            return out, at
    raise Malformed("a number of over 64 bits")


def _scalar(kind: str, number: int):
    if kind == "bool":
        return number != 0
    if kind == "sint32":
        return (number >> 1) ^ -(number & 1)
    if kind == "int64" and number >> 63:
        number -= 1 << 64
    return str(number) if kind in _TEXT else number


def _fixed(kind: str, raw: bytes, at: int):
    value = struct.unpack_from(_FIXED[kind], raw, at)[0]
    return str(value) if kind in _TEXT else value


def decode(raw: bytes, message: str = "Request", at: int = 0, end: int | None = None) -> dict:
    """A message as a dictionary in JSON form."""
    end = len(raw) if end is None else end
    fields, out = MESSAGES[message], {}
    while at < end:
        tag, at = _varint(raw, at, end)
        name, kind = fields.get(tag >> 3, ("", ""))
        many, kind, wire = kind.endswith("*"), kind.rstrip("*"), tag & 7
        if wire == 0:
            number, at = _varint(raw, at, end)
            found = [_scalar(kind, number)] if name and kind not in _FIXED and not kind[0].isupper() and kind != "string" else []
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > end:
                raise Malformed("cut off")
            found = [_fixed(kind, raw, at)] if kind in _FIXED and wire == 1 else []
            at += size
        elif wire == 2:
            size, at = _varint(raw, at, end)
            stop = at + size
            if stop > end:
                raise Malformed("cut off")
            if not name:
                found = []
            elif kind == "string":
                found = [raw[at:stop].decode("utf-8")]
            elif kind[0].isupper():
                found = [decode(raw, kind, at, stop)]
            elif kind in _FIXED:  # packed
                if size % 8:
                    raise Malformed("cut off")
                found = [_fixed(kind, raw, k) for k in range(at, stop, 8)]
            else:
                found, k = [], at
                while k < stop:
                    number, k = _varint(raw, k, stop)
                    found.append(_scalar(kind, number))
            at = stop
        else:
            raise Malformed(f"wire type {wire}")
        if many:
            out.setdefault(name, []).extend(found)
        elif found:
            out[name] = found[-1]
    return out


def to_json(messages: DataFrame) -> DataFrame:
    """messages (seq, partition, captured_ms, payload binary) with the payload in JSON form; NULL where it is no message."""

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else json.dumps(decode(raw))
        except (Malformed, UnicodeDecodeError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([one(x) for x in batch.column(3).to_pylist()], pa.string())], names=["seq", "partition", "captured_ms", "payload"])

    return messages.select("seq", "partition", "captured_ms", "payload").mapInArrow(run, "seq bigint, partition int, captured_ms bigint, payload string")


def encode(value: dict, message: str = "Request") -> bytes:
    """The wire format of a dictionary in JSON form, for captures and tests."""
    number = lambda n: b"" if n < 0 else bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    out = b""
    for field, (name, kind) in MESSAGES[message].items():
        if name not in value:
            continue
        many, kind = kind.endswith("*"), kind.rstrip("*")
        for x in value[name] if many else [value[name]]:
            if kind[0].isupper() or kind == "string":
                body = encode(x, kind) if kind[0].isupper() else x.encode()
                out += number(field << 3 | 2) + number(len(body)) + body
            elif kind in _FIXED:
                out += number(field << 3 | 1) + struct.pack(_FIXED[kind], float(x) if kind == "double" else int(x))
            else:
                n = int(x)
                out += number(field << 3) + number((n << 1) ^ (n >> 31) if kind == "sint32" else n & ((1 << 64) - 1))
    return out
