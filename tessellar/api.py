"""Queries as the HTTP API of a Prometheus server answers them: parameters, envelopes, errors. Any web server can call `handle`."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
import re
from dataclasses import dataclass
from urllib.parse import parse_qs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import Invalid, LimitExceeded, NotReady, QueryError
from .functions import histograms
from .functions.names import float_text
from .plans import engine
from .plans.syntax import UNITS, is_scalar, parse
from .sources.store import Store


def timestamp_ms(text: str) -> int:
    """Unix seconds or RFC 3339, rounded to milliseconds."""
    try:
        seconds = float(text)
        if not math.isfinite(seconds):
            raise Invalid(f"cannot parse {text!r} to a valid timestamp")
        return math.floor(seconds * 1000 + 0.5)
    except ValueError:
        pass
    try:
        moment = dt.datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    except ValueError as e:
        raise Invalid(f"cannot parse {text!r} to a valid timestamp") from e
    if moment.tzinfo is None:
        raise Invalid(f"cannot parse {text!r} to a valid timestamp")
    return math.floor(moment.timestamp() * 1000 + 0.5)


def step_ms(text: str) -> int:
    """Seconds, or units of ms, s, m, h, d, w, y one after the other."""
    try:
        out = round(float(text) * 1000)
    except (ValueError, OverflowError):
        parts = re.findall(r"(\d+)(ms|[smhdwy])", text)
        if not parts or "".join(a + b for a, b in parts) != text:
            raise Invalid(f"cannot parse {text!r} to a valid duration") from None
        out = sum(int(a) * UNITS[b] for a, b in parts)
    if out <= 0:
        raise Invalid("zero or negative query resolution step widths are not accepted")
    return out


def _number(value: float) -> str:
    return float_text(value)


def _histogram(h) -> dict:
    """count, sum and buckets [rule, lower, upper, count]: rule 0 is open at the left, 1 at the right, 3 closed on both sides."""
    out = {"count": _number(h["count"]), **({} if h["sum"] is None else {"sum": _number(h["sum"])})}
    rule = {"neg": 1, "pos": 0}
    found = [[3 if kind == "line" and h["exp"] else rule.get(kind, 0), _number(low), _number(high), _number(n)] for low, high, n, kind in histograms._spans(h if isinstance(h, dict) else h.asDict(True)) if n]
    return out | ({"buckets": found} if found else {})


def _point(row) -> tuple[str, list]:
    at = row["eval_ms"] / 1000
    if "hist" in row and row["hist"] is not None:
        return "histogram", [at, _histogram(row["hist"])]
    return "value", [at, _number(row["value"])]


def result_json(frame: DataFrame, kind: str, limit: int = 1_000_000) -> dict:
    """The data of an answer: scalar, vector or matrix. More rows than limit are an error, so the driver's memory is bounded."""
    rows = frame.limit(limit + 1).collect()
    if len(rows) > limit:
        raise LimitExceeded(f"the result has more than {limit} samples")
    rows = [r.asDict() for r in rows]
    if kind == "scalar":
        return {"resultType": "scalar", "result": _point(rows[0])[1]}
    metric = lambda r: {x["name"]: x["value"] for x in r["labels"]}
    if kind == "vector":
        return {"resultType": "vector", "result": [{"metric": metric(r), **dict([_point(r)])} for r in rows]}
    series: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: r["eval_ms"]):
        name = metric(r)
        one = series.setdefault(json.dumps(name, sort_keys=True), {"metric": name})
        key, point = _point(r)
        one.setdefault(f"{key}s", []).append(point)
    return {"resultType": "matrix", "result": [series[k] for k in sorted(series)]}


@dataclass
class Api:
    spark: SparkSession
    store: Store | None
    now_ms: int = 0

    def query(self, query: str, time: str | None = None) -> dict:
        node = parse(query)
        at = self.now_ms if time is None else timestamp_ms(time)
        frame = engine.instant(self.spark, self._store(), query, at)
        return result_json(frame, "scalar" if is_scalar(node) else "vector")

    def query_range(self, query: str, start: str, end: str, step: str) -> dict:
        frame = engine.range_query(self.spark, self._store(), query, timestamp_ms(start), timestamp_ms(end), step_ms(step))
        return result_json(frame, "matrix")

    def _store(self) -> Store:
        if self.store is None:
            raise NotReady("the live view is not ready")
        return self.store

    def handle(self, method: str, path: str, parameters: str = "") -> tuple[int, dict | str]:
        """(status, body) of GET with a query string or POST with a form."""
        if path == "/-/healthy":
            return 200, "ok"
        if path == "/-/ready":
            return (200, "ready") if self.store is not None else (503, "not ready")
        given = {k: v[-1] for k, v in parse_qs(parameters, keep_blank_values=True).items()}
        needed = {"/api/v1/query": ("query",), "/api/v1/query_range": ("query", "start", "end", "step")}.get(path)
        if needed is None or method not in ("GET", "POST"):
            return 404, {"status": "error", "errorType": "not_found", "error": path}
        try:
            if missing := [k for k in needed if k not in given]:
                raise Invalid(f"missing parameter {missing[0]}")
            data = self.query(given["query"], given.get("time")) if path == "/api/v1/query" else self.query_range(*(given[k] for k in needed))
        except QueryError as e:
            return e.status, {"status": "error", "errorType": e.kind, "error": str(e)}
        return 200, {"status": "success", "data": data}


def fingerprint(frame: DataFrame, ordered: bool = False) -> str:
    """SHA-256 of a result's rows: in their order, or whatever their order. Without order the rows' hashes are added up in Spark, and the driver sees the sums."""
    digest = hashlib.sha256()
    if not ordered:
        row = F.sha2(F.to_json(F.struct("labels", "eval_ms", F.hex(F.col("value").cast("string").cast("binary")).alias("value"))), 256)
        parts = frame.select(*(F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)").alias(f"p{k}") for k in range(8)))
        sums = parts.agg(F.count("*"), *(F.sum(f"p{k}") for k in range(8))).first()
        digest.update(" ".join(str(x) for x in sums).encode())
        return digest.hexdigest()
    lines = (json.dumps([[(x["name"], x["value"]) for x in r["labels"]], r["eval_ms"], None if r["value"] is None else float(r["value"]).hex()]) for r in frame.toLocalIterator())
    for line in lines:
        digest.update(line.encode() + b"\n")
    return digest.hexdigest()
