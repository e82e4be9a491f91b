"""Small stores written by hand, and results as plain Python."""

from tessellar.functions.names import NAME
from tessellar.model import SAMPLES
from tessellar.plans import engine
from tessellar.sources.store import Store

STALE = "stale"


def row(labels, ts_ms, value=None, kind="float", hist=None, summary=None, stale=False, start_ms=None, temporality=None, hint=None, seq=0):
    pairs = [{"name": k, "value": v} for k, v in sorted(labels.items())]
    return (pairs, labels[NAME], ts_ms, kind, value, stale, start_ms, temporality, hint, hist, summary, seq)


def series(text, values, step_ms=10_000, **more):
    """text: name{k=v,...}; a value every step from 0 on; None is no sample, STALE a stale marker."""
    name, _, rest = text.partition("{")
    labels = {NAME: name} | dict(x.split("=") for x in rest.rstrip("}").split(",") if x)
    return [row(labels, i * step_ms, None if v == STALE else float(v), stale=v == STALE, **more) for i, v in enumerate(values) if v is not None]


def store(spark, rows, **more):
    return Store(spark.createDataFrame(rows, SAMPLES), **more)


def rows_of(frame):
    return {(r["eval_ms"], tuple((x["name"], x["value"]) for x in r["labels"])): r["value"] for r in frame.collect()}


def at(spark, held, query, time_ms=40_000):
    """{labels as text: value} of an instant query."""
    return {",".join(f"{n}={v}" for n, v in labels): value for (_, labels), value in rows_of(engine.instant(spark, held, query, time_ms)).items()}
