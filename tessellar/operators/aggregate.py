"""Aggregations over instant vectors: by evaluation time and grouping labels, combined before the shuffle where the operator allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.names import NAME, float_column
from ..model import drop, keep, put
from ..plans.syntax import Aggregate


def grouping(node: Aggregate) -> Column:
    labels = F.col("labels")
    return drop(labels, [*node.without, NAME]) if node.without is not None else keep(labels, node.by or ())


def _simple(op: str) -> Column:
    v = F.col("value")
    bad = F.max((~ieee.is_finite(v)).cast("int")) == 1
    return {
        "sum": F.sum(v), "count": F.count("*").cast("double"), "avg": ieee.mean(v), "min": F.min(v), "max": ieee.max_ignoring_nan(v), "group": F.lit(1.0),
        "stddev": F.when(bad, ieee.NAN).otherwise(F.stddev_pop(v)), "stdvar": F.when(bad, ieee.NAN).otherwise(F.greatest(F.var_pop(v), F.lit(0.0))),
    }[op]


def evaluate(node: Aggregate, vector: DataFrame, param: float | str | None) -> DataFrame:
    """(labels, eval_ms, value) of an aggregation over (labels, eval_ms, value)."""
    group = grouping(node)
    if node.op in ("topk", "bottomk"):
        value = F.col("value").desc() if node.op == "topk" else F.col("value").asc()
        ranked = Window.partitionBy("eval_ms", "g").orderBy(F.isnan("value"), value, "labels")
        return vector.withColumn("g", group).withColumn("k", F.row_number().over(ranked)).filter(F.col("k") <= int(param)).select("labels", "eval_ms", "value")
    if node.op == "count_values":
        named = vector.select(put(group, param, float_column(F.col("value"))).alias("labels"), "eval_ms")
        return named.groupBy("labels", "eval_ms").agg(F.count("*").cast("double").alias("value"))
    value = ieee.quantile(F.col("value"), param) if node.op == "quantile" else _simple(node.op)
    return vector.select(group.alias("labels"), "eval_ms", "value").groupBy("labels", "eval_ms").agg(value.alias("value"))
