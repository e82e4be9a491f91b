"""Operators between vectors: equality joins on (evaluation time, match key), semi and anti joins for sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.names import NAME
from ..model import drop, keep
from ..plans.syntax import COMPARISONS, Binary, Matching

TOO_MANY = {
    "left": "duplicate left-hand series for vector matching",
    "right": "duplicate right-hand series for vector matching",
    "group_left": "duplicate right-hand series for group_left vector matching",
    "group_right": "duplicate left-hand series for group_right vector matching",
    "result": "duplicate result series in vector matching",
}


def match_key(m: Matching, labels: Column) -> Column:
    return keep(labels, m.on) if m.on is not None else drop(labels, [*m.ignoring, NAME])


def checked(frame: DataFrame, keys: list[str], message: str, rest: list[str]) -> DataFrame:
    """frame with one row for each key; more raise the message when the query runs."""
    found = frame.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in rest))
    return found.withColumn(keys[0], F.when(F.col("_n") > 1, F.raise_error(F.lit(message)).cast("bigint")).otherwise(F.col(keys[0]))).drop("_n")


def _one_side(vector: DataFrame, m: Matching, message: str | None, prefix: str) -> DataFrame:
    side = vector.select("eval_ms", match_key(m, F.col("labels")).alias("key"), F.col("labels").alias(f"{prefix}labels"), F.col("value").alias(f"{prefix}value"))
    return checked(side, ["eval_ms", "key"], message, [f"{prefix}labels", f"{prefix}value"]) if message else side


def apply(op: str, a: Column, b: Column, bool_: bool) -> Column:
    """The result's value, NULL where a comparison drops it."""
    if op not in COMPARISONS:
        return ieee.ARITHMETIC[op](a, b)
    hit = ieee.COMPARE[op](a, b)
    return F.when(hit, 1.0).otherwise(0.0) if bool_ else F.when(hit, a)


def _result_labels(node: Binary) -> Column:
    m, plain = node.matching, node.op in COMPARISONS and not node.bool_
    left = F.col("l_labels")
    if m.on is not None:
        return keep(left, [n for n in m.on if n != NAME])
    return drop(left, m.ignoring) if plain else drop(left, [*m.ignoring, NAME])


def vectors(node: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
    """(labels, eval_ms, value) of left op right."""
    m = node.matching
    if m.many is None:
        joined = _one_side(left, m, TOO_MANY["left"], "l_").join(_one_side(right, m, TOO_MANY["right"], "r_"), ["eval_ms", "key"])
        out = joined.select("eval_ms", _result_labels(node).alias("labels"), apply(node.op, F.col("l_value"), F.col("r_value"), node.bool_).alias("value")).filter("value is not null")
        return out.select("labels", "eval_ms", "value")
    many, one = ("l_", "r_") if m.many == "left" else ("r_", "l_")
    sides = {"l_": left, "r_": right}
    joined = _one_side(sides[many], m, None, many).join(_one_side(sides[one], m, TOO_MANY[f"group_{m.many}"], one), ["eval_ms", "key"])
    labels = F.col(f"{many}labels")
    if node.op not in COMPARISONS or node.bool_:
        labels = drop(labels, [NAME])
    if m.include:
        labels = F.array_sort(F.concat(drop(labels, m.include), F.filter(keep(F.col(f"{one}labels"), m.include), lambda x: x["value"] != "")))
    out = joined.select("eval_ms", labels.alias("labels"), apply(node.op, F.col("l_value"), F.col("r_value"), node.bool_).alias("value")).filter("value is not null")
    return checked(out, ["eval_ms", "labels"], TOO_MANY["result"], ["value"]).select("labels", "eval_ms", "value")


def sets(node: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
    columns = left.columns
    key = lambda v: v.withColumn("key", match_key(node.matching, F.col("labels")))
    left, right = key(left), key(right)
    if node.op == "or":
        return left.unionByName(right.join(left.select("eval_ms", "key").distinct(), ["eval_ms", "key"], "left_anti")).select(*columns)
    how = "left_semi" if node.op == "and" else "left_anti"
    return left.join(right.select("eval_ms", "key"), ["eval_ms", "key"], how).select(*columns)
