"""The grid of evaluation times, as a column: an instant query has one time, a range query many, and both the same plan."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    start: int
    end: int
    step: int = 1

    def __post_init__(self):
        object.__setattr__(self, "end", self.start + (self.end - self.start) // self.step * self.step)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.start, self.end + 1, self.step, 1).select(F.col("id").alias("eval_ms"))

    @property
    def size(self) -> int:
        return (self.end - self.start) // self.step + 1

    def times(self, ts: Column, length: int, offset: int = 0, reach: int = 0) -> Column:
        """The evaluation times e with ts in (e - offset - length, e - offset], as an array; ts may also stand for (ts - reach, ts].

        Arithmetic on whole milliseconds, so no inequality join is needed."""
        s, p, n = self.start - offset, self.step, self.size
        shift = F.lit(10**6 * p)  # div truncates toward zero: keep its operand positive
        up = lambda x: (x + (p - 1) + shift).cast("bigint")
        first = F.greatest(F.lit(0), _div(up(ts - s), p) - 10**6)
        last = F.least(F.lit(n - 1), _div(ts - reach + length - 1 - s + shift, p) - 10**6)
        steps = F.when(first <= last, F.sequence(first.cast("bigint"), F.greatest(first, last).cast("bigint")))
        return F.transform(steps, lambda k: k * p + self.start)

    def bounds(self, length: int, offset: int = 0) -> tuple[int, int]:
        """The least and largest time that a window of so much can read."""
        return self.start - offset - length + 1, self.end - offset

    def slot(self, length: int) -> int:
        """The longest slots such that each window of that length is made of whole ones."""
        return math.gcd(length, self.step) if self.size > 1 else length


def _div(x: Column, p: int) -> Column:
    return F.call_function("div", x.cast("bigint"), F.lit(p).cast("bigint"))
