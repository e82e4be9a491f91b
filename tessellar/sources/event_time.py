"""Which datapoints are taken in by their time, against when they were captured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPTED, MISSING, TOO_OLD, TOO_NEW = "accepted", "missing_timestamp", "too_old", "too_new"


@dataclass(frozen=True)
class EventTimePolicy:
    """Both bounds are inclusive; without drop_outdated only rows without a time are refused."""

    max_age_ms: int = 3_600_000
    max_lead_ms: int = 300_000
    drop_outdated: bool = True

    def decision(self, time_ns: Column, captured_ms: Column) -> Column:
        """0 ns is a missing time; a time under a millisecond is millisecond 0."""
        ts = to_ms(time_ns)
        old, new = ts < captured_ms - self.max_age_ms, ts > captured_ms + self.max_lead_ms
        out = F.when(F.coalesce(time_ns, F.lit(0)) == 0, MISSING)
        return out.when(old, TOO_OLD).when(new, TOO_NEW).otherwise(ACCEPTED) if self.drop_outdated else out.otherwise(ACCEPTED)

    def split(self, rows: DataFrame, time_ns: str = "time_ns", captured_ms: str = "captured_ms") -> tuple[DataFrame, DataFrame]:
        """(rows taken in, rows refused with their decision)."""
        judged = rows.withColumn("decision", self.decision(F.col(time_ns), F.col(captured_ms)))
        return judged.filter(F.col("decision") == ACCEPTED).drop("decision"), judged.filter(F.col("decision") != ACCEPTED)


def to_ms(time_ns: Column) -> Column:
    return F.call_function("div", time_ns.cast("bigint"), F.lit(1_000_000).cast("bigint"))
