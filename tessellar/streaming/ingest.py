"""Taking in messages as a stream: each micro-batch becomes a set of files under its window, and queries read what is committed.

A batch is decoded, judged by the event-time policy and the out-of-order bound, given reset hints and written under
window_start / batch. Written again after a failure, a batch replaces its own files (its number names them), so every message counts once. The
write order makes later writes win over earlier ones at the same time, the out-of-order lane over the in-order one within a window.
Spark's checkpoint takes the part of a write-ahead log: it says which messages are committed, and restarts go on from there."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import NotReady
from ..model import HIST, LABELS, SAMPLES, SUMMARY
from ..sources import otlp
from ..sources.event_time import EventTimePolicy
from ..sources.store import Store
from .resets import stamp

STATE = f"labels {LABELS}, kind string, last_ms bigint, start_ms bigint, hist {HIST}, summary {SUMMARY}"
IN_ORDER, OUT_OF_ORDER, TOO_LATE = "in_order", "out_of_order", "too_late"


def window_start(ts: str, length_ms: int):
    """The tumbling window of a time."""
    return F.call_function("div", F.col(ts), F.lit(length_ms).cast("bigint")) * length_ms


def lanes(samples: DataFrame, known: DataFrame | None, ooo_window_ms: int, window_ms: int) -> DataFrame:
    """samples with lane: against the largest time of their series so far (known: labels, last_ms) and in this batch before them, in write order.

    Older than that by at most ooo_window_ms, or of a window before the series' active one: out of order; older still: too late."""
    order = Window.partitionBy("labels").orderBy("write_seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = samples.join(known, "labels", "left") if known is not None else samples.withColumn("last_ms", F.lit(None).cast("bigint"))
    last = F.greatest(F.col("last_ms"), F.max("ts_ms").over(order))
    rows = rows.withColumn("_last", last)
    late = F.col("ts_ms") < F.col("_last") - ooo_window_ms
    older = (F.col("ts_ms") < F.col("_last")) | (window_start("ts_ms", window_ms) < window_start("_last", window_ms))
    lane = F.when(F.col("_last").isNull(), IN_ORDER).when(late, TOO_LATE).when(older, OUT_OF_ORDER).otherwise(IN_ORDER)
    return rows.withColumn("lane", lane).drop("_last", "last_ms")


@dataclass
class Ingest:
    """A table of samples under path, fed by streams of captured messages."""

    spark: SparkSession
    path: str
    policy: EventTimePolicy = field(default_factory=EventTimePolicy)
    window_ms: int = 900_000
    ooo_window_ms: int = 0
    capture: str | None = None  # where messages are copied as they come

    def decode(self, messages: DataFrame, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(samples, refused datapoints) of messages; state has what came before them."""
        accepted, refused = self.policy.split(otlp.datapoints(messages))
        rows = otlp.samples(accepted)
        if state is not None:  # the newest samples before come first in write order, and go again
            before = state.filter("hist is not null or summary is not null").select("labels", F.lit("").alias("metric"), F.col("last_ms").alias("ts_ms"), "kind", F.lit(None).cast("double").alias("value"), F.lit(False).alias("is_stale"), "start_ms", F.lit("cumulative").alias("temporality"), F.lit(None).cast("int").alias("reset_hint"), "hist", "summary", F.lit(-1).cast("bigint").alias("write_seq"))
            rows = rows.unionByName(before)
        rows = rows.repartition("labels")  # the one shuffle that hints, lanes and what is known of a series need
        return stamp(rows).filter("write_seq >= 0"), refused

    def state(self, batch: int) -> DataFrame | None:
        """A row for each series and kind as of the batch before: its largest time, and its newest histogram or summary. It grows with series, not samples."""
        for k in range(batch - 1, max(-1, batch - 3), -1):
            try:
                return self.spark.read.schema(STATE).parquet(f"{self.path}_state/batch={k}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        return None

    def _write_state(self, state: DataFrame | None, kept: DataFrame, batch: int) -> None:
        typed = F.when(~F.col("is_stale") & (F.col("hist").isNotNull() | F.col("summary").isNotNull()), F.col("write_seq"))
        newest = kept.groupBy("labels", "kind").agg(F.max("ts_ms").alias("last_ms"), *(F.max_by(c, typed).alias(c) for c in ("start_ms", "hist", "summary")), F.lit(1).alias("_new"))
        if state is not None:
            newest = newest.unionByName(state.withColumn("_new", F.lit(0)))
            known = F.when(F.col("hist").isNotNull() | F.col("summary").isNotNull(), F.col("_new"))
            newest = newest.groupBy("labels", "kind").agg(F.max("last_ms").alias("last_ms"), *(F.max_by(c, known).alias(c) for c in ("start_ms", "hist", "summary")))
        newest.select("labels", "kind", "last_ms", "start_ms", "hist", "summary").write.mode("overwrite").parquet(f"{self.path}_state/batch={batch}")

    def take(self, messages: DataFrame, batch: int) -> None:
        """Write one batch; the same number again replaces what it wrote, starting from the same state."""
        if self.capture:
            otlp.write_capture(messages, f"{self.capture}/batch={batch}")
        state = self.state(batch)
        rows, _ = self.decode(messages, state)
        known = None if state is None else state.groupBy("labels").agg(F.max("last_ms").alias("last_ms"))
        # decoded once, though three passes follow: the bounds of the files' ranges, the files, the state
        kept = lanes(rows, known, self.ooo_window_ms, self.window_ms).filter(F.col("lane") != TOO_LATE).persist(StorageLevel.DISK_ONLY)
        try:
            self._write(kept, state, batch)
        finally:
            kept.unpersist()
        self._note("commits", batch=batch)

    def _write(self, kept: DataFrame, state: DataFrame | None, batch: int) -> None:
        # of one batch, the out-of-order lane is written after the in-order one
        seq = F.lit(batch << 40) + F.when(F.col("lane") == OUT_OF_ORDER, F.lit(1 << 39)).otherwise(F.lit(0)) + F.pmod(F.col("write_seq"), F.lit(1 << 39))
        out = kept.withColumn("write_seq", seq).withColumn("window_start", window_start("ts_ms", self.window_ms)).withColumn("batch", F.lit(batch)).drop("lane")
        out = out.repartitionByRange("metric", F.xxhash64("labels")).sortWithinPartitions("metric", "labels", "ts_ms")  # a large metric is many tasks' work
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start", "batch").parquet(self.path)
        self._write_state(state, kept, batch)  # after the samples: a batch that fails between them is taken again from the same state

    def _note(self, log: str, **fields: int) -> None:
        """Append a line to a log beside the table: batches committed, or windows tombstoned."""
        self.spark.range(1).select(*(F.lit(v).cast("bigint").alias(k) for k, v in fields.items())).coalesce(1).write.mode("append").json(f"{self.path}_{log}")

    def _noted(self, log: str, field: str) -> int | None:
        """The largest value in a log; a row a batch at most, reduced to one number."""
        try:
            return self.spark.read.schema(f"{field} bigint").json(f"{self.path}_{log}").agg(F.max(field)).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return messages.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def read(self) -> DataFrame:
        """What is committed now, without tombstoned windows: a batch that is being written is not read before it is whole, its number pruned as a partition."""
        committed = self._noted("commits", "batch")
        if committed is None:
            raise NotReady("nothing is written yet")
        rows = self.spark.read.schema(f"{SAMPLES}, window_start bigint, batch bigint").parquet(self.path).filter(F.col("batch") <= committed)
        gone = self._noted("tombstones", "retain_after_ms")
        return rows if gone is None else rows.filter(F.col("window_start") + self.window_ms > gone)

    def store(self, typed: bool = True) -> Store:
        """For queries: partitions of windows outside a query's time are pruned by the scan's bounds on ts_ms and window_start."""
        return WindowedStore(self.read(), typed=typed, window_ms=self.window_ms)

    def compact(self, before_ms: int, target: str) -> None:
        """Seal windows that end by before_ms into one file set each, last write wins, sorted by metric, series and time."""
        rows = self.read().filter(F.col("window_start") + self.window_ms <= before_ms)
        rows = Store(rows).last_written(rows).drop("batch")
        rows.repartitionByRange("window_start", "metric", F.xxhash64("labels")).sortWithinPartitions("metric", "labels", "ts_ms").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_start").parquet(target)

    def retain(self, after_ms: int) -> DataFrame:
        """The table without windows that end by after_ms: those are tombstoned for good, and not read by any query from here on."""
        self._note("tombstones", retain_after_ms=after_ms)
        return self.read()


@dataclass
class WindowedStore(Store):
    window_ms: int = 900_000

    def scan(self, matchers, low, high, metric=None) -> DataFrame:
        rows = self.samples
        if low is not None:
            rows = rows.filter(F.col("window_start") > low - self.window_ms)
        if high is not None:
            rows = rows.filter(F.col("window_start") <= high)
        return Store(rows, self.unique, self.typed, self.columns, self.boundaries).scan(matchers, low, high, metric)
