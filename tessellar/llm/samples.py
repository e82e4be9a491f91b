"""Bounded samples of labelled rows, the only thing that fitting a model brings to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a text for training at most a stretch of so many characters is taken, from a place that its hash says; scoring has no such limit.
TRAIN_CHARS = 40_000
#: Models tell at most so many labels apart: the most frequent ones.
MAX_LABELS = 200


def stretch(text: Column) -> Column:
    """The text, or of a longer one TRAIN_CHARS characters."""
    spare = F.length(text) - TRAIN_CHARS
    return F.when(spare > 0, F.substring(text, (F.pmod(F.xxhash64(text), spare + 1) + 1).cast("int"), F.lit(TRAIN_CHARS))).otherwise(text)


def labelled_sample(rows: DataFrame, label: str, per_label: int, extra: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """About per_label rows of each value of label (never over 2 x per_label x values in all), by a hash of doc_id, so the same rows each time."""
    most = rows.filter(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(MAX_LABELS)
    counts = {r[label]: r["count"] for r in most.collect()}
    if not counts:
        return rows.limit(0)
    draw = F.pmod(F.xxhash64(*extra), F.lit(1 << 30))
    below = None
    for value, n in counts.items():
        share = int(min(1.0, per_label / n) * (1 << 30))
        below = F.when(F.col(label) == value, share) if below is None else below.when(F.col(label) == value, share)
    return rows.filter(draw < below).limit(2 * per_label * len(counts))
