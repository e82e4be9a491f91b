"""What the text operators share: tables, scratch folders, byte-level words and their hashes."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is handled in slices of about so many bytes, so that numpy's temporary arrays stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session gets one of its own, which goes when Python ends; on a cluster it is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessellar-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def cut(frame: DataFrame) -> DataFrame:
    """Compute once, write to the shared folder and go on from there."""
    scratch_dir(frame.sparkSession)
    return frame.checkpoint()


def without_estimate(frame: DataFrame) -> DataFrame:
    """The same rows without Spark's estimate of their size. A checkpoint keeps its plan's estimate, and a join's is the product of its sides': in a loop its digits double with each step, until they fill the driver's memory."""
    session = frame.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(frame._jdf.javaRDD(), frame._jdf.schema()), session)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, path: str) -> DataFrame:
    """The frame as a Parquet table, read again."""
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fold(doc_id: Column) -> Column:
    """The remainder that says whether a row is held out: crc32 of the id as text, modulo 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts in UTF-8) in runs of about SLICE_BYTES; null counts as empty."""
    run: list[bytes] = []
    size = first = 0
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if run and size + len(raw) > SLICE_BYTES:
            yield first, run
            run, size, first = [], 0, i
        run.append(raw)
        size += len(raw)
    if run:
        yield first, run


_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0x5851F42D4C957F2D
_INVERSE = pow(_ODD, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MIX)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end]: a polynomial over random byte values, read off prefix sums."""
    n = len(raw)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_ODD, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64) * _MIX)


def words_of(run: list[bytes], is_word: np.ndarray, fold_case: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: its bytes with A-Z lowered, the words' starts and ends, the words' text numbers, and each text's first word.

    is_word tells by byte; texts are kept apart by a byte that is no word byte."""
    raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    if fold_case:
        raw = LOWER[raw]
    starts, ends = runs(is_word[raw])
    stops = np.cumsum(np.fromiter((len(x) + 1 for x in run), np.int64, len(run)))
    owner = np.searchsorted(stops, starts, "right")
    first = np.searchsorted(starts, np.concatenate(([0], stops)))
    return raw, starts, ends, owner, first


_BUCKET = 1 << 15  # bits in a row of Spark's bitmaps


def bitmap(frame: DataFrame, name: str, bits: int) -> np.ndarray:
    """Of the column's longs, which remainders by bits (a power of two) occur, 8 to a byte. bits / _BUCKET rows of 4 KB reach the driver, whatever the frame's size."""
    bit = F.pmod(F.col(name), F.lit(bits))
    buckets = frame.select((bit / _BUCKET).cast("long").alias("bucket"), (bit % _BUCKET).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    flags = np.zeros(bits // 8, np.uint8)
    for row in buckets.toLocalIterator():
        flags[row["bucket"] * _BUCKET // 8 :][: _BUCKET // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return flags


def listed(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values' remainders are in a bitmap: all that it was made of, and few others while it is sparse."""
    bit = values & np.int64(len(flags) * 8 - 1)
    return flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 > 0


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def one_pass(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; what else a table has, under whatever name, can't clash with what is added."""
    return frame.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in columns.items()))
