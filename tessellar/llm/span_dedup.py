"""Substring dedup: sliding sentence spans.

A sentence ends at a word that ends in one of .!? or before a line end. A sentence of more than `long` words has no end that
two texts would share if a passage stands in its middle, so it is cut further behind each word whose hash is a multiple
of 3: such places depend on the words alone. From every sentence the run of the next consecutive ones is hashed, as many as it
takes for `run` sentences and `words` words; a text too short for that is one run. Runs are joined over the whole corpus by hash: of
each run that stands more than once, the first is where it stands in the smallest (doc_id, hash of the text, place). Every sentence
that some run other than a first one covers is removed from its text; what is left stays as it was written.

Texts are read for their runs twice: first runs' hashes alone are counted, which leaves those that stand more than once; a bitmap of them, of
fixed size, lets the second reading pass on only runs that may be among them (the joins that follow are exact, so what
it passes in error does no harm). The least place of each run is combined before the shuffle, and runs meet it again in an equality
join that can be split where a run is very frequent, so a passage in a third of all texts is no single task's work. Texts are shuffled once, at the end.
Hashes have 64 bits and cover the words, so white space between words makes no difference.

A null or empty text stays empty. Rows equal in doc_id and text count as one row, so they do not remove each other's sentences; rows
that share only doc_id are apart. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .simhash import _SPACE

_END = np.zeros(256, bool)
_END[list(b".!?")] = True
#: 1 / CUT of the words of a long sentence are places to cut it.
CUT = 3
_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_removed", pa.int64()), ("first_docs", pa.list_(pa.int64())), ("text", pa.string())])


def runs_of(texts: list[bytes], run: int, words: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: each run's text number, its first and end byte in that text, and its hash."""
    raw, starts, ends, owner, _ = shared.words_of(texts, _SPACE, fold_case=False)
    n = len(starts)
    if not n:
        return (np.zeros(0, np.int64),) * 4
    hashes = shared.span_hashes(raw, starts, ends)
    lines = np.concatenate(([0], np.cumsum(raw == 10)))
    stop = _END[raw[ends - 1]] | (lines[np.append(starts[1:], len(raw))] > lines[ends])
    stop[-1] = True
    last = np.flatnonzero(stop)
    sizes = np.diff(np.concatenate(([-1], last)))
    stop |= np.repeat(sizes > long, sizes) & (hashes % np.uint64(CUT) == 0)
    last = np.flatnonzero(stop)
    first = np.concatenate(([0], last[:-1] + 1))
    text = owner[first]
    to = np.maximum(np.arange(len(first)) + run - 1, np.searchsorted(last, first + words - 1))
    inside = to < len(last)
    inside[inside] = text[to[inside]] == text[inside]
    whole = np.flatnonzero(np.diff(np.concatenate(([-1], text))) > 0)  # the first sentence of each text
    short = whole[~inside[whole]]
    ends_at = np.concatenate((whole[1:], [len(first)])) - 1
    to[short] = ends_at[~inside[whole]]
    inside[short] = True
    a, b = first[inside], last[to[inside]] + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * shared._powers(shared._ODD, n), out=sums[1:])
    span = shared.mix((sums[b] - sums[a]) * shared._powers(shared._INVERSE, n + 1)[a] + (b - a).astype(np.uint64))
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[text[inside]]
    return text[inside], starts[a] - begins, ends[b - 1] - begins, span.view(np.int64)


#: Bits of the bitmap of repeated runs (8 MB).
BITS = 1 << 26


def span_counts(docs: DataFrame, run: int, words: int, long: int) -> DataFrame:
    """(span, n) of runs that stand more than once, by hash alone."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in shared.slices(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(runs_of(texts, run, words, long)[3])], ["span"])

    return shared.one_pass(docs, {"text": "string"}).mapInArrow(hash_texts, "span long").groupBy("span").count().filter("count > 1")


def spans(docs: DataFrame, bitmap, run: int = 3, words: int = 16, long: int = 24) -> DataFrame:
    """(doc_id, text_hash, start, end, span): the bytes from start to end of a text are a run with hash span, one that the bitmap lists."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in shared.slices(batch.column(2).to_pylist()):
                text, start, end, span = runs_of(texts, run, words, long)
                may = shared.listed(bitmap.value, span)
                text, start, end, span = text[may], start[may], end[may], span[may]
                rows = pa.array(at + text)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(span)], schema=_SPANS)

    return _rows(docs).mapInArrow(hash_texts, "doc_id long, text_hash long, start int, end int, span long")


def _rows(docs: DataFrame) -> DataFrame:
    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string"})
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))


def _without(text: str, cut: list[dict]) -> tuple[str, int]:
    raw = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for span in sorted((x["start"], x["end"]) for x in cut):
        if span[1] <= at:
            continue
        out.append(raw[at : max(at, span[0])])
        at = span[1]
    out.append(raw[at:])
    left = b"".join(out).decode("utf-8", "surrogatepass")
    return left.strip(), len(text) - len(left)


def dedup_spans(docs: DataFrame, run: int = 3, words: int = 16, long: int = 24) -> DataFrame:
    """(doc_id, n_chars, n_removed, first_docs, text): characters of the text and how many of them went, where they first stand, and what is left."""
    place = F.struct("doc_id", "text_hash", "start")
    twice = shared.bitmap(span_counts(docs, run, words, long), "span", BITS)
    every = spans(docs, docs.sparkSession.sparkContext.broadcast(twice), run, words, long)
    firsts = every.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    firsts = shared.cut(firsts)  # a table of its own, so that the join can split what a frequent run has on the other side
    again = every.join(firsts, "span").filter(F.struct("doc_id", "text_hash", "start") != F.col("first"))
    cuts = again.groupBy(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash")).agg(F.collect_set(F.struct("start", "end")).alias("cut"), F.sort_array(F.collect_set("first.doc_id")).alias("first_docs"))
    joined = _rows(docs).join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left").select("doc_id", "text", "cut", "first_docs")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = [], []
            lengths = [len(t) for t in batch.column(1).to_pylist()]
            for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                left, n = _without(text, cut) if cut else (text, 0)
                texts.append(left)
                gone.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(gone, pa.int64()), batch.column(3).cast(_OUT.field(3).type), pa.array(texts, pa.string())], schema=_OUT)

    out = joined.mapInArrow(remove, "doc_id long, n_chars long, n_removed long, first_docs array<long>, text string")
    return out.withColumn("first_docs", F.coalesce("first_docs", F.array().cast("array<long>")))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: repeated runs of sentences of whole `documents` removed but for the first."""
    return dedup_spans(shared.table(spark, sf_dir, "documents"))
