"""Benchmark decontamination: a prefix-filtered set join.

Each benchmark item gives its windows of `window` consecutive words, an item of fewer words one window of them all. A text
contains a window only if it has all of the window's words, so by the prefix filter at full containment one word, the window's
rarest over the whole corpus, is the necessary prefix. Texts give the occurrences of prefix words only; these are joined with the
windows on the prefix word, bounded by position (the window must start at or after the text's start) and by length (it must
end within the text), and verified word by word over the window's size.

Texts are read twice: once to count the benchmark's words in the corpus, which orders them by rarity, once for the occurrences.
Which words to look for reaches the tasks as a bitmap of fixed size (1 MB), however large the benchmark; what it lets
through in error falls out of the exact joins. Words are compared by 64-bit hashes of their lower-cased bytes. What is shuffled
is occurrences of prefix words and counts of benchmark words, never texts.

Null or empty texts and items have no words: a text gets zeros, an item no window. Windows that several items share count for each
of them. Rows are told apart by doc_id and text; a repeated item changes nothing, an item without an id is none. An empty benchmark hits nothing, an
empty documents table gives no rows, further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Bits of the bitmap of words that tasks look for.
BITS = 1 << 23
_WORD = np.ones(256, bool)
_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False


def _tokens(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes of a slice of texts, as signed longs, and each text's first word."""
    raw, starts, ends, _, first = shared.words_of(run, _WORD)
    return shared.span_hashes(raw, starts, ends).view(np.int64), first


def item_windows(items: DataFrame, window: int = 8) -> DataFrame:
    """(item_id string, words array<long>): every window of every item, once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for at, run in shared.slices(batch.column(1).to_pylist()):
                words, first = _tokens(run)
                out = [(names[at + k], words[i : min(i + window, b)].tolist()) for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)) if b > a for i in range(a, max(a, b - window) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["item_id", "words"])

    rows = shared.one_pass(items, {"item_id": "string", "text": "string"}).filter("item_id is not null").mapInArrow(cut, "item_id string, words array<long>")
    return rows.distinct()


def word_counts(docs: DataFrame, bitmap) -> DataFrame:
    """(word, n): how often each word in the bitmap stands in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, run in shared.slices(batch.column(0).to_pylist()):
                words, _ = _tokens(run)
                found.append(words[shared.listed(bitmap.value, words)])
            words, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    return shared.one_pass(docs, {"text": "string"}).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, bitmap, window: int = 8) -> DataFrame:
    """(doc_id, text_hash, n_words, found array of (word, place, around)): around has the window - 1 words before, the word and as many after; 0 beyond the ends."""
    kind = pa.struct([("word", pa.int64()), ("place", pa.int64()), ("around", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, hashes = batch.column(0), batch.column(1)
            for at, run in shared.slices(batch.column(2).to_pylist()):
                words, first = _tokens(run)
                hits = np.flatnonzero(shared.listed(bitmap.value, words))
                owner = np.searchsorted(first, hits, "right") - 1
                near = hits[:, None] + np.arange(1 - window, window)
                inside = (near >= first[owner][:, None]) & (near < first[owner + 1][:, None])
                around = np.where(inside, words[np.clip(near, 0, max(len(words) - 1, 0))] if len(words) else 0, 0)
                width = 2 * window - 1
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(hits) * width + 1, width, dtype=np.int32)), pa.array(around.ravel()))
                found = pa.StructArray.from_arrays([pa.array(words[hits]), pa.array(hits - first[owner]), lists], fields=list(kind))
                per_text = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(run) + 1)).astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([names.slice(at, len(run)), hashes.slice(at, len(run)), pa.array(np.diff(first).astype(np.int64)), per_text], ["doc_id", "text_hash", "n_words", "found"])

    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(find, "doc_id long, text_hash long, n_words long, found array<struct<word: long, place: long, around: array<long>>>")


def _covered(spans):
    """The number of places that sorted spans (start, end) cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["end"], x["start"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document; contaminated from min_items items on."""
    context = docs.sparkSession.sparkContext
    windows = shared.cut(item_windows(items, window))
    places = windows.select("item_id", "words", F.posexplode("words").alias("place", "word"))
    known = context.broadcast(shared.bitmap(places, "word", BITS))
    rarity = word_counts(docs, known)
    # the rarest word of each window is its prefix; a word that the corpus lacks is rarest of all
    ranked = places.join(rarity, "word", "left").groupBy("item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("prefix"))
    prefixes = shared.cut(ranked.select("item_id", "words", F.col("prefix.word").alias("word"), F.col("prefix.place").cast("long").alias("at"), F.size("words").alias("length")))
    found = shared.cut(occurrences(docs, context.broadcast(shared.bitmap(prefixes, "word", BITS)), window))
    row = ["doc_id", "text_hash"]
    each = found.select(*row, "n_words", F.explode("found").alias("x")).select(*row, "n_words", "x.word", "x.place", "x.around")
    start = F.col("place") - F.col("at")
    bounded = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    same = F.slice("around", F.lit(window) - F.col("at").cast("int"), F.col("length")) == F.col("words")
    hits = each.join(prefixes, "word").filter(bounded & same).select(*row, "item_id", start.alias("start"), (start + F.col("length")).alias("end"))
    per_doc = hits.groupBy(*row).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    per_doc = per_doc.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), _covered(F.col("spans")).alias("n_hit"), F.col("items"))
    out = found.select(*row, "n_words").join(per_doc, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_hash") == F.col("hit_hash")), "left")
    n_items = F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long")
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_items >= min_items).alias("contaminated"), *keep)


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, that hold windows of fewer than min_items items."""
    bad = decontaminate(docs, items, window, min_items, keep=("text_hash",)).filter("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__hash")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: 8-word windows of `benchmark` in whole `documents`."""
    return decontaminate(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
