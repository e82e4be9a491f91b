"""SimHash near-dedup: anchor-point covering.

A text's fingerprint has 64 bits: of its word shingles' hashes, a bit is 1 if it is 1 in over half of them. Two fingerprints
are linked if they differ in at most `distance` bits. To find all links without comparing all pairs, the 64 bits are taken as
parts: at least one part differs in at most distance // parts bits. On each part a covering code serves as anchors: the perfect
Hamming code of length 2^r - 1, of covering radius 1, with what bits are left over taken as they are. Each fingerprint is
home to the one anchor within radius 1, and is replicated to every anchor within 1 + distance // parts; so
if a part of two fingerprints differs in at most that many bits, the one's home is among the other's anchors. Fingerprints are compared
per anchor, by an equality join that checks the count of differing bits. Replicas a fingerprint: 2 x 17 for distances up to 3.

Equal fingerprints are one before anything is replicated, so exact copies cost nothing however many there are. A fingerprint
links to at most 2,080 others at distance 2, so links grow in proportion to fingerprints; they are cut down to a
spanning forest in each task before they are shuffled. Components come from large-star and small-star steps.

A null or empty text has the fingerprint zero and is linked like any other. A text of fewer words than a shingle is one shingle. Rows
that share a doc_id are rows of their own. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

_SPACE = np.ones(256, bool)
_SPACE[[32, *range(9, 14)]] = False
_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64())])
_ANCHORS = pa.schema([("anchor", pa.int64()), ("fp", pa.int64())])


def fingerprint(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, shingle: int) -> int:
    """Of one text's words in raw, lowered bytes."""
    n = len(starts)
    if not n:
        return 0
    words = raw[starts[0] : ends[-1]].tobytes().split()
    if n <= shingle:
        joined = [b" ".join(words)]
    else:
        joined = list(map(b" ".join, zip(*(words[k:] for k in range(shingle)))))  # noqa: B905  the shortest ends it
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(x, 42) for x in joined), np.uint64, len(joined))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) of each row's whole text; fp is a signed long."""

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for _, run in shared.slices(batch.column(2).to_pylist()):
                raw, starts, ends, _, first = shared.words_of(run, _SPACE)
                out += [fingerprint(raw, starts[a:b], ends[a:b], shingle) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], schema=_PRINTS)

    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string"}).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(hash_texts, "doc_id long, text_hash long, fp long")


def _syndromes(x: np.ndarray, n: int) -> np.ndarray:
    """The exclusive or of the places, from 1, of the one-bits among the low n."""
    out = np.zeros(len(x), np.uint64)
    for i in range(n):
        out ^= ((x >> np.uint64(i)) & np.uint64(1)) * np.uint64(i + 1)
    return out


def anchors_of(fps: np.ndarray, parts: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(indices of fps, anchor keys, whether they are home) over all parts: codewords within 1 + radius (radius 0 or 1) of each part."""
    width = 64 // parts
    n = (1 << (width.bit_length() - 1)) - 1
    one = np.uint64(1)
    for part in range(parts):
        bits = width if part < parts - 1 else 64 - width * (parts - 1)
        x = (fps >> np.uint64(part * width)) & np.uint64((1 << bits) - 1)
        low, tag = x & np.uint64((1 << n) - 1), np.uint64(part << 56)
        s = _syndromes(low, n)
        off = s > 0
        home = np.where(off, x ^ (one << (np.where(off, s, one) - one)), x)
        every = np.arange(len(fps))
        yield every, home | tag, True
        yield every, home | tag, False
        if radius:
            for i in range(bits - n):  # the left-over bits may differ too
                yield every, home ^ (one << np.uint64(n + i)) | tag, False
            at, y, t = every[off], x[off], s[off]
            for i in range(1, n + 1):  # the codewords at distance 2: two places whose exclusive or is the syndrome
                j = np.uint64(i) ^ t
                pick = (j > np.uint64(i)) & (j <= np.uint64(n))
                yield at[pick], y[pick] ^ (one << np.uint64(i - 1)) ^ (one << (j[pick] - one)) | tag, False


def links(prints: DataFrame, distance: int = 2, parts: int = 2) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints (column fp, each once) that differ in at most distance bits."""
    if distance // parts > 1 or 64 // parts < 8:
        raise ValueError("an anchor of radius 1 covers up to one differing bit in a part: take more parts, of 8 bits at least")

    def spread(home: bool):
        def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                    for which, keys, is_home in anchors_of(fps.view(np.uint64), parts, distance // parts):
                        if is_home == home:
                            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps[which])], schema=_ANCHORS)

        return prints.select("fp").mapInArrow(anchors, "anchor long, fp long")

    # Spark takes a fingerprint's 34 replicas for about one row of its own and would broadcast them all; so this join is always dealt out
    homes = spread(True).withColumnRenamed("fp", "a").hint("merge")
    others = spread(False).withColumnRenamed("fp", "b")
    return homes.join(others, "anchor").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")


def keep_first(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, without those of a group other than its smallest doc_id; of rows alike in doc_id and text one stays.

    Rows are told by doc_id and the text's hash, so what shares only a doc_id with a duplicate stays."""
    return keep_first_known(docs, near_duplicates(docs, shingle, distance, parts, keep=("text_hash",)))


def keep_first_known(docs: DataFrame, known: DataFrame) -> DataFrame:
    """keep_first with the groups already known, as (doc_id, text_hash, component_id) of each row."""
    key = lambda rows: rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    gone = key(known.filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))).distinct()
    twice = key(known.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))).groupBy("_id", "_hash").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    once = docs.join(gone.unionByName(twice), same, "left_anti")
    first = docs.join(twice, same, "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return once.unionByName(first)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, parts: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id that links reach, itself included."""
    prints = shared.cut(fingerprints(docs, shingle))
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(each, distance, parts))
    linked = roots.join(each, roots["node"] == each["fp"]).select("node", "root", "least")
    least = shared.cut(linked.groupBy("root").agg(F.min("least").alias("least")))  # likewise, for a component of very many fingerprints
    joined = linked.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "least")
    # a component's least id for every fingerprint, linked or not; then for every row
    known = shared.cut(each.unionByName(joined).groupBy("fp").agg(F.min("least").alias("component_id")))  # so that the join can split copies
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *keep)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: 3-word shingles of whole `documents`, links at 2 or fewer differing bits."""
    return near_duplicates(shared.table(spark, sf_dir, "documents"))
