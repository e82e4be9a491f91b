"""Connected components of a graph of links, by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: A forest is built over so many links at a time, so that a task's memory doesn't grow with its links.
FOREST_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of links only those that a spanning forest needs: (node, root)."""

    def spanning(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        nodes, places = np.unique(np.concatenate((a, b)), return_inverse=True)
        left, right = places[: len(a)], places[len(a) :]
        root = np.arange(len(nodes))
        while True:  # each node takes the least root beside it, then roots are followed to their ends
            low = np.minimum(root[left], root[right])
            before = root.copy()
            np.minimum.at(root, root[left], low)
            np.minimum.at(root, root[right], low)
            np.minimum.at(root, left, low)
            np.minimum.at(root, right, low)
            while (root[root] != root).any():
                root = root[root]
            if (before == root).all():
                break
        other = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[other]]), pa.array(nodes[other])], schema=_LINKS)

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= FOREST_LINKS:
            yield spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [], 0
    if size:
        yield spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _cut(frame: DataFrame) -> DataFrame:
    return shared.without_estimate(shared.cut(frame))


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs to (node, root): each linked node with the smallest node of its component.

    Every step deals out by node with a minimum that is combined before the shuffle and written as a table of its own; so the join that brings it back has a shuffle
    of its own too, in which the skew join can split a node with very many links. What is brought to the driver is a checksum;
    Spark's estimates of size are left behind at each step."""
    edges = _cut(links.filter("a <> b").mapInArrow(_forest, "a long, b long"))
    before = None
    while True:
        # large star: of each node, link its larger neighbours to the least of its neighbours and itself
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        edges = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: of each node, link its smaller neighbours and itself to the least of them
        down = _cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        least = _cut(down.groupBy("a").agg(F.min("b").alias("m")))
        edges = down.join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()
        edges = _cut(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    root = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return root.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
