"""Quality classifier: a factorisation machine.

A text's features are its hashed words, each weighted by its share of the words; structure statistics of the whole text, and the
largest share that any stretch of 64 words reaches of repeated, shouted, symbol-laden or otherwise odd words, so that
junk in the middle of a long text shows; and lengths as metadata. The machine adds a weight for each feature and an inner product of
low-rank vectors for each pair of features. By the sum-of-squares identity all pairs together are
half of (the square of the vectors' sum minus the sum of their squares), so a score takes time linear in the features.

Stochastic gradient steps in numpy fit it to a sample of at most `per_label` labelled rows of each label (twice that at the very
most); a fifth is kept back, on which the scores are calibrated by a slope and an offset. Scoring reads whole texts, in slices.

A null or empty text has no words, its statistics are zero, and it gets the score of that. With one label only, or none, every score is
that label's value or 0.5. Rows of documents that share a doc_id each count; neither labels, lang, source nor doc_id is
an input of a score. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .samples import labelled_sample, stretch
from .simhash import _SPACE

#: Words in a stretch.
STRETCH = 64
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>{}[]^~=_\\@")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LAST = {"shout": b"!", "end": b".?", "comma": b",;:"}
FLAGS = ("repeat", "upper", "symbol", "digit", "shout", "end", "comma", "long", "short", "seen", "known")


def features(run: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: statistics by text, each word's bucket, each text's first word, and its number of words."""
    raw, starts, ends, owner, first = shared.words_of(run, _SPACE, fold_case=False)
    texts, n = len(run), len(starts)
    count = np.diff(first)
    chars = np.array([len(t) for t in run])
    stats, at = np.zeros((texts, 2 * len(FLAGS) + 5)), 2 * len(FLAGS)
    lines = np.array([t.count(b"\n") for t in run])
    stats[:, at : at + 5] = np.stack([np.log1p(count), np.log1p(chars), chars / (count + 4), lines / (count + 4), count == 0], axis=1)
    if not n:
        return stats, np.zeros(0, np.int64), first, count
    lower = shared.LOWER[raw]
    words = shared.span_hashes(lower, starts, ends)
    inside = lambda table: (sums := np.concatenate(([0], np.cumsum(table[raw]))))[ends] - sums[starts]
    size = ends - starts
    same = np.zeros(n, bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    grams = words.copy()  # runs of three words that the text has had before
    grams[2:] = shared.mix(words[2:] + shared.mix(words[1:-1] + shared.mix(words[:-2]))) + owner[2:].astype(np.uint64)
    order = np.argsort(grams, kind="stable")
    seen = np.zeros(n, bool)
    seen[order[1:]] = (grams[order[1:]] == grams[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    order = np.argsort(words + shared.mix(owner.astype(np.uint64)), kind="stable")  # words that the text has had before
    known = np.zeros(n, bool)
    known[order[1:]] = (words[order[1:]] == words[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    flags = {"repeat": same, "upper": inside(_UPPER) > 1, "symbol": inside(_SYMBOL) > 0, "digit": inside(_DIGIT) > 0, "long": size > 24, "short": size < 3, "seen": seen, "known": known}
    tail = raw[ends - 1]
    flags |= {k: np.isin(tail, np.frombuffer(v, np.uint8)) for k, v in _LAST.items()}
    place = np.arange(n) - first[owner]
    part = np.flatnonzero(place % STRETCH == 0)
    part_size = np.diff(np.append(part, n))
    has = count > 0
    for k, name in enumerate(FLAGS):
        sums = np.add.reduceat(flags[name].astype(np.int64), part)
        np.add.at(stats[:, k], owner[part], sums)
        np.maximum.at(stats[:, len(FLAGS) + k], owner[part], sums / (part_size + 8))
    stats[has, : len(FLAGS)] /= (count[has] + 4)[:, None]
    return stats, (words % np.uint64(buckets)).astype(np.int64), first, count


@dataclass
class Machine:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    dense: np.ndarray  # linear weights of statistics
    dense_v: np.ndarray  # their vectors
    word: np.ndarray
    word_v: np.ndarray
    slope: float = 1.0
    offset: float = 0.0


#: How much hashed words weigh beside statistics of unit variance.
WORD_WEIGHT = 4.0


def raw_scores(m: Machine, run: list[bytes]) -> np.ndarray:
    """Log odds before calibration, of a slice of texts, in time linear in their words."""
    stats, words, first, count = features(run, len(m.word))
    x = np.clip((stats - m.mean) / m.scale, -4, 4)
    share = (WORD_WEIGHT / np.maximum(count, 1)).astype(np.float64)
    sums = lambda values: np.diff(np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)))[first], axis=0) * share[:, None]
    # a word counts once for each time it stands; repeats of a word count as features of their own in the squares
    linear = m.bias + x @ m.dense + sums(m.word[words][:, None])[:, 0]
    v = m.word_v[words]
    total = x @ m.dense_v + sums(v)
    squares = (x * x) @ (m.dense_v**2) + sums(v * v) * share[:, None]
    return linear + 0.5 * (total**2 - squares).sum(axis=1)


def fit(texts: list[str], labels: list[int], buckets: int = 1 << 15, rank: int = 6, epochs: int = 8, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Machine:
    random = np.random.default_rng(seed)
    rows = [features([t.encode("utf-8", "surrogatepass")], buckets) for t in texts]
    stats, y = np.concatenate([r[0] for r in rows]), np.array(labels, float)
    d = stats.shape[1]
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-3
    x = np.clip((stats - mean) / scale, -4, 4)
    m = Machine(mean, scale, 0.0, np.zeros(d), random.normal(0, 0.05, (d, rank)), np.zeros(buckets), random.normal(0, 0.01, (buckets, rank)))
    order = random.permutation(len(rows))
    back, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    g_dense, g_v, g_word, g_wv = np.full(d, 1e-2), np.full((d, rank), 1e-2), np.full(buckets, 1e-2), np.full((buckets, rank), 1e-2)
    for _ in range(epochs):
        for i in random.permutation(train):
            w, xi = rows[i][1], x[i]
            share = WORD_WEIGHT / max(len(w), 1)
            v = m.word_v[w]
            total = xi @ m.dense_v + share * v.sum(axis=0)
            z = m.bias + xi @ m.dense + share * m.word[w].sum() + 0.5 * (total**2 - (xi**2) @ m.dense_v**2 - share**2 * (v**2).sum(axis=0)).sum()
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]
            m.bias -= rate * 0.2 * err
            grad = err * xi + decay * m.dense
            g_dense += grad**2
            m.dense -= rate * grad / np.sqrt(g_dense)
            grad = err * (xi[:, None] * total - m.dense_v * (xi**2)[:, None]) + decay * m.dense_v
            g_v += grad**2
            m.dense_v -= rate * grad / np.sqrt(g_v)
            u, n = np.unique(w, return_counts=True)
            grad = err * share * n + decay * m.word[u]
            g_word[u] += grad**2
            m.word[u] -= rate * grad / np.sqrt(g_word[u])
            vu = m.word_v[u]
            grad = err * share * n[:, None] * (total - share * vu) + decay * vu
            g_wv[u] += grad**2
            m.word_v[u] = vu - rate * grad / np.sqrt(g_wv[u])
    if len(back):
        z, t = np.concatenate([raw_scores(m, [texts[i].encode("utf-8", "surrogatepass")]) for i in back]), y[back]
        a, b = 1.0, 0.0
        for _ in range(300):  # Platt's slope and offset, by gradient steps, held near 1 and 0
            err = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - t
            a -= 0.02 * (float((err * z).mean()) + 0.01 * (a - 1))
            b -= 0.1 * float(err.mean())
        m.slope, m.offset = max(a, 0.05), b
    return m


def scores(m: Machine, texts: list[str | None]) -> np.ndarray:
    out = [raw_scores(m, run) for _, run in shared.slices(texts)]
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(m.slope * z + m.offset, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_label: int = 1500) -> Machine | float:
    """A machine for labels.quality, learned from rows that are not held out; a number where labels do not differ."""
    known = shared.one_pass(labels, {"doc_id": "long", "quality": "int"}).filter((shared.fold(F.col("doc_id")) != 2) & F.col("quality").isin(0, 1))
    chosen = labelled_sample(known, "quality", per_label)  # at most 4 x per_label rows of two numbers
    texts = shared.one_pass(docs, {"doc_id": "long", "text": "string"})
    got = texts.join(F.broadcast(chosen), "doc_id").select(stretch(F.col("text")).alias("text"), "quality").limit(4 * per_label).collect()
    values = {r["quality"] for r in got}
    if len(values) < 2:
        return float(values.pop()) if values else 0.5
    return fit([r["text"] or "" for r in got], [r["quality"] for r in got])


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score_documents(docs: DataFrame, labels: DataFrame, per_label: int = 1500, accept: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))  # a size that the buckets fix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = np.full(len(texts), shipped.value) if isinstance(shipped.value, float) else scores(shipped.value, texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], schema=_OUT)

    held = F.coalesce(shared.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string"}).select("doc_id", held, "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= accept).cast("int"))


def keep_accepted(docs: DataFrame, labels: DataFrame, per_label: int = 1500, accept: float = 0.7) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least accept; texts do not leave their row."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_label))

    def filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            got = np.full(len(texts), shipped.value) if isinstance(shipped.value, float) else scores(shipped.value, texts)
            yield batch.filter(pa.array(got >= accept))

    return docs.mapInArrow(filter_rows, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the quality of every whole text of `documents`."""
    return score_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
