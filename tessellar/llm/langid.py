"""Language ID: averaged hashed subword embeddings with a linear softmax, with calibrated rejection.

A text is its letters in lower case, as UTF-8 bytes, with one blank for all else; its subwords are all runs of 2, 3 and 4 of these bytes, so
a word's ends count as well. Each is hashed to one of `buckets` embeddings; their average over the whole text goes through a
linear layer and a softmax. Stochastic gradient descent in numpy fits both on a sample of at most `per_lang` labelled rows a
language (twice that at the very most). A fifth of the sample is kept back: on it a temperature is fitted to the
scores, and the score is found under which predictions are too often wrong (`precision`); such rows are marked rejected.

Averaging commutes with the linear layer, so scoring needs one small table of logits a subword and takes memory for a slice of texts.

Text that is null or has no letter is `und` with score 0. If no row is labelled, all texts are. Neither lang, source nor doc_id is
an input of a prediction. Repeated rows each give theirs, an empty table none; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .samples import labelled_sample, stretch

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)
GRAMS = (2, 3, 4)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits by subword: the embeddings times the linear layer
    bias: np.ndarray
    temperature: float
    reject: float


def subwords(run: list[bytes], buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of GRAMS the buckets at each byte of a slice (texts in lower case, apart by blanks), and where texts begin."""
    raw = _KEEP[np.frombuffer(b"  ".join(run) + b"     ", np.uint8)].astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(t) + 2 for t in run])))
    n = len(raw) - 4
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    packed, out = raw[:n] << np.uint32(8) | raw[1 : n + 1], []
    for k in GRAMS:
        if k > 2:
            packed = packed << np.uint32(8) | raw[k - 1 : n + k - 1]
        out.append((packed * np.uint32(0x9E3779B1) ^ np.uint32(k * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> shift)
    return out, starts


def _bag(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    grams, starts = subwords([text.lower().encode("utf-8", "surrogatepass")], buckets)
    which, n = np.unique(np.concatenate([g[: starts[1]] for g in grams]), return_counts=True)
    return which, (n / n.sum()).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def fit(texts: list[str], labels: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 4, rate: float = 0.3, precision: float = 0.99, seed: int = 7) -> Model:
    langs = sorted(set(labels))
    random = np.random.default_rng(seed)
    emb, lin, bias = random.normal(0, 0.5, (buckets, dim)).astype(np.float32) / dim, np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    lin += random.normal(0, 0.1, lin.shape).astype(np.float32)
    rows = [(*_bag(t, buckets), langs.index(y)) for t, y in zip(texts, labels, strict=True) if _LETTER.search(t)]
    order = random.permutation(len(rows))
    back, train = order[: len(rows) // 5], order[len(rows) // 5 :]
    steps, done = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in random.permutation(train):
            which, weight, y = rows[i]
            mean = weight @ emb[which]
            delta = _softmax(mean @ lin + bias)
            delta[y] -= 1
            lr = np.float32(rate * (1 - done / steps))
            into = lin @ delta
            lin -= lr * np.outer(mean, delta)
            bias -= np.float32(0.05) * lr * delta
            emb[which] -= lr * (weight / (weight @ weight))[:, None] * into  # moves the average by lr * into
            done += 1
    table = emb @ lin
    temperature, reject = 1.0, 0.0
    if len(back) and len(langs) > 1:
        logits = np.array([rows[i][1] @ table[rows[i][0]] + bias for i in back])
        truth = np.array([rows[i][2] for i in back])
        loss = {t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-9).mean() for t in np.geomspace(0.1, 10, 41)}
        temperature = min(loss, key=loss.get)
        scores = _softmax(logits / temperature)
        order = np.argsort(scores.max(axis=1))
        right = (scores.argmax(axis=1) == truth)[order]
        ok = np.cumsum(right[::-1])[::-1] / np.arange(len(right), 0, -1) >= precision
        reject = float(scores.max(axis=1)[order][np.argmax(ok)]) if ok.any() else 1.0
    return Model(langs, table.astype(np.float32), bias, float(temperature), reject)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    names, scores = [], np.zeros(len(texts))
    buckets = len(model.table)
    lowered = [t.lower() if t and _LETTER.search(t) else None for t in texts]
    for at, run in shared.slices(lowered):
        grams, starts = subwords(run, buckets)
        sums = np.zeros((len(run), len(model.langs)))
        for g in grams:
            for k in range(len(model.langs)):
                sums[:, k] += np.add.reduceat(model.table[:, k][g[: starts[-1]]], starts[:-1], dtype=np.float64)
        logits = sums / (len(GRAMS) * np.diff(starts))[:, None] + model.bias
        prob = _softmax(logits / model.temperature)
        best = prob.argmax(axis=1)
        for i, text in enumerate(lowered[at : at + len(run)]):
            names.append(model.langs[best[i]] if text is not None else "und")
            scores[at + i] = prob[i, best[i]] if text is not None else 0.0
    return names, scores


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, per_lang: int = 1000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row, by a model learned from rows that are not held out."""
    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    usable = rows.filter((shared.fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = labelled_sample(usable, "lang", per_lang).select(stretch(F.col("text")).alias("text"), "lang").collect()
    model = fit([r["text"] for r in got], [r["lang"] for r in got]) if got else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers of 4 bytes

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = predict(shipped.value, texts) if shipped.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores), pa.array(scores < (shipped.value.reject if shipped.value else 1.0))], schema=_OUT)

    held = F.coalesce(shared.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return rows.select("doc_id", held, "text").mapInArrow(guess, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the language of every whole text of `documents`."""
    return identify(shared.table(spark, sf_dir, "documents"))
