"""Best-fit packing: bound-certified repacking.

A document's ids are cut into pieces of at most `room` ids; all but the first are full. Pieces are dealt out by a hash over
buckets of bounded size. Each bucket packs its own by best-fit decreasing, and a lower bound from dual-feasible functions
says how many sequences its pieces need at least. Full sequences are final. A bucket that meets its bound is certified:
its own pieces can't do with fewer, so it gives back only its emptiest sequence, to be merged with rests of others. A bucket
with a gap gives back all its sequences with room. What is given back is dealt out anew over fewer buckets and best-fit
decreasing runs again, until one bucket holds it or no round gains. A round counts only if it needs fewer
sequences than before for the same pieces, so no round can make the packing worse. The driver sees counts only.

Null or empty texts are the end id alone. Rows that share a doc_id are packed as rows of their own. A length of 1 packs
like any other. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared, tokens

#: So many ids at most in a sequence.
ROOM = 2048
#: Pieces in a bucket, about: what one task packs.
BUCKET_PIECES = 20_000
_PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"
_PACKED = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long, bucket long, bin long, offset long, filled long, bins long, bound long, rest boolean"


def cut_lengths(n: int, room: int) -> list[int]:
    """The lengths of the pieces of n ids: full ones, after a first one that may be shorter."""
    first = n % room or min(n, room)
    return [first, *[room] * ((n - first) // room)] if n else []


def lower_bound(lengths: np.ndarray, room: int) -> int:
    """So many bins at least, by dual-feasible functions: the identity, u(k), and the one that rounds large sizes up and drops small ones."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=room + 1).astype(np.int64)
    size = np.arange(room + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // room)
    for k in range(1, 21):  # u(k): x(k+1)/room if whole, floor of it over k else, all times 1/(k + 1) * ...
        whole = size * (k + 1) % room == 0
        value = np.where(whole, size * k, size * (k + 1) // room * room)  # in units of 1 / (k * room)
        best = max(best, -(-int((count * value).sum()) // (k * room)))
    large, volume = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for e in range(0, room // 2 + 1):  # sizes over room - e count as 1, those under e as 0
        over = int(large[room - e + 1]) if e else 0
        inside = int(volume[room - e] - (volume[e - 1] if e else 0))
        best = max(best, over - (-inside // room))
    return best


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and each bin's filled length."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    mask = 0  # the bit of each room that some bin has left
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            have = n + (fits & -fits).bit_length() - 1
            b = open_at[have].pop()
            if not open_at[have]:
                mask ^= 1 << have
        else:
            have, b = room, len(left)
            left.append(room)
        bins[i], offsets[i] = b, room - have
        left[b] = have = have - n
        if have:
            open_at[have].append(b)
            mask |= 1 << have
    return bins, offsets, room - np.array(left, np.int64)


def pieces_of(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = 0) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) of each piece of each document's ids and end id; copy tells rows apart that share a doc_id."""
    names = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("row", pa.int64())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        end, row = np.array([end_id], encode.kind).tobytes(), 0
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(encode.raw(text) + end, encode.kind).astype("<u4")
                start = 0
                for k, n in enumerate(cut_lengths(len(ids), room)):
                    out.append((name, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), row))
                    start += n
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), names, strict=True)], schema=names) if out else pa.RecordBatch.from_pylist([], names)

    got = shared.one_pass(docs, {"doc_id": "long", "text": "string"}).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")
    return got.withColumn("copy", F.spark_partition_id().cast("long") * F.lit(1 << 40) + F.col("row")).drop("row").select("doc_id", "copy", "piece", "start", "length", "ids_crc32")


def _packed(pieces: DataFrame, buckets: int, salt: int, room: int) -> DataFrame:
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, filled = best_fit(lengths, room)
        bound = lower_bound(lengths, room)
        # of a bucket at its bound only the emptiest sequence can still be merged away; of others any with room
        rest = bins == np.argmin(filled) if len(filled) == bound else np.ones(len(bins), bool)
        return rows.assign(bin=bins, offset=offsets, filled=filled[bins], bins=len(filled), bound=bound, rest=rest & (filled[bins] < room))

    key = F.pmod(F.xxhash64("doc_id", "copy", "piece", F.lit(salt)), F.lit(buckets))
    return pieces.withColumn("bucket", key).groupBy("bucket").applyInPandas(pack, _PACKED)


def pack_sequences(pieces: DataFrame, room: int = ROOM, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, copy, piece, start, length, ids_crc32), which are read more than once: pass them written."""
    keep = ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
    number = lambda k: F.lit(k << 56) + F.col("bucket") * F.lit(1 << 24) + F.col("bin")
    n = pieces.count()
    buckets = max(1, -(-n // bucket_pieces))
    packed = shared.cut(_packed(pieces, buckets, 0, room))
    final, k = [], 0
    while True:
        stands, open_ = packed.filter(~F.col("rest")), packed.filter("rest")
        final.append(stands.withColumn("sequence_id", number(k)).select(*keep, "sequence_id", "offset"))
        count, bins, volume = open_.agg(F.count("*"), F.count_distinct("bucket", "bin"), F.sum("length")).first()
        fewer = max(1, min(buckets - 1, -(-count // bucket_pieces)))
        if buckets == 1 or not count or bins <= -(-(volume or 0) // room):
            break
        again = shared.cut(_packed(open_.select(*keep), fewer, k + 1, room))
        now = again.agg(F.count_distinct("bucket", "bin")).first()[0]
        if now > bins or now == bins and fewer == 1:
            break
        packed, buckets, k = again, fewer, k + 1
    final.append(open_.withColumn("sequence_id", number(k)).select(*keep, "sequence_id", "offset"))
    out = final[0]
    for more in final[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, room: int = ROOM) -> DataFrame:
    return pack_sequences(shared.cut(pieces_of(docs, tokenizer, room)), room).drop("copy")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: whole `documents` into sequences of at most 2048 ids."""
    return pack_documents(shared.table(spark, sf_dir, "documents"), tokens.default_path())
