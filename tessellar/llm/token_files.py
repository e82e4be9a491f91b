"""Token-ID / binary output: Elias-Fano encoded document boundaries over a concatenated id array.

A file holds, in ascending doc_id order, the ids of a run of documents, one after the other, in 16 or 32 bits each. Where
each document ends, and which doc_id it has, are two non-decreasing sequences in Elias-Fano form: of n numbers up to u the
low log2(u/n) bits lie packed side by side, the high bits in unary in a bit vector; together about 2 + log2(u/n) bits a
number. The place of every 256th one-bit is kept, so that `boundary(i)` finds one number by a short scan (select)
and no table of 64-bit offsets exists.

Documents are dealt out by ranges of doc_id and sorted within them; a task writes its files one by one and holds one of
them at a time. Each attempt of a task writes under names of its own, and only the names of the attempt that ended well reach the manifest, so a task that runs again
after a lost executor, or twice at once, needs no rename. A file's place among all ids is a sum over the parts before its own and the files before it in its
part. Reading takes starts and ends from select, a few thousand documents at a time. Numbers of files, ids and documents have no bound but the 64 bits of the counters.

Null or empty texts have only the end id. A null doc_id comes first, rows that share a doc_id lie side by side ordered
by text, an empty table gives no file and no row, further columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

MAGIC = b"EFTOKEN1"
#: A file is ended when it has so many bytes of ids.
FILE_BYTES = 16 << 20
#: Documents that reading takes at a time.
READ_DOCS = 4096
#: One in so many one-bits has its place kept.
SAMPLE = 256
_HEAD = struct.Struct("<8sIIQQQq")
_PART = struct.Struct("<QQIIII")
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"
_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, numbers: np.ndarray) -> EliasFano:
        x = np.asarray(numbers, np.uint64)
        n, most = len(x), int(x[-1]) if len(x) else 0
        low_bits = max(0, (most // max(n, 1)).bit_length() - 1)
        bits = (x[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (x >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def __getitem__(self, i: int) -> int:
        """Select: the i-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, taken = place // 8, place % 8
        while True:
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
            window[:taken] = 0
            ones = np.flatnonzero(window)
            if left < len(ones):
                place = byte * 8 + int(ones[left])
                break
            left, byte, taken = left - len(ones), byte + 64, 0
        first = i * self.low_bits
        part = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
        return (place - i) << self.low_bits | sum(int(b) << k for k, b in enumerate(part))

    def span(self, a: int, b: int) -> np.ndarray:
        """Select for a run: the numbers from a to b (exclusive), from the kept places around them."""
        if b <= a:
            return np.zeros(0, np.int64)
        first, after = a // SAMPLE, (b - 1) // SAMPLE + 1
        byte = int(self.samples[first]) // 8
        stop = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        skip = np.searchsorted(places, int(self.samples[first])) + a % SAMPLE
        out = (places[skip : skip + b - a] - np.arange(a, b)) << self.low_bits
        if self.low_bits:
            low = a * self.low_bits
            bits = np.unpackbits(self.low[low // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[low % 8 :][: (b - a) * self.low_bits]
            out |= (bits.reshape(-1, self.low_bits).astype(np.int64) << np.arange(self.low_bits, dtype=np.int64)).sum(axis=1)
        return out

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        out = ones << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def dump(self) -> bytes:
        return _PART.pack(self.n, len(self.high), len(self.low), self.low_bits, len(self.samples), SAMPLE) + self.samples.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def load(cls, raw: memoryview, at: int) -> tuple[EliasFano, int]:
        n, n_high, n_low, low_bits, n_samples, step = _PART.unpack_from(raw, at)
        if step != SAMPLE:
            raise ValueError(f"samples are {step} apart, not {SAMPLE}")
        at += _PART.size
        samples = np.frombuffer(raw, "<u4", n_samples, at)
        high = np.frombuffer(raw, np.uint8, n_high, at := at + 4 * n_samples)
        low = np.frombuffer(raw, np.uint8, n_low, at := at + n_high)
        return cls(n, low_bits, low, high, samples), at + n_low


def pack(doc_ids: list[int | None], pieces: list[bytes], width: int) -> bytes:
    """A file's bytes: documents in ascending doc_id order (nulls first), each one's ids as little-endian numbers of `width` bytes."""
    n_null = sum(x is None for x in doc_ids)
    known = doc_ids[n_null:]
    base = known[0] if known else 0
    ends = np.cumsum([0, *(len(p) // width for p in pieces)])
    names = EliasFano.of(np.array([x - base for x in known], np.uint64))
    return b"".join((_HEAD.pack(MAGIC, 1, width, len(doc_ids), int(ends[-1]), n_null, base), EliasFano.of(ends).dump(), names.dump(), *pieces))


class TokenFile:
    """A file that `pack` made, read back."""

    def __init__(self, raw: bytes):
        magic, version, self.width, self.n_docs, self.n_ids, self.n_null, self.base = _HEAD.unpack_from(raw)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        view = memoryview(raw)
        self.ends, at = EliasFano.load(view, _HEAD.size)
        self.names, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, f"<u{self.width}", self.n_ids, at)

    def boundary(self, i: int) -> int:
        return self.ends[i]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.names[i - self.n_null]

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i] : self.ends[i + 1]]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("/", "file:")) else (fs.LocalFileSystem(), path)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode (doc_id, text), append end_id to each document, write files under folder; a row for each file (MANIFEST), already written."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer)
        end = np.array([end_id], encode.kind).tobytes()
        store, root = _open(folder)
        store.create_dir(root, recursive=True)
        part, seq, names, pieces, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            path, raw = f"part-{part:06d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.ef", pack(names, pieces, encode.kind.itemsize)
            with store.open_output_stream(f"{root}/{path}") as out:
                out.write(raw)
            return pa.RecordBatch.from_arrays([[part], [seq], [f"{folder}/{path}"], [len(names)], [size // encode.kind.itemsize], [len(raw)]], schema=_MANIFEST)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = encode.raw(text) + end
                names.append(name)
                pieces.append(raw)
                size += len(raw)
                if size >= file_bytes:
                    yield flush()
                    seq, names, pieces, size = seq + 1, [], [], 0
        if names:
            yield flush()

    rows = shared.one_pass(docs, {"doc_id": "long", "text": "string"})
    return shared.cut(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """From the files alone: (doc_id, start, n_tokens, ids_crc32), a row for each document; the order of files is (part, seq)."""
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before("n", Window.orderBy("part")).alias("base"))  # a row a task that wrote
    placed = manifest.withColumn("inside", before("n_ids", Window.partitionBy("part").orderBy("seq"))).join(parts, "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = _open(path)
                with store.open_input_file(name) as source:
                    file = TokenFile(source.read())
                for at in range(0, file.n_docs, READ_DOCS):
                    to = min(at + READ_DOCS, file.n_docs)
                    ends = file.ends.span(at, to + 1)
                    crcs = [zlib.crc32(file.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    names = [None] * max(0, min(to, file.n_null) - at) + [file.base + int(x) for x in file.names.span(max(at - file.n_null, 0), max(to - file.n_null, 0))]
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())], schema=_OUT)

    placed = placed.select("path", (F.col("base") + F.col("inside")).cast("long").alias("start"))
    return placed.repartition(F.xxhash64("path")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: whole `documents` to files in the shared folder and back."""
    folder = f"{shared.scratch_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(shared.table(spark, sf_dir, "documents"), folder, tokens.default_path()))
