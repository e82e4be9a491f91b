"""The pipeline's stages on the smallest tables: each one's decisions, checked on its own input."""

import re
import zlib

import corpus_pipeline
from tessellar.llm import quality_fm, shared

DATA = "/root/testdata/sf0.001"


def planted(rows, items):
    """Ids of the rows that hold a window of 8 words, or a whole shorter item, by comparison of all words."""
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[a : a + 8]) for w in (find(x["text"]) for x in items) if w for a in range(max(1, len(w) - 7))}
    sizes = {len(w) for w in windows}
    return {r["doc_id"] for r in rows for w in [find(r["text"])] if any(tuple(w[a : a + n]) in windows for n in sizes for a in range(len(w) - n + 1))}


def test_decontamination_of_documents(spark):
    """On the documents of sf0.01 every row with a planted window leaves, and none else."""
    where = "/root/testdata/sf0.01"
    docs = shared.table(spark, where, "documents")
    rows = docs.collect()
    want = planted(rows, shared.table(spark, where, "benchmark").collect())
    kept = {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, where).select("doc_id").collect()}
    assert len(want) >= 20 and kept == {r["doc_id"] for r in rows} - want


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
        ids = lambda f: {r["doc_id"] for r in f.select("doc_id").collect()}
        gone = ids(before) - ids(docs)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in shared.table(spark, DATA, "labels").collect()}
            known = {i for i in ids(before) if i in labels and zlib.crc32(str(i).encode()) % 4 != 2}
            assert sum((i in gone) == (labels[i] == 0) for i in known) >= 0.8 * len(known)  # a few dozen rows to learn from
        elif name == "near_duplicates":
            texts = [r["text"] for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
        elif name == "decontamination":
            assert gone == planted(before.collect(), shared.table(spark, DATA, "benchmark").collect())
        else:
            assert not gone
    assert corpus_pipeline.ORACLE_SQL is None
    pieces = kept["packing"].collect()
    room = {}
    for r in pieces:
        room[r["sequence_id"]] = room.get(r["sequence_id"], 0) + r["length"]
    assert max(room.values()) <= 2048 and len(room) <= -(-sum(room.values()) // 2048) + 2


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    assert isinstance(quality_fm.train(spark.read.parquet(f"{DATA}/documents.parquet"), shared.table(spark, DATA, "labels").limit(0)), float)
