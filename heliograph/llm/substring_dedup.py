"""Substring deduplication with fixed-block anchors.

A word is removed if a window of WINDOW consecutive words that covers it also starts in a document with
a smaller id. WINDOW = 2 * BLOCK - 1, so every window holds exactly one whole block of its document's
non-overlapping blocks of BLOCK words.

1. Index and probe. The blocks of all documents (the index) and the rolling BLOCK-word windows of all
   documents (the probes) meet by hash. Documents are dealt to batches; a batch sends each hash
   partition one packed array with every hash once, marked if it is a block and if several documents
   of the batch have it, so the most frequent passage costs one number a batch. A partition answers
   with those hashes that are a block somewhere and occur in two documents or more.
2. Extend. Around each hit the windows that contain it are hashed whole, and the smallest document id
   of each window hash is found the same way: packed arrays, one entry a batch and hash, one answer.
3. Cover. Windows that start in a smaller document cover their words; overlapping windows make up the
   maximal exact repeats. The batch drops the covered words.

The three steps read one shuffle of the texts. Hashes of words and windows have 64 bits and a partition
number from other bits. Null text has no words. A null id counts as larger than any other; rows that
share an id do not remove each other's words. A text of any length is read whole, in segments between words. An empty
table gives no rows; other columns are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.wordhash import hash_texts, mix

BLOCK = 7
WINDOW = 2 * BLOCK - 1
#: Text in a batch, and text whose hashes meet in one partition (bytes, on average).
BATCH_BYTES = 4 << 20
PARTITION_BYTES = 20 << 20
LAST = np.iinfo(np.int64).max
PLACE = np.random.default_rng(77).integers(0, 1 << 63, BLOCK, np.uint64) * np.uint64(2) + np.uint64(1)


class Batch:
    """The words and windows of some documents, one after the other."""

    def __init__(self, ids, texts):
        self.ids = np.array([LAST if pd.isna(i) else int(i) for i in ids], np.int64)
        self.texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        words, self.counts = hash_texts(self.texts)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        n = len(words)
        self.doc = np.repeat(np.arange(len(self.ids)), self.counts)
        self.at = np.arange(n) - self.firsts[self.doc]
        left = self.counts[self.doc] - self.at  # words from here to the document's end
        rolling = np.zeros(max(0, n - BLOCK + 1), np.uint64)
        for j in range(BLOCK):
            rolling += words[j : j + len(rolling)] * PLACE[j]
        self.rolling = mix(rolling)
        self.rolls = left[: len(rolling)] >= BLOCK
        whole = max(0, n - WINDOW + 1)
        self.whole = mix(self.rolling[:whole] * np.uint64(3) + (self.rolling[BLOCK - 1 : BLOCK - 1 + whole] >> np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.fits = left[:whole] >= WINDOW


def _dealt(keys: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray]:
    """The partition of each key, from its high bits, and where each partition begins in the sorted keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
    return part, np.searchsorted(part, np.arange(partitions + 1))


def _frame(batch: int, chunks: Iterator[tuple[int, bytes]]) -> pd.DataFrame:
    rows = [(p, batch, c) for p, c in chunks]
    return pd.DataFrame({"p": [r[0] for r in rows], "batch": [r[1] for r in rows], "data": [r[2] for r in rows]}).astype({"p": "int32", "batch": "int32"})


def _tag(keys: np.ndarray) -> np.ndarray:
    """30 bits of a hash besides those that tell the partition."""
    return (keys & np.uint64(0x3FFFFFFF)).astype(np.uint32)


def probes(frame: pd.DataFrame, partitions: int) -> pd.DataFrame:
    b = Batch(frame["id"], frame["text"])
    at = np.flatnonzero(b.rolls)
    part = ((b.rolling[at] >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
    key = (part << 30) | _tag(b.rolling[at])
    block = b.at[at] % BLOCK == 0
    order = np.argsort(key, kind="stable")
    key, block, doc = key[order], block[order], b.doc[at][order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    if not len(starts):
        return _frame(0, iter(()))
    blocks = np.maximum.reduceat(block.astype(np.uint32), starts)
    several = (np.maximum.reduceat(doc, starts) != np.minimum.reduceat(doc, starts)).astype(np.uint32)
    key = key[starts]
    packed = ((key & 0x3FFFFFFF).astype(np.uint32) << np.uint32(2)) | blocks << np.uint32(1) | several
    bounds = np.searchsorted(key >> 30, np.arange(partitions + 1))
    return _frame(int(frame["batch"].iloc[0]), ((p, packed[s:e].tobytes()) for p, (s, e) in enumerate(zip(bounds, bounds[1:])) if e > s))


def anchors(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: to each batch, its hashes that are a block somewhere and occur in two documents."""
    parts = [np.frombuffer(d, np.uint32) for d in frame["data"]]
    every = np.concatenate(parts)
    tags, inverse, counts = np.unique(every >> np.uint32(2), return_inverse=True, return_counts=True)
    block, several = np.zeros(len(tags), bool), counts > 1
    block[inverse[(every & np.uint32(2)) > 0]] = True
    several[inverse[(every & np.uint32(1)) > 0]] = True
    hit = (block & several)[inverse]
    ends = np.cumsum([len(x) for x in parts])
    rows = [(b, (x >> np.uint32(2))[h].tobytes()) for b, x, h in zip(frame["batch"], parts, np.split(hit, ends[:-1])) if h.any()]
    out = pd.DataFrame({"batch": [r[0] for r in rows], "p": [int(frame["p"].iloc[0])] * len(rows), "data": [r[1] for r in rows]})
    return out.astype({"p": "int32", "batch": "int32"})


def windows(frame: pd.DataFrame, answers: pd.DataFrame, partitions: int) -> pd.DataFrame:
    """The whole windows around hits: each hash of the batch once, with its smallest document id."""
    if not len(frame) or not len(answers):
        return _frame(0, iter(()))
    b = Batch(frame["id"], frame["text"])
    hits = np.sort(np.concatenate([(np.int64(p) << 30) | np.frombuffer(d, np.uint32).astype(np.int64) for p, d in zip(answers["p"], answers["data"])]))
    part = ((b.rolling >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
    key = (part << 30) | _tag(b.rolling)
    hit = (hits[np.minimum(np.searchsorted(hits, key), len(hits) - 1)] == key) & b.rolls
    seen = np.concatenate([[0], np.cumsum(hit)])
    n = len(b.whole)
    at = np.flatnonzero(b.fits & (seen[BLOCK : BLOCK + n] > seen[:n]))
    if not len(at):
        return _frame(0, iter(()))
    order = np.lexsort((b.ids[b.doc[at]], b.whole[at]))
    h, ids = b.whole[at][order], b.ids[b.doc[at]][order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.concatenate([first[1:], [len(h)]]) - 1
    own = ids[last] != ids[first]  # several documents of this batch
    h, low = h[first], ids[first]
    _, bounds = _dealt(h, partitions)

    def chunks() -> Iterator[tuple[int, bytes]]:
        for p, (s, e) in enumerate(zip(bounds, bounds[1:])):
            if e > s:
                yield p, np.array([e - s], np.int64).tobytes() + h[s:e].tobytes() + low[s:e].tobytes() + own[s:e].tobytes()

    return _frame(int(frame["batch"].iloc[0]), chunks())


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.int64, n, 8 + 8 * n), np.frombuffer(data, bool, n, 8 + 16 * n)


def earliest(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one partition: to each batch, its windows that occur in several documents, with the smallest id of all."""
    parts = [_unpack(d) for d in frame["data"]]
    every = np.concatenate([p[0] for p in parts])
    hashes, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    low = np.full(len(hashes), LAST)
    np.minimum.at(low, inverse, np.concatenate([p[1] for p in parts]))
    shared = counts > 1
    shared[inverse[np.concatenate([p[2] for p in parts])]] = True
    rows, at = [], 0
    for b, (h, _, _) in zip(frame["batch"], parts):
        own = inverse[at : at + len(h)]
        at += len(h)
        own = own[shared[own]]
        if len(own):
            rows.append((b, hashes[own].tobytes() + low[own].tobytes()))
    out = pd.DataFrame({"batch": [r[0] for r in rows], "data": [r[1] for r in rows]})
    return out.astype({"batch": "int32"})


def covered(frame: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """n_words, n_removed and the hash of the kept words of each document of a batch."""
    b = Batch(frame["id"], frame["text"])
    drop = np.zeros(len(b.doc), bool)
    if len(answers) and len(b.whole):
        halves = [(np.frombuffer(d, np.uint64, len(d) // 16), np.frombuffer(d, np.int64, len(d) // 16, len(d) // 2)) for d in answers["data"]]
        h, low = np.concatenate([x[0] for x in halves]), np.concatenate([x[1] for x in halves])
        order = np.argsort(h)
        h, low = h[order], low[order]
        spot = np.minimum(np.searchsorted(h, b.whole), len(h) - 1)
        gone = np.flatnonzero(b.fits & (h[spot] == b.whole) & (low[spot] < b.ids[b.doc[: len(b.whole)]]))
        edge = np.zeros(len(b.doc) + 1, np.int64)
        edge[gone] += 1
        np.subtract.at(edge, gone + WINDOW, 1)
        drop = np.cumsum(edge)[:-1] > 0
    removed, kept = [], []
    for i, text in enumerate(b.texts):
        gone = drop[b.firsts[i] : b.firsts[i + 1]]
        n = int(np.count_nonzero(gone))
        words = [] if n == len(gone) else text.split()
        if n and words:
            words = [w for w, g in zip(words, gone.tolist()) if not g]
        removed.append(n)
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pd.DataFrame({"id": frame["id"].astype("Int64").to_numpy(), "n_words": b.counts, "n_removed": removed, "kept_sha256": kept}).astype({"id": "Int64"})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256) for every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches, partitions = 1 + size // BATCH_BYTES, 1 + size // PARTITION_BYTES
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)).cast("int"))
    packed = "p int, batch int, data binary"
    by_batch = dealt.groupBy("batch")
    sent = by_batch.applyInPandas(lambda f: probes(f, partitions), packed)
    hits = sent.groupBy("p").applyInPandas(anchors, "batch int, p int, data binary")
    around = by_batch.cogroup(hits.groupBy("batch")).applyInPandas(lambda f, a: windows(f, a, partitions), packed)
    found = around.groupBy("p").applyInPandas(earliest, "batch int, data binary")
    done = by_batch.cogroup(found.groupBy("batch")).applyInPandas(covered, "id long, n_words long, n_removed long, kept_sha256 string")
    return done.withColumnRenamed("id", id_col)
