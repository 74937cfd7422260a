"""Byte-level BPE of whole texts, and back.

A text is cut into pre-tokens by a pattern. Two tiers give a pre-token's ids:

1. A minimal perfect hash over the vocabulary: as many slots as tokens, each token in a slot of its own. The token
   in the slot is compared byte by byte, so a pre-token is either found whole or known to be missing.
2. A missing pre-token starts as a chain of linked bytes. A heap holds the neighbours whose joint bytes are a token,
   by rank and then from the left; the least is joined until none is left. That is n log n for any length.

What moves is the vocabulary (some MB, broadcast); texts are encoded where they lie. A worker remembers the ids of
missing pre-tokens up to a number of bytes, and starts afresh beyond it.

Null text is empty text, which has no ids. Very long texts are cut between pre-tokens into segments, at the same places
that one pass over the whole text would cut. Repeated rows and ids, and null ids, give a row each; an empty table gives
no rows. Columns of other names are left out, so none can clash.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches
from heliograph.llm.wordhash import mix

#: Keys in one bucket of the perfect hash, on average.
BUCKET_KEYS = 4
#: Displacements tried at once.
TRIES = 256
#: Characters that the pattern looks at in one go.
SEGMENT = 1 << 20
#: Bytes of remembered pre-tokens and their ids in a worker, for each of two generations, and what an entry takes besides.
REMEMBERED_BYTES = 32 << 20
OVERHEAD = 150


class PerfectHash:
    """Slots 0 to n - 1 for n byte strings, one each; any other string gets some slot too."""

    def __init__(self, keys: list[bytes]):
        self.size = max(1, len(keys))
        self.buckets = max(1, -(-len(keys) // BUCKET_KEYS))
        self.seed = 0
        while len(np.unique(self._hashes(keys))) < len(keys):
            if self.seed == 16:
                raise ValueError("the vocabulary holds a token twice")
            self.seed += 1
        self.shift = np.zeros(self.buckets, np.int64)
        self._place(self._hashes(keys))

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        seed = self.seed
        return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(hashes + shift.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)).astype(np.int64)

    def _place(self, hashes: np.ndarray) -> None:
        """Crowded buckets first: each takes the first displacement that sends its keys to free slots. Single keys take what is left."""
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        counts = np.diff(starts)
        taken = np.zeros(self.size, bool)
        for b in np.argsort(-counts, kind="stable").tolist():
            if counts[b] < 2:
                break
            mine = hashes[order[starts[b] : starts[b + 1]]]
            first = 0
            while True:
                tried = np.arange(first, first + TRIES)
                slots = self._slot(mine[None, :], tried[:, None])
                free = ~taken[slots].any(1)
                for row in np.flatnonzero(free):
                    if len(np.unique(slots[row])) == len(mine):
                        break
                else:
                    first += TRIES
                    continue
                taken[slots[row]] = True
                self.shift[b] = tried[row]
                break
        self.shift[counts == 1] = -1 - np.flatnonzero(~taken)[: (counts == 1).sum()]

    def slots(self, keys: list[bytes]) -> np.ndarray:
        hashes = self._hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slot(hashes, np.maximum(shift, 0)))


class Vocabulary:
    """Tokens with their ids, which are also their ranks, and the pattern that cuts texts (it has to match every character)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte-level vocabulary holds every single byte")
        if len(set(ranks.values())) < len(ranks):
            raise ValueError("the vocabulary holds an id twice")
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        self.hash = PerfectHash(tokens)
        self.at: list[bytes] = [b""] * len(tokens)
        for token, slot in zip(tokens, self.hash.slots(tokens).tolist()):
            self.at[slot] = token
        self.ids = np.array([ranks[t] for t in self.at], np.uint32)
        self.bytes = {i: t for t, i in ranks.items()}

    def whole(self, keys: list[bytes]) -> list[int]:
        """Each key's id, or -1 where it isn't a token."""
        slots = self.hash.slots(keys).tolist()
        at, ids = self.at, self.ids
        return [int(ids[s]) if at[s] == k else -1 for k, s in zip(keys, slots)]

    def join(self, piece: bytes) -> list[int]:
        """The ids of a piece that isn't a token, by joining neighbours of least rank."""
        find, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = [find(piece[i : i + 2], -1) for i in range(n - 1)] + [-1]  # of the pair that starts at i
        heap = [r * n + i for i, r in enumerate(rank) if r >= 0]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            if rank[i] != r:
                continue  # one of the two has been joined since
            j = after[i]
            k = after[i] = after[j]
            rank[j] = -1
            if k < n:
                before[k] = i
                rank[i] = r = find(piece[i : after[k]], -1)
                if r >= 0:
                    heappush(heap, r * n + i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = r = find(piece[h:k], -1)
                if r >= 0:
                    heappush(heap, r * n + h)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}, pattern)


class Encoder:
    """Encodes texts in one worker. Remembered words have two generations: those asked for again outlive the older one."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        if self.held > REMEMBERED_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        new = words.difference(self.known)
        again = [w for w in new if w in self.older]
        new = list(new.difference(again))
        keys = [w.encode("utf-8", "replace") for w in new]
        join = self.vocabulary.join
        made = [array("I", (whole,) if whole >= 0 else join(key)).tobytes() for key, whole in zip(keys, self.vocabulary.whole(keys))]
        self.known.update(zip(new, made))
        self.known.update((w, self.older[w]) for w in again)
        self.held += sum(map(len, keys)) + sum(map(len, made)) + OVERHEAD * (len(new) + len(again))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        out: list[bytes] = []
        at, size = 0, SEGMENT
        while at < len(text):
            end = min(at + size, len(text))
            words = self.find(text, at, end)
            if sum(map(len, words)) < end - at:
                raise ValueError("the pattern has to match every character")
            if end < len(text):
                # the last match might go on behind the segment; those before it end as they would in the whole text
                if len(words) < 2:
                    size *= 2
                    continue
                del words[-1]
            size = SEGMENT
            at += sum(map(len, words))
            self.learn(set(words))
            out.append(b"".join(map(self.known.__getitem__, words)))
        return b"".join(out)


def shared_vocabulary(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    return spark.sparkContext.broadcast(read_vocabulary(path, pattern))


def encode(docs: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for every row: ids as binary data, 4 bytes each, little-endian."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = Encoder(vocabulary.value)
        for batch in batches:
            ids = [worker.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary")


def round_trip(docs: DataFrame, vocabulary: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode and decode in one pass of one worker: (id, ids, decoded)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        worker = Encoder(words)
        for batch in batches:
            ids = [worker.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(words.decode, ids), pa.binary())], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary, decoded binary")


def decode(encoded: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """encoded(id, ids) with the bytes that the ids stand for; ids that are no token's fail, null ids are null."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            texts = [words.decode(d) if d is not None else None for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids binary, decoded binary")
