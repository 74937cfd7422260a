"""Phrases of two to five words that occur together more often than their parts suggest, for each language.

1. Texts become chunks of some MB for each language: the chunk's own words with their counts, and codes of all words.
   Word counts add up over chunks. Words of ``least`` occurrences or more in a language get dense ids; as a phrase is
   never more frequent than its words, pieces break at all others.
2. A chunk gets the ids of its own words by a join (no dictionary is broadcast, as it grows with the corpus). Every
   place where two frequent words follow each other gives one key: the ids of up to five words, as many bytes each as
   the largest id takes, big-endian, zeros behind the piece's end. Keys are radix-sorted in the chunk and equal ones
   counted, so a frequent key leaves a chunk once.
3. A sample of keys bounds ranges of some MB. A chunk sends each range its keys as one row, laid out byte by byte, which
   compresses well. The task of a range radix-sorts them; as prefixes of a key sort beside it, one pass over the runs
   counts all phrases of two to five words. A run may go on in the next range, so the first and last are added up.
4. Cuts, scores and the test for longer phrases are equi joins on slices of the keys; scores are decimals of 38 digits.

Null text is empty; null lang is ``und``. A text of any length is cut between words, never inside pieces; a single chunk
may hold one long text. Repeated rows and ids count as often as they are there. Without candidates, and for an empty table,
the result is empty. Only the columns ``lang`` and ``text`` are read, so no other can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches
from heliograph.operators.relational import numbered
from heliograph.shared import cut, remove

LONGEST = 5
#: Bytes of text in a chunk, in all chunks that a task fills, and in what is split at once.
CHUNK = 4 << 20
HELD = 12 << 20
SEGMENT = 1 << 20
#: Hash buckets that a language's candidates are ranked in before the best of all.
RANK_BUCKETS = 256
#: Bytes of keys in a range, and how many ranges there are at most (their bounds are broadcast, 40 bytes each at most).
RANGE_BYTES = 4 << 20
MOST_RANGES = 1 << 20
#: Rows of a chunk's words in one batch.
WORD_ROWS = 1 << 14
#: Ranges that a chunk sends at once, and chunks or their ranges that a task is sent at once.
BATCH_RANGES = 32
CHUNK_ROWS = 8
#: Chunks that the bounds come from, about, and keys of each.
SAMPLED_CHUNKS, SAMPLED_KEYS = 64, 4096

#: Ends of pieces become a byte that no UTF-8 text has, tabs become spaces, letters small.
_BREAK = b"\xff"
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t" + bytes(range(65, 91)), _BREAK * 10 + b" " + bytes(range(97, 123)))


class Chunk:
    """One language's words of some texts: every word once, and the places as codes; 0 ends a piece."""

    def __init__(self) -> None:
        self.index: dict[bytes, int] = {_BREAK: 0}
        self.codes: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        data = text.encode("utf-8", "replace").translate(_TABLE)
        at = 0
        while at < len(data):
            end = data.find(b" ", at + SEGMENT)
            end = len(data) if end < 0 else end
            words = data[at:end].replace(_BREAK, b" \xff ").split()
            for w in set(words).difference(self.index):
                self.index[w] = len(self.index)
            self.codes.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
            at = end
        self.codes.append(np.zeros(1, np.int32))
        self.size += len(data)

    def rows(self, name: str, lang: str) -> Iterator[pa.RecordBatch]:
        """The chunk's words with their places in it (from 1) and counts, then its codes."""
        codes = np.concatenate(self.codes)
        words, counts = list(self.index)[1:], np.bincount(codes, minlength=len(self.index))[1:]
        for at in range(0, len(words), WORD_ROWS):
            some = words[at : at + WORD_ROWS]
            yield self._batch(name, lang, len(some), [pa.array(np.arange(at + 1, at + 1 + len(some), dtype=np.int32)), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[at : at + WORD_ROWS]), pa.nulls(len(some), pa.binary())])
        yield self._batch(name, lang, 1, [pa.array([len(words)], pa.int32()), pa.nulls(1, pa.string()), pa.array([len(codes)], pa.int64()), pa.array([codes.tobytes()], pa.binary())])

    @staticmethod
    def _batch(name: str, lang: str, rows: int, columns: list[pa.Array]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(name, rows), pa.repeat(lang, rows), *columns], names=["chunk", "lang", "pos", "word", "count", "codes"])


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The texts as chunks: (chunk, lang, pos, word, count, codes), a row for each word of a chunk and one for its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[str, Chunk] = {}

        def flush(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang in langs:
                yield from held.pop(lang).rows(f"{part}-{made}", lang)
                made += 1

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, Chunk()).add(text.as_py())
                if held[lang].size >= CHUNK:
                    yield from flush([lang])
                elif sum(c.size for c in held.values()) >= HELD:
                    yield from flush(list(held))
        yield from flush(list(held))

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "chunk string, lang string, pos int, word string, count long, codes binary")


def radix_sorted(places: np.ndarray, width: int) -> np.ndarray:
    """The order of rows of ids below 256 ** width: stable counting sorts of 16 bits, the last word's lowest first."""
    order = np.arange(len(places))
    for word in reversed(range(places.shape[1])):
        for digit in range(0, 8 * width, 16):
            part = (places[:, word] >> np.uint64(digit)).astype(np.uint16)
            order = order[np.argsort(part[order], kind="stable")]
    return order


def packed(places: np.ndarray, width: int) -> np.ndarray:
    """Rows of ids as rows of big-endian bytes, width for each id."""
    return np.ascontiguousarray(places.astype(">u8").view(np.uint8).reshape(*places.shape, 8)[:, :, 8 - width :]).reshape(len(places), -1)


def chunk_keys(ids: np.ndarray, width: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys at all places of ids (0 breaks), in order, with their counts."""
    padded = np.concatenate([ids, np.zeros(longest, np.uint64)])
    starts = np.flatnonzero((padded[:-longest] > 0) & (padded[1 : 1 - longest] > 0))
    places = padded[starts[:, None] + np.arange(longest)]
    places[np.cumsum(places == 0, axis=1) > 0] = 0
    places = places[radix_sorted(places, width)]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(places)), bool), (places[1:] != places[:-1]).any(1)]))
    return packed(places[first], width), np.diff(np.concatenate([first, [len(places)]]))


def run_lengths(keys: np.ndarray, counts: np.ndarray, width: int, least: int, longest: int = LONGEST) -> Iterator[tuple[bytes, int]]:
    """(phrase, count) of the runs of equal prefixes of two words and more of sorted keys: frequent ones, and the first and last, which may go on elsewhere."""
    words = keys.reshape(len(keys), longest, width)
    apart = (words[1:] != words[:-1]).any(2)
    some = (words != 0).any(2)
    for n in range(2, longest + 1):
        starts = np.concatenate([[0], np.flatnonzero(apart[:, :n].any(1)) + 1])
        sums = np.add.reduceat(counts, starts)
        ends = np.isin(np.arange(len(starts)), [0, len(starts) - 1])
        for i in np.flatnonzero(some[starts, n - 1] & ((sums >= least) | ends)).tolist():
            yield keys[starts[i], : n * width].tobytes(), int(sums[i])


def dictionary(chunked: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the words that are frequent in their language; ids are dense, from 1."""
    totals = chunked.where("word is not null").groupBy("lang", "word").agg(F.sum("count").alias("f"))
    return cut(numbered(totals.where(F.col("f") >= least), ["lang", "word"], "id").select("lang", "word", "f", F.col("id").cast("long").alias("id")), "dictionary")


def chunk_ids(codes: bytes, size: int, pos: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """The ids of a chunk's places; 0 where a piece ends or a word is infrequent."""
    lookup = np.zeros(size + 1, np.uint64)
    lookup[pos] = ident
    return lookup[np.frombuffer(codes, np.int32)]


def with_ids(chunked: DataFrame, words: DataFrame) -> DataFrame:
    """(codes, size, pos, id): each chunk with the ids of its frequent words by their position."""
    own = chunked.where("word is not null").select("chunk", "lang", "pos", "word")
    ids = own.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("m"))
    whole = chunked.where("codes is not null").select("chunk", "codes", F.col("pos").alias("size"))
    return whole.join(ids, "chunk").select("codes", "size", F.col("m.pos").alias("pos"), F.col("m.id").alias("id"))


def per_chunk(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sorted distinct keys of each chunk, with their counts."""
    for batch in batches:
        for codes, size, pos, ident in zip(*batch.columns):
            yield chunk_keys(chunk_ids(codes.as_py(), size.as_py(), pos.values.to_numpy(), ident.values.to_numpy()), width)


def range_bounds(chunked: DataFrame, words: DataFrame, width: int) -> np.ndarray:
    """The least keys of all ranges but the first, from the keys of some chunks."""
    whole = chunked.where("word is null").agg(F.sum("count").alias("places"), F.count(F.lit(1)).alias("chunks")).first()
    ranges = min(MOST_RANGES, (whole["places"] or 0) * LONGEST * width // RANGE_BYTES + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _ in per_chunk(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys[:: len(keys) // SAMPLED_KEYS + 1]], pa.binary())], names=["key"])

    some = chunked.where(F.pmod(F.xxhash64("chunk"), F.lit(max(1, whole["chunks"] // SAMPLED_CHUNKS))) == 0)
    found = with_ids(some, words).mapInArrow(run, "key binary").limit(4 * SAMPLED_CHUNKS * SAMPLED_KEYS).collect() if ranges > 1 else []
    sample = np.sort(np.array([bytes(r["key"]) for r in found], f"S{LONGEST * width}"))
    return np.unique(sample[np.arange(1, ranges) * len(sample) // ranges]) if len(sample) else sample


def keys_of(chunked: DataFrame, words: DataFrame, width: int, bounds: np.ndarray) -> DataFrame:
    """(range, n, keys, counts): a row for each chunk and range, the keys and counts as planes of bytes."""
    shared = chunked.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in per_chunk(batches, width):
            ends = np.concatenate([[0], np.searchsorted(keys.view(f"S{keys.shape[1]}").ravel(), shared.value), [len(keys)]])
            some = np.flatnonzero(np.diff(ends)).tolist()
            size = int(counts.max(initial=1)).bit_length() // 8 + 1
            rows = ((r, int(ends[r + 1] - ends[r]), keys[ends[r] : ends[r + 1]].T.tobytes(), counts[ends[r] : ends[r + 1]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()) for r in some)
            while batch := list(islice(rows, BATCH_RANGES)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batch), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["range", "n", "keys", "counts"])

    return with_ids(chunked, words).mapInArrow(run, "range int, n long, keys binary, counts binary")


def counted(keys: DataFrame, width: int, least: int) -> DataFrame:
    """(key, f) of all phrases of two words or more that occur ``least`` times: each range sorted and run-length counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None

        def out() -> pa.RecordBatch:
            data, counts = (np.concatenate(x) for x in zip(*held))
            held.clear()
            places = np.zeros((len(data), LONGEST, 8), np.uint8)
            places[:, :, 8 - width :] = data.reshape(len(data), LONGEST, width)
            order = radix_sorted(places.view(">u8")[:, :, 0].astype(np.uint64), width)
            found = list(run_lengths(data[order], counts[order], width, least))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int64())], names=["key", "f"])

        for batch in batches:
            for part, n, data, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:
                    yield out()
                now = part
                planes = np.zeros((n, 8), np.uint8)
                planes[:, : len(counts) // n] = np.frombuffer(counts, np.uint8).reshape(-1, n).T
                held.append((np.frombuffer(data, np.uint8).reshape(-1, n).T, planes.view("<i8")[:, 0]))
        if held:
            yield out()

    found = keys.repartition("range").sortWithinPartitions("range").mapInArrow(run, "key binary, f long")
    return found.groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def slice_words(key: Column, first: Column | int, count: Column | int, width: int) -> Column:
    """count words of a key from the given one (0 is the first)."""
    number = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.substr(key, number(first) * width + 1, number(count) * width)


def score_of(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)) of whole decimals of 19 digits, exact while a n has no more than 34."""
    product = (a * n).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (left * right).cast("decimal(38,0)"))


def best_of(rows: DataFrame, group: str, order: list[Column], spread: Column, most: int) -> DataFrame:
    """The first rows of each group with their rank: first in hash buckets, then of what these leave."""
    some = Window.partitionBy(group, "__bucket").orderBy(*order)
    few = rows.withColumn("__bucket", spread).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most).drop("rank", "__bucket")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def mine(docs: DataFrame, least: int = 100, most: int = 2000, cover: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` phrases that occur ``least`` times or more.

    l and r are the counts of the two parts of the cut that scores least, floor(1000 a n / (l r)). A phrase goes if a longer
    one that holds it occurs at least ``cover`` percent as often (of two words fewer, the phrase between is one too).
    """
    bound_batches(docs.sparkSession)
    chunked = cut(chunks(docs, lang_col, text_col), "chunks")
    words = dictionary(chunked, least)
    bound_batches(docs.sparkSession, CHUNK_ROWS)
    top = words.agg(F.max("id")).first()[0] or 0
    width = max(1, (int(top).bit_length() + 7) // 8)
    totals = cut(chunked.where("word is not null").groupBy("lang").agg(F.sum("count").alias("n")), "lang-words")
    phrases = cut(counted(keys_of(chunked, words, width, range_bounds(chunked, words, width)), width, least), "phrases")
    remove(chunked)

    size = F.floor(F.octet_length("key") / width).cast("int")
    one = F.substr(F.unhex(F.lpad(F.hex("id"), 16, "0")), F.lit(9 - width), F.lit(width))
    parts = phrases.select(F.col("key").alias("part"), F.col("f").alias("pf")).unionAll(words.select(one.alias("part"), F.col("f").alias("pf")))
    sized = phrases.withColumn("size", size)
    inner = F.explode(F.array(slice_words(F.col("key"), 0, F.col("size") - 1, width), slice_words(F.col("key"), 1, F.col("size") - 1, width)))
    longer = sized.where("size > 2").select(inner.alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = sized.join(longer, "key", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f"))).drop("longer")

    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = kept.select("key", "size", "f", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": slice_words(F.col("key"), 0, F.col("k"), width), "right": slice_words(F.col("key"), F.col("k"), F.col("size") - F.col("k"), width)})
    cuts = cuts.join(parts.select(F.col("part").alias("left"), F.col("pf").alias("l")), "left").join(parts.select(F.col("part").alias("right"), F.col("pf").alias("r")), "right")
    heads = words.select(one.alias("head"), "lang")
    placed = cuts.withColumn("head", slice_words(F.col("key"), 0, 1, width)).join(heads, "head").join(totals, "lang")
    scored = placed.withColumn("score", score_of(*map(exact, ("f", "n", "l", "r"))))
    least_cut = scored.groupBy("key", "lang", "f", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    spelled = kept.select("key", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("at")).withColumn("head", slice_words(F.col("key"), F.col("at"), 1, width))
    spelled = spelled.join(words.select(one.alias("head"), "word"), "head").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"]), " ").alias("phrase"))
    rows = least_cut.join(spelled, "key").select("lang", "phrase", F.col("f").alias("a"), "c.l", "c.r", "n", "c.score", "key")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ranked = best_of(rows, "lang", order, F.pmod(F.xxhash64("key"), F.lit(RANK_BUCKETS)), most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
