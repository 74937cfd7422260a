"""Best-fit packing of tokenised documents into sequences, after a dominance reduction.

Documents are tokenised in Spark tasks and cut into pieces of at most ``capacity`` tokens. Which
document fills which place does not matter to the number of sequences, only the lengths do, so the
plan is made on the histogram of lengths: ``capacity`` counters however large the corpus is.

1. Reduction (Martello and Toth): for the longest remaining length, a small set of lengths is fixed
   into a sequence for good when every feasible alternative is dominated by it: nothing else fits; a
   length fills the rest exactly; only one more piece fits (take the longest); at most two more fit
   and one set of one or two beats all others. Fixed sets shrink the instance; passes repeat until
   none applies.
2. Best fit decreasing on the remainder, many equal sequences at a time.

The plan assigns rank intervals of each length to runs of sequences. Ranks are given in Spark by
counting within (length, hash bucket) and adding the counts of the earlier buckets, so no length, however
frequent, meets in one task.

Null text is empty text: one piece holding only the end id. Repeated rows and repeated ids are packed
once each. Rows with a null id are packed too. An empty table packs into nothing. A text longer than a
sequence, however long, is cut into pieces of the capacity and a rest. Other columns are left out, so none can clash.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, kept_by
from heliograph.shared import cut

CAPACITY = 4096
END_ID = 1
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STOPS = (b".", b",")


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte (a fixed rule)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
#: Words a worker remembers the ids of, in each of two generations (some 200 bytes each); fewer cost time, never results.
REMEMBERED = 600_000
#: Buckets that equal lengths are ranked in.
RANK_BUCKETS = 256


class WordIds:
    """ids of whole texts from a tokenizer that never joins across ASCII white space, remembered word by word.

    Remembered words have two generations: the younger one is filled, then takes the place of the older one; words that are
    asked for again move on.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        #: Letters decide whether a special token is one, so words that may hold one are left alone.
        special = {t.content[:1].encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        #: Combining marks (lead bytes CC and CD) may join the letter before them.
        self.odd = re.compile(b"[" + b"".join(map(re.escape, special)) + b"\xcc\xcd]").search
        self.bare = self._is_bare()

    def _bare_ids(self, text: str) -> list[int]:
        """ids of one run of lower-case letters, straight from the model."""
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, text.encode())))]

    def _is_bare(self) -> bool:
        """Whether letters reach the model as they are, byte by byte."""
        probe = ["the", "a", "tokenization", "zxqv", "élève", "straße", "ñandú", "привет", "日本語"]
        try:
            return all(self._bare_ids(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        except Exception:  # a model of another kind
            return False

    def _learn(self, words: list[bytes]) -> None:
        rest = []
        tokenize = self.tokenizer.model.tokenize
        for w in words:
            if self.bare and w.isalpha() and w.islower():  # ASCII letters stand for themselves
                self.known[w] = array("I", [t.id for t in tokenize(w.decode())]).tobytes()
                continue
            text = w.decode("utf-8", "replace")
            if self.bare and text.isalpha() and text == text.lower() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
                self.known[w] = array("I", self._bare_ids(text)).tobytes()
            else:
                rest.append((w, text))
        for i in range(0, len(rest), 4096):
            part = rest[i : i + 4096]
            for (w, _), e in zip(part, self.tokenizer.encode_batch([t for _, t in part], add_special_tokens=False)):
                self.known[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split = [t.split() for t in texts]
        words = set().union(*split)
        if len(self.known) > self.remembered:
            self.known, self.older = {}, self.known
        new = words.difference(self.known)
        again = [w for w in new if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        new.difference_update(again)
        # The tokenizer lower-cases and cuts between a letter and a full stop or comma, so most new words are
        # known ones in another dress.
        bases = {}
        odd = self.odd
        for w in new:
            if not (w.isalpha() and w.islower()) and not odd(w):
                low = w.translate(LOWER)
                if low[-1:] in STOPS and low[-2:-1].isalpha():
                    bases[w] = (low[:-1], low[-1:])
                elif low != w:
                    bases[w] = (low, b"")
        known, older = self.known, self.older
        parts = {x for pair in bases.values() for x in pair if x}.union(w for w in new if w not in bases).difference(known)
        known.update((w, older[w]) for w in parts if w in older)
        self._learn(list(parts.difference(known)))
        for w, (base, stop) in bases.items():
            known[w] = known[base] + known[stop] if stop else known[base]
        find = {w: known[w] for w in words}.__getitem__  # a small table is looked up faster
        return [b"".join(map(find, ws)) for ws in split]


def encoder(path: str, remembered: int = REMEMBERED) -> WordIds:
    """One for each tokenizer file, kept in the worker from task to task until another operator runs there."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    kept = kept_by("packing")
    if (path, remembered) not in kept:
        kept[path, remembered] = WordIds(path, remembered)
    return kept[path, remembered]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document with its end id, cut into pieces."""
    bound_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = encoder(tokenizer_path, remembered)
        for batch in batches:
            texts = [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in batch["text"]]
            out = []
            for key, data in zip(batch["id"], ids.encode(texts)):
                data = memoryview(data + end)
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    out.append((None if pd.isna(key) else int(key), p, at // 4, len(part) // 4, zlib.crc32(part)))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Sequences as runs of equal ones. slots: (length, first rank, number, first sequence, offset)."""

    def __init__(self, counts: np.ndarray):
        self.capacity = len(counts) - 1
        self.left = counts.astype(np.int64).copy()
        self.ranks = np.zeros(len(counts), np.int64)
        self.slots: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0

    def place(self, size: int, number: int, sequence: int, offset: int) -> None:
        self.slots.append((size, int(self.ranks[size]), number, sequence, offset))
        self.ranks[size] += number
        self.left[size] -= number

    def open(self, sizes: list[int], number: int) -> None:
        """number new sequences that hold these sizes."""
        offset = 0
        for size in sizes:
            self.place(size, number, self.sequences, offset)
            offset += size
        self.sequences += number

    # --- reduction

    def _smallest(self, size: int, how_many: int, above: int = 0) -> list[int]:
        """The smallest remaining pieces longer than above, other than one of the given size."""
        found: list[int] = []
        for s in np.flatnonzero(self.left[above + 1 :])[: how_many + 1] + above + 1:
            found += [int(s)] * min(how_many, int(self.left[s]) - (s == size))
        return found[:how_many]

    def _largest(self, size: int, at_most: int, used: tuple[int, ...] = ()) -> int:
        """The longest piece that fits, other than those used; 0 if none does."""
        for s in np.flatnonzero(self.left[: at_most + 1])[::-1][: len(used) + 2]:
            if self.left[s] > (s == size) + used.count(int(s)):
                return int(s)
        return 0

    def dominating(self, size: int) -> list[int] | None:
        """What to put beside a piece of this size in a set that dominates all its alternatives, if one is found."""
        room = self.capacity - size
        best = self._largest(size, room)
        if not best:
            return []
        if best == room:
            return [best]
        low = self._smallest(size, 3)
        if sum(low[:2]) > room or len(low) < 2:
            return [best]
        if len(low) == 3 and sum(low) <= room:
            return None
        # At most two more fit. Beside the longest, the longest that still fits:
        second = self._largest(size, room - best, (best,))
        if not second:
            inner = self._smallest(size, 2)
            return [best] if sum(inner) > room or self._best_pair(size, room) <= best else None
        inner = [s for s in self._smallest(size, 2, above=second) if s < best]
        return [best, second] if len(inner) < 2 or sum(inner) > room else None

    def _best_pair(self, size: int, room: int) -> int:
        sizes = np.flatnonzero(self.left[: room + 1])
        most = 0
        for a in sizes[sizes <= room // 2]:
            b = self._largest(size, room - int(a), (int(a),))
            if b and self.left[a] > (a == size):
                most = max(most, int(a) + b)
        return most

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for size in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[size]:
                    beside = self.dominating(size)
                    if beside is None:
                        break
                    members = [size, *beside]
                    number = min(int(self.left[s]) // members.count(s) for s in members)
                    if beside and number > 1 and members.count(size) == 1 and sum(members) != self.capacity:
                        number = min(number, max(1, int(min(self.left[s] for s in members)) - 1))  # the rules looked at what remains
                    self.open(members, number)
                    self.fixed += number
                    changed = True

    # --- best fit

    def best_fit(self) -> None:
        runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of (first sequence, number)
        has = np.zeros(self.capacity + 1, bool)
        for size in np.flatnonzero(self.left)[::-1].tolist():
            while count := int(self.left[size]):
                fits = np.flatnonzero(has[size:])
                if len(fits):
                    room = int(fits[0]) + size
                    first, number = runs[room].pop()
                    has[room] = bool(runs[room])
                else:
                    room, first = self.capacity, self.sequences
                    number = -(-count // (room // size))
                    self.sequences += number
                each = room // size
                full = min(number, count // each)
                for j in range(each if full else 0):
                    self.place(size, full, first, self.capacity - room + j * size)
                if full and room - each * size:
                    runs[room - each * size].append((first, full))
                    has[room - each * size] = True
                rest = int(self.left[size])
                if number > full and rest < each:
                    for j in range(rest):
                        self.place(size, 1, first + full, self.capacity - room + j * size)
                    if rest:
                        if room > rest * size:
                            runs[room - rest * size].append((first + full, 1))
                            has[room - rest * size] = True
                        full += 1
                if number > full:
                    runs[room].append((first + full, number - full))
                    has[room] = True


def plan(counts: np.ndarray) -> Plan:
    """counts[l]: pieces of length l, for l from 0 to the capacity."""
    made = Plan(counts)
    made.reduce()
    made.best_fit()
    return made


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """Every piece with its sequence_id and offset; ``remembered`` bounds what the encoders keep."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer_path, capacity, id_col, text_col, remembered), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in cutup.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[row["length"]] = row["n"]
    made = plan(histogram)
    slots = np.array(made.slots, np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    shared = spark.sparkContext.broadcast((slots[:, 0] * (1 << 48) + slots[:, 1], slots))

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    dealt = cutup.withColumn("bucket", bucket)
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rn", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("rn") - 1 + F.col("before"))

    def seat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, table = shared.value
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            slot = table[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1] if len(batch) else table[:0]
            batch["sequence_id"], batch["offset"] = slot[:, 3] + rank - slot[:, 1], slot[:, 4]
            yield batch[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]].astype({"doc_id": "Int64"})

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInPandas(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
