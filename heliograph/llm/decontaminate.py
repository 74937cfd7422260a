"""Benchmark decontamination by spaced seeds.

Texts are lower-cased and cut into runs of letters and digits; characters of scripts that write no spaces between words
are tokens of their own. A spaced seed is a fixed mask over SPAN
tokens that ignores some positions; the hash of the kept positions is the same for two passages that
differ only where the mask looks away. Every mask at every position of every document meets the
benchmark's hashes; a hit fixes an alignment of one item with the document, which is then checked token
by token: an item is in a document if some window of min(OVERLAP, its length) aligned tokens has at least
SHARE of them equal. The masks together hit every such window of OVERLAP tokens with up to two
substitutions. Items of SPAN to OVERLAP - 1 tokens have masks of their own, over the whole item: it is cut into four
runs, and any two substitutions leave two runs whole, so a mask for every two runs hits them all.

Items of SHORTEST to SPAN - 1 tokens are looked for whole and unchanged; characters of scripts without spaces count half here. Items of fewer tokens are ordinary
phrases; they are looked for, in the same way, only if ``shortest`` says so. Items without an id count as item -1.

Null and empty texts contain nothing. Repeated documents are judged one by one, each with a row of its own; equal
items are looked for once and each reported. The benchmark is broadcast in blocks of about BLOCK_BYTES, one pass
over the documents for each. A text of any length is looked at whole. Without documents or without items nothing is found. Columns of
the documents keep their names and values in clean().
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, quoted
from heliograph.llm.wordhash import NOT_ALNUM, hash_texts, mix

#: Kept positions of each mask.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 3, 4, 7, 8), (0, 2, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8), (0, 3, 4, 5, 7, 8))
SPAN = 9
OVERLAP = 13
SHARE = 0.8
SHORTEST = 5
BLOCK_BYTES = 16 << 20
#: Places of a filter for each of its seeds, about, and how many bits number them at most.
FILTER_ROOM, FILTER_BITS = 32, 22
#: Alignments that are looked at together, whatever the number of items that share a passage.
CHUNK = 1 << 18
_PLACE = np.random.default_rng(9).integers(0, 1 << 63, OVERLAP, np.uint64) * np.uint64(2) + np.uint64(1)
_SYMBOLS = re.compile(r"[\W_]+")
#: Letters of scripts that write no spaces between words (Thai to Tibetan, Burmese, Khmer, kana, Chinese characters).
_SPACELESS = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


def normalised(text) -> bytes:
    if not isinstance(text, str):
        return b""
    low = text.lower()
    return (low if low.isascii() else _SYMBOLS.sub(" ", _SPACELESS.sub(r" \1 ", low))).encode("utf-8", "surrogatepass")


def weight(text) -> float:
    """How many tokens an item counts as: characters of scripts without spaces count half."""
    data = normalised(text)
    words = data.translate(bytes(32 if apart else b for b, apart in enumerate(NOT_ALNUM))).split()
    return sum(0.5 if w[0] >= 0xE0 and _SPACELESS.match(w.decode("utf-8", "replace")) else 1.0 for w in words)


def seed_hashes(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """The masked hash at every position where the mask fits."""
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, len(mask) * 64 + mask[-1], np.uint64)
    for j in mask:
        total += words[j : j + n] * _PLACE[j]
    return mix(total)


def whole_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over an item of n tokens: all of it below SPAN, else every two of four runs."""
    if n < SPAN:
        return [tuple(range(n))]
    runs = [range(n * k // 4, n * (k + 1) // 4) for k in range(4)]
    return [(*a, *b) for a, b in combinations(runs, 2)]


class SeedIndex:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list[int | None], texts: list[str], shortest: int = SHORTEST):
        words, counts = hash_texts([normalised(t) for t in texts], NOT_ALNUM)
        every = np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []
        same: dict[bytes, int] = {}
        self.ids: list[list[int]] = []  # of each distinct sequence of tokens
        self.items: list[np.ndarray] = []
        heavy: list[bool] = []
        for i, w, text in zip(ids, every, texts):
            k = same.setdefault(w.tobytes(), len(same))
            if k == len(self.items):
                self.items.append(w)
                self.ids.append([])
                heavy.append(len(w) >= OVERLAP or len(w) >= 1 and weight(text) >= shortest)
            self.ids[k].append(-1 if i is None else i)
        self.masks: list[tuple[int, ...]] = []
        self.seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # sorted hashes, items, positions
        lengths = sorted({len(w) for w, some in zip(self.items, heavy) if some and len(w) < OVERLAP})
        for mask, whole in [*((m, 0) for m in MASKS), *((m, n) for n in lengths for m in whole_masks(n))]:
            fits = [(i, seed_hashes(w, mask)) for i, w in enumerate(self.items) if heavy[i] and (len(w) == whole if whole else len(w) >= OVERLAP)]
            if whole:  # the mask's place in the item is fixed
                fits = [(i, h[:1]) for i, h in fits]
            found = [(h, np.full(len(h), i, np.int32), np.arange(len(h), dtype=np.int32)) for i, h in fits]
            if found:
                h, item, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(h, kind="stable")
                self.masks.append(mask)
                self.seeds.append((h[order], item[order], at[order]))
        self.maybe: list[tuple[np.uint64, np.ndarray]] = []  # by how much a hash is shifted, and whether there is one
        for h, _, _ in self.seeds:
            size = min(FILTER_BITS, max(10, (FILTER_ROOM * len(h)).bit_length()))
            bits = np.zeros(1 << size, bool)
            bits[h >> np.uint64(64 - size)] = True
            self.maybe.append((np.uint64(64 - size), bits))

    def alignments(self, words: np.ndarray, firsts: np.ndarray) -> Iterator[np.ndarray]:
        """Chunks of distinct (text, item, place of the item's first token among words) of all hits; texts begin at firsts."""
        for mask, (h, item, at), (shift, maybe) in zip(self.masks, self.seeds, self.maybe):
            probe = seed_hashes(words, mask)
            spots = np.flatnonzero(maybe[probe >> shift])
            low, high = np.searchsorted(h, probe[spots]), np.searchsorted(h, probe[spots], side="right")
            spots, low, count = spots[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(count)
            begin = 0
            while begin < len(spots):  # about CHUNK alignments, one spot at least
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHUNK, side="right")))
                n = count[begin:end]
                spot = np.repeat(spots[begin:end], n)
                entry = np.repeat(low[begin:end], n) + np.arange(len(spot)) - np.repeat(np.cumsum(n) - n, n)
                text = np.searchsorted(firsts, spot, side="right") - 1
                yield np.unique(np.stack([text, item[entry], spot - at[entry]], axis=1), axis=0)
                begin = end

    def verified(self, words: np.ndarray, item: int, start: int) -> int:
        """Most equal tokens in a window of the alignment, or 0 if they are too few."""
        target = self.items[item]
        low, high = max(0, -start), min(len(target), len(words) - start)
        window = min(OVERLAP, len(target))
        if high - low < window:
            return 0
        same = np.concatenate([[0], np.cumsum(target[low:high] == words[start + low : start + high])])
        most = int((same[window:] - same[:-window]).max())
        need = window if len(target) < SPAN else int(np.ceil(SHARE * window - 1e-9))
        return most if most >= need else 0

    def matches(self, texts: list) -> list[dict[int, int]]:
        """For each text, the items found in it with their most equal tokens."""
        words, counts = hash_texts([normalised(t) for t in texts], NOT_ALNUM)
        firsts = np.concatenate([[0], np.cumsum(counts)])
        found: list[dict[int, int]] = [{} for _ in texts]
        for chunk in self.alignments(words, firsts):
            for d, item, start in chunk.tolist():
                if found[d].get(item, 0) < min(OVERLAP, len(self.items[item])):
                    most = self.verified(words[firsts[d] : firsts[d + 1]], item, start - int(firsts[d]))
                    if most:
                        found[d][item] = max(most, found[d].get(item, 0))
        return found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, shortest: int) -> Iterator[SeedIndex]:
    """The benchmark in blocks of a bounded size."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = 1 + size // BLOCK_BYTES
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).toPandas().sort_values(["i", "t"])
        yield SeedIndex([None if pd.isna(i) else int(i) for i in part["i"]], part["t"].tolist(), shortest)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", shortest: int = SHORTEST) -> DataFrame:
    """(id_col, item_ids, equal_tokens) of the documents that contain an item: its items in order, and the most equal tokens of any window."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col(quoted(text_col))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))

    def one(index: SeedIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = [(k, h, m) for k, h, m in zip(batch["id"], batch["h"], shared.value.matches(batch["text"].tolist())) if m]
                if hits:
                    ids = [sorted({i for item in m for i in shared.value.ids[item]}) for *_, m in hits]
                    out = pd.DataFrame({"id": [None if pd.isna(k) else int(k) for k, *_ in hits], "h": [h for _, h, _ in hits], "item_ids": ids, "equal_tokens": [max(m.values()) for *_, m in hits]})
                    yield out.astype({"id": "Int64"})

        return rows.mapInPandas(run, "id long, h long, item_ids array<long>, equal_tokens int")

    parts = [one(index) for index in _blocks(benchmark, item_col, "text", shortest)]
    found = parts[0]
    if len(parts) > 1:
        # Every block finds as many rows of a document (id and text) as the table has; they get as many rows in the end.
        marked = reduce(DataFrame.unionAll, [p.withColumn("block", F.lit(k)) for k, p in enumerate(parts)])
        each = marked.groupBy("id", "h", "block").agg(F.count(F.lit(1)).alias("n"), F.first("item_ids").alias("item_ids"), F.max("equal_tokens").alias("equal_tokens"))
        whole = each.groupBy("id", "h").agg(F.max("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("equal_tokens").alias("equal_tokens"))
        found = whole.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return found.select(F.col("id").alias(id_col), "item_ids", "equal_tokens")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs that contain no benchmark item, unchanged."""
    spark = docs.sparkSession
    bound_batches(spark)
    for index in _blocks(benchmark, item_col, "text", shortest):
        docs = docs.where(_is_clean(spark.sparkContext.broadcast(index))(F.col(quoted(text_col))))
    return docs


def _is_clean(shared):
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([not m for m in shared.value.matches(texts.tolist())], dtype=bool)

    return run
