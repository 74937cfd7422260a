"""SimHash near-duplicates, compared by bit slices.

Fingerprints: A-Z are lower-cased, words are runs of bytes other than space and 0x09-0x0D, and each
shingle of ``width`` words (repeats included; a shorter text is one shingle) is hashed by XXH64 with
seed 42. A bit of the fingerprint is 1 if it is 1 in over half of the hashes. Texts without words, and
null texts, have fingerprint zero, which links like any other.

Search: two fingerprints at most ``radius`` bits apart agree wholly on at least two of ``radius + 2``
blocks of bits, so one table for every two blocks finds all links exactly. Within a table the rows
that share a key are laid out as vertical bit planes; carry-save adders count the differing bits of
64 pairs at a time, and words in which every pair has passed the radius are given up early. Keys with
more than BLOCK fingerprints are cut into blocks that meet pairwise. A block returns a spanning set of
its links, not all of them, so that large groups stay linear.

deduplicate() takes fingerprints of the distinct shingles in WORDS words, as 64 bits find too few of the texts that are just
similar enough. Each table is keyed by some of these bits, more of them the more texts there are; what shares a key is compared
by the same bit planes over the first word, what is close there by the whole fingerprint, and what is close then exactly.

Null and empty texts, and those without a word, have fingerprint zero in group() and are one set without shingles in
deduplicate(). Texts of any length count whole. An empty table gives no rows. Columns keep their values, whatever their names.

Equal fingerprints are one node in group(), equal sets of shingles in deduplicate(). Repeated ids get one row each; rows with a null id take
part and get their component's smallest id, which is null only if all ids in it are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.bloom import maybe_in
from heliograph.llm.common import as_rows, bound_batches, quoted
from heliograph.operators.components import connected_components
from heliograph.shared import cut

SEED = 42
#: Fingerprints of one key that are compared at once; more are cut into blocks of about this many.
BLOCK = 2048
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: For deduplicate(): 64-bit words of a fingerprint, and the radius within which texts are compared. At a similarity of 0.8
#: fingerprints of sets differ in about 39 bits of 256 with a deviation of 6, random ones in 128 with a deviation of 8.
#: Bit planes compare the first word, in which 4 sets of 5 shingles differ in 12 bits with a deviation of 3 (they need the most).
WORDS, WIDE_RADIUS, FIRST_RADIUS = 4, 80, 26
#: Part of the bits in which sets of similarity 0.8 agree, and tables in units of what one agreement needs: with k bits a
#: key a pair meets in TABLES of them on average.
AGREE, TABLES = 0.8485, 14
MOST_KEY_BITS = 20
#: The set bits of each byte value.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(data, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(data[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: str | None, width: int) -> int:
    """The unsigned 64-bit fingerprint."""
    return majority(shingle_hashes(text, width))


def majority(h: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes."""
    if not len(h):
        return 0
    return int(_majorities(h[:, None])[0])


def _majorities(h: np.ndarray) -> np.ndarray:
    """Of each column of hashes, the bits that are 1 in over half of them."""
    columns = np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1)
    places = np.arange(columns.shape[1]) * 256
    ones = np.zeros(len(places) * 256, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.bincount((columns[at : at + (1 << 16)] + places).ravel(), minlength=len(ones))
    return np.packbits(2 * (ones.reshape(-1, 256) @ BITS) > len(h), bitorder="little").view(np.uint64)


#: The node of the set without shingles.
EMPTY = int(np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64).view(np.int64)[0])
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, WORDS - 1, np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WORDS words: the majority of the hashes, and of what mixing makes of them."""
    if not len(h):
        return np.zeros(WORDS, np.uint64)
    more = h[:, None] * FACTORS
    more = (more ^ (more >> np.uint64(32))) * FACTORS
    return _majorities(np.hstack([h[:, None], more ^ (more >> np.uint64(29))]))


def key_bits(count: int) -> int:
    """The bits of a key for so many texts: half of what would number them, so a key holds about as many texts as there are keys."""
    return min(MOST_KEY_BITS, max(1, round(math.log2(max(count, 2)) / 2)))


def tables_of_bits(k: int) -> np.ndarray:
    """The places of the k bits of each table."""
    random = np.random.default_rng([SEED, k])
    return np.array([random.permutation(64 * WORDS)[:k] for _ in range(math.ceil(TABLES / AGREE**k))])


def keys_of(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each fingerprint (a row of WORDS words) its bucket in each table; tables share no buckets."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    k = places.shape[1]
    keys = np.zeros((len(words), len(places)), np.int32)
    for i in range(k):
        keys |= bits[:, places[:, i]].astype(np.int32) << i
    return keys + (np.arange(len(places), dtype=np.int32) << k)


def table_keys(h: np.ndarray, k: int = 9) -> np.ndarray:
    """The buckets of a set of hashes with k bits a key; none for an empty set."""
    return keys_of(wide_fingerprint(h)[None, :], tables_of_bits(k))[0] if len(h) else np.zeros(0, np.int32)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that differ in id or text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def fingerprints(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row, fp) for every row; fp is the fingerprint as a signed long, row the row_key."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None, width) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "row": batch["row"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, row long, fp long")


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, row, fp, more, node) for every row, all of the set of shingles: first and further words of the fingerprint, and hash. Only equal sets share a node."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, nodes = [], []
            for text in batch["text"]:
                h = np.unique(shingle_hashes(text if isinstance(text, str) else None, width))
                words.append(wide_fingerprint(h).view(np.int64))
                nodes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            yield pd.DataFrame({"id": batch["id"], "row": batch["row"], "fp": [int(w[0]) for w in words], "more": [w[1:] for w in words], "node": np.array(nodes, np.uint64).view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, row long, fp long, more array<long>, node long")


# --- bit-sliced comparison -------------------------------------------------------------------------


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A carry-save adder: the sum bit and the carry bit of three bit vectors."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _beyond(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where the counted bits exceed radius."""
    more, same = over.copy(), ~over
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            more |= same & counters[i]
            same = same & ~counters[i]
    return more


def close_pairs(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j with fps[i] and fps[j] at most radius bits apart; a fingerprint is a number or a row of numbers of 64 bits."""
    n = len(fps)
    words = (n + 63) // 64
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    size = bits.shape[1]
    padded = np.zeros((size, words * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)  # size x words
    masks = np.ascontiguousarray((np.uint64(0) - bits.astype(np.uint64)).T)  # size x n: all ones where the bit is set
    width = max(2, radius.bit_length())
    left, right = [], []
    index = np.arange(words * 64)
    for at in range(0, n, 256):
        q = np.arange(at, min(n, at + 256))
        first = at // 64
        none = (index[None, first * 64 :] <= q[:, None]) | (index[None, first * 64 :] >= n)
        over = np.packbits(none, axis=1, bitorder="little").view(np.uint64)
        shape = over.shape
        over, grid = over.ravel(), True
        rows, cols = np.repeat(q, shape[1]), np.tile(np.arange(first, words), shape[0])
        counters = [np.zeros(len(rows), np.uint64) for _ in range(width)]
        for k in range(0, size, 4):
            if grid:  # every word of every row
                d = [(planes[k + i][None, first:] ^ masks[k + i][at : at + 256, None]).ravel() for i in range(4)]
            else:
                d = [planes[k + i][cols] ^ masks[k + i][rows] for i in range(4)]
            counters[0], two = _add(counters[0], d[0], d[1])
            counters[0], two_more = _add(counters[0], d[2], d[3])
            counters[1], carry = _add(counters[1], two, two_more)
            for i in range(2, width):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if k >= 8 and k >= radius and (radius < 16 or k % 32 == 0):
                alive = _beyond(counters, over, radius) != np.uint64(0xFFFFFFFFFFFFFFFF)
                if 2 * np.count_nonzero(alive) < len(alive):
                    rows, cols, over, counters, grid = rows[alive], cols[alive], over[alive], [c[alive] for c in counters], False
            if not len(rows):
                break
        if len(rows):
            near = np.unpackbits((~_beyond(counters, over, radius)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, b = np.nonzero(near)
            left.append(rows[r])
            right.append(cols[r] * 64 + b)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the given pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tables_of(radius: int) -> list[int]:
    """One mask for every two of radius + 2 blocks of the 64 bits."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [a | b for a, b in combinations(blocks, 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocked(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Rows of nodes(fp, ...) dealt to comparison groups by their bits: (t, key, lo, hi, fp, ...), sorted within partitions."""
    keyed = nodes.withColumn("k", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])))
    return arranged(dealt(keyed.select("k.t", "k.key", *nodes.columns), "fp"))


def dealt(keyed: DataFrame, by: str) -> DataFrame:
    """(t, key, lo, hi, ...) of keyed(t, key, ...).

    Only keys with two rows or more are kept; large keys are cut by ``by`` into blocks that meet pairwise.
    """
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    every = keyed.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64(by), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return every.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), *keyed.columns[2:])


def arranged(groups: DataFrame) -> DataFrame:
    return groups.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = BLOCK) -> Iterator[pd.DataFrame]:
    """Re-cut sorted batches so that each holds whole groups, of about ``rows`` rows unless one group is larger."""
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True)
        cols = [frame[k].to_numpy() for k in keys]
        starts = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
        at = 0
        for s in starts[1:]:
            if s - at >= rows:
                yield frame.iloc[at:s]
                at = s
        if starts[-1] > at:  # all but the last group, which may go on
            yield frame.iloc[at : starts[-1]]
            at = starts[-1]
        held = [frame.iloc[at:]]
        count = len(held[0])
    if count:
        yield pd.concat(held, ignore_index=True)


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): a spanning set of the links between the distinct fingerprints of nodes(fp)."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["t", "key", "lo", "hi"]):
            fps = np.unique(frame["fp"].to_numpy())
            left, right = close_pairs(fps.view(np.uint64), radius)
            label = spanning(len(fps), left, right)
            moved = np.flatnonzero(label != np.arange(len(fps)))
            if len(moved):
                yield pd.DataFrame({"u": fps[moved], "v": fps[label[moved]]})

    return blocked(nodes.select("fp"), tables_of(radius)).select("t", "key", "lo", "hi", "fp").mapInPandas(compare, "u long, v long")


def group(docs: DataFrame, width: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp, component_id) for every row: component_id is the smallest id reachable by links."""
    fps = cut(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("id").alias("first"))
    found = connected_components(links(classes, radius))
    rooted = classes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(labels, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# --- groups of similar texts ----------------------------------------------------------------------


def _group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    cols = [frame[k].to_numpy() for k in keys]
    return np.cumsum(np.concatenate([[0], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))


def _similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All i < j whose sets have a Jaccard similarity of at least similarity; exact, by incidence products."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    if n <= 12:
        shared = np.zeros((n, n))
        for i in range(n):
            for j in range(i + 1, n):
                if min(sizes[i], sizes[j]) >= similarity * max(sizes[i], sizes[j]):
                    shared[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = counts[inverse] > 1  # what only one text has is shared with none
        rank = np.cumsum(counts > 1) - 1
        row, col = np.repeat(np.arange(n), sizes.astype(np.int64))[common], rank[inverse[common]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        shared = np.zeros((n, n), np.float32)
        for at in range(0, int(rank[-1]) + 1 if len(rank) else 0, 8192):
            a, b = np.searchsorted(col, [at, at + 8192])
            incidence = np.zeros((n, 8192), np.float32)
            incidence[row[a:b], col[a:b] - at] = 1
            shared += incidence @ incidence.T
    union = sizes[:, None] + sizes[None, :] - shared
    return np.nonzero(np.triu((shared >= similarity * union) & (shared > 0), 1))


def similar_links(docs: DataFrame, classes: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(u, v): nodes of classes(node, fp, more, row) whose texts' shingle sets have a Jaccard similarity of at least similarity.

    Candidates share the bits of one table and their fingerprints differ in at most FIRST_RADIUS bits of the first word and WIDE_RADIUS in all; the texts of those, and only those, are read again and compared exactly.
    """
    k = key_bits(classes.count())
    places = tables_of_bits(k)
    keys, words = ["bucket", "lo", "hi"], [f"w{i}" for i in range(WORDS)]

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(buckets=list(keys_of(batch[words].to_numpy(np.int64), places)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            group_of, fps = _group_numbers(frame, keys), frame[words].to_numpy(np.int64).view(np.uint64)
            bucket, part = frame["bucket"].to_numpy(), np.full(len(frame), -1, np.int32)
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group_of)) + 1):
                if len(at) < 2:
                    continue
                left, right = close_pairs(fps[at, 0], FIRST_RADIUS)
                near = np.bitwise_count(fps[at[left], 1:] ^ fps[at[right], 1:]).sum(1) + np.bitwise_count(fps[at[left], 0] ^ fps[at[right], 0]) <= WIDE_RADIUS
                left, right = left[near], right[near]
                if not len(left):
                    continue
                # A pair counts in the first table in which it meets.
                some, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
                own, ends = keys_of(fps[at[some]], places), ends.reshape(2, -1)
                fresh = np.arange(len(left))
                for t in range(bucket[at[0]] >> k):
                    fresh = fresh[own[ends[0, fresh], t] != own[ends[1, fresh], t]]
                label = spanning(len(at), left[fresh], right[fresh])
                met = np.union1d(left[fresh], right[fresh])
                part[at[met]] = label[met]
            if (part >= 0).any():
                yield frame.loc[part >= 0, [*keys, "node"]].assign(part=part[part >= 0])

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique((shingle_hashes(t if isinstance(t, str) else None, width) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"node": batch["node"], "shingles": sets})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys, 256):
            group_of = _group_numbers(frame, keys)
            nodes, data = frame["node"].to_numpy(), frame["shingles"].tolist()
            for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(group_of)) + 1):
                left, right = _similar([np.frombuffer(data[i], np.uint32) for i in at], similarity)
                label = spanning(len(at), left, right)
                moved = np.flatnonzero(label != np.arange(len(at)))
                if len(moved):
                    yield pd.DataFrame({"u": nodes[at[moved]], "v": nodes[at[label[moved]]]})

    bound_batches(docs.sparkSession, 4096)
    rows = classes.select("node", *[(F.col("fp") if i == 0 else F.col("more")[i - 1]).alias(w) for i, w in enumerate(words)])
    # The empty set is like no other.
    keyed = rows.where(f"node != {EMPTY}").mapInPandas(buckets, f"node long, {', '.join(f'{w} long' for w in words)}, buckets array<int>").select(F.explode("buckets").alias("bucket"), "node", *words)
    large = cut(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "large")
    every = keyed.join(large, "bucket", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(0)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    met = every.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", *words).repartition(*keys).sortWithinPartitions(*keys)
    found = cut(met.mapInPandas(near, "bucket int, lo int, hi int, node long, part int"), "candidates")
    wanted = found.select("node").distinct().join(classes, "node").select("node", "row")
    maybe = maybe_in(wanted.select(F.col("row").alias("h")))
    texts = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).where(maybe("row"))
    sets = texts.join(wanted, "row").dropDuplicates(["node"]).select("node", "text").mapInPandas(shingles, "node long, shingles binary")
    keys = [*keys, "part"]
    return found.join(sets, "node").repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "shingles").mapInPandas(verify, "u long, v long")


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group: the one with the smallest id (rows without an id come last).

    Texts with equal sets of shingles, and texts linked by similar_links, are a group; texts that only share a
    fingerprint are compared like any others. Only rows that may go, and
    those that meet them in a Bloom filter, are shuffled; the rest stay where they are.
    """
    fps = cut(signatures(docs, width, id_col, text_col), "fingerprints")
    classes = fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("more").alias("more"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).select("node", "fp", "more", "first", F.col("first.row").alias("row"))
    classes = cut(classes, "classes")
    found = connected_components(similar_links(docs, classes, width, similarity, id_col, text_col))
    rooted = classes.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays")).select("root", F.col("stays.row").alias("stays"))
    fate = rooted.join(stays, "root").select("node", "stays")
    counted = fps.groupBy("node", "row").agg(F.count(F.lit(1)).alias("n")).join(fate, "node")
    touched = cut(counted.where("row != stays or n > 1").select(F.col("row").alias("touched"), (F.col("row") == F.col("stays")).alias("keep")).distinct(), "touched")
    maybe = maybe_in(touched.select(F.col("touched").alias("h")))
    keyed = docs.select(as_rows(docs).alias("doc"), row_key(quoted(id_col), quoted(text_col)).alias("key")).withColumn("maybe", maybe("key"))
    met = keyed.where("maybe").join(touched, F.col("key") == F.col("touched"), "left").where(F.coalesce("keep", F.lit(True))).dropDuplicates(["key"])
    return keyed.where("not maybe").select("doc").unionByName(met.select("doc")).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
