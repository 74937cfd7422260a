"""A blocked Bloom filter of 64-bit hashes, of a bounded size.

The filter is cut into blocks of 512 bits, eight 64-bit words with one bit set in each; a hash touches one
block. It is built by tasks, merged by bit_or and never larger than MAX_BLOCKS blocks, however many
hashes there are: more of them make it less selective, not wrong. Whatever passes needs an exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of 64 bytes: at most 16 MB. Bits for each entry below that.
MAX_BLOCKS = 1 << 18
BITS_PER_HASH = 16
#: Odd multipliers that choose the bit in each word of a block.
SALTS = np.random.default_rng(10).integers(0, 1 << 31, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and its bit in each of the block's words."""
    h = hashes.astype(np.int64).view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    low = h & np.uint64(0xFFFFFFFF)
    bits = ((low[:, None] * SALTS[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(26)
    return block, np.uint64(1) << bits


def bloom_filter(keys: DataFrame) -> np.ndarray:
    """The filter of keys(h): blocks x 8 words."""
    blocks = int(min(MAX_BLOCKS, 1 + keys.count() * BITS_PER_HASH // 512))

    def part(batches):
        words = np.zeros((blocks, 8), np.uint64)
        for batch in batches:
            block, bits = _places(batch["h"].to_numpy(), blocks)
            np.bitwise_or.at(words, block, bits)
        at = np.flatnonzero(words)
        yield pd.DataFrame({"at": at, "word": words.reshape(-1)[at].view(np.int64)})

    merged = keys.mapInPandas(part, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    found = merged.toArrow()  # at most MAX_BLOCKS * 8 words, 16 bytes each, as columns
    words = np.zeros(blocks * 8, np.int64)
    words[found["at"].to_numpy()] = found["word"].to_numpy()
    return words.view(np.uint64).reshape(blocks, 8)


def maybe_in(keys: DataFrame):
    """A function of a long column: false where the hash is surely not in keys(h)."""
    shared = keys.sparkSession.sparkContext.broadcast(bloom_filter(keys))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        words = shared.value
        block, bits = _places(hashes.to_numpy(), len(words))
        return pd.Series(((words[block] & bits) == bits).all(1), dtype=bool)

    return maybe
