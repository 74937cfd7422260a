"""64-bit hashes of all words of a text, computed over whole byte arrays.

A word's hash is a polynomial over its bytes modulo 2**64, taken from running sums and scrambled.
Texts are hashed in segments that end between words, so memory does not grow with a text's length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 21
_random = np.random.default_rng(7)
BYTE_HASH = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_random.integers(0, 1 << 62)) * 4 + 3

#: Separators: ASCII white space; or every ASCII byte but letters and digits.
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment_hashes(data: bytes, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and the starts of the words of data."""
    raw = np.frombuffer(data, np.uint8)
    size = SEGMENT + 4096
    up, down = _powers(size if len(raw) <= size else 1 << len(raw).bit_length())
    apart = space[raw]
    edge = np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_HASH[raw] * up[: len(raw)], dtype=np.uint64)])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def hash_texts(texts: list[bytes], space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, one text after the other, and each text's number of words."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    held_from, size = 0, 0

    def flush(upto: int) -> None:
        nonlocal held, held_from, size
        if held:
            h, starts = segment_hashes(b"\n".join(held), space)
            ends = np.cumsum([len(t) + 1 for t in held])
            counts[held_from:upto] += np.diff(np.concatenate([[0], np.searchsorted(starts, ends)]))
            hashes.append(h)
        held, held_from, size = [], upto, 0

    for i, text in enumerate(texts):
        if size + len(text) >= SEGMENT:
            flush(i)
        if len(text) < SEGMENT:
            held.append(text)
            size += len(text) + 1
            continue
        at = 0
        while at < len(text):
            end = at + SEGMENT
            while end < len(text) and not space[text[end]]:
                end += 1
            h, _ = segment_hashes(text[at:end], space)
            hashes.append(h)
            counts[i] += len(h)
            at = end
        held_from = i + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts
