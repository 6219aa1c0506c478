"""Word and shingle hashes of whole Arrow columns of text.

A word is a longest run of ASCII letters, digits, underscores and non-ASCII characters of the
lower-cased text. A shingle is `SIZE` words in a row; a text of fewer words has one shingle of
all of them, a text without words has none. Hashes have 64 bits and depend on nothing but the
words, so they are the same in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corepart.llm.kept import kept

SIZE = 5
SLICE = 1 << 20  # bytes of text hashed at once
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64))
WEIGHTS = mix(np.arange(1001, 1001 + SIZE, dtype=np.uint64)) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""

    def make() -> tuple[np.ndarray, np.ndarray]:
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        return out[0], out[1]

    return kept(("powers", n), make)


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the lower-cased texts in a row, and where each begins; null is empty."""
    texts = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and the number of the first word of each text."""
    hashes, starts = [], []
    at, end = 0, len(data)
    while at < end:
        size = SLICE
        while True:
            to = min(at + size, end)
            word = WORD[data[at:to]]
            inner = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, to, "left")] - at
            if to == end:
                break
            free = np.flatnonzero(~word)  # cut where no word goes across
            cut = max(int(free[-1]) + 1 if len(free) else 0, int(inner[-1]) if len(inner) else 0)
            if cut:
                to, word, inner = at + cut, word[:cut], inner[inner <= cut]
                break
            size *= 2
        edge = np.zeros(len(word) + 1, bool)
        edge[0] = edge[-1] = True
        edge[inner] = True
        before = np.append(False, word[:-1])
        begin = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.append(word[1:], False)
        stop = np.flatnonzero(word & (~after | edge[1:])) + 1
        if len(begin):
            power, inverse = _powers(1 << max(20, (len(word) - 1).bit_length()))
            sums = np.zeros(len(word) + 1, np.uint64)
            np.cumsum(BYTE[data[at:to]] * power[: len(word)], out=sums[1:])
            hashes.append(mix((sums[stop] - sums[begin]) * inverse[begin] + (stop - begin).astype(np.uint64)))
            starts.append(begin + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle in order, and the number of the first shingle of each text."""
    n = len(first) - 1
    count = np.diff(first)
    total = np.where(count >= SIZE, count - SIZE + 1, (count > 0).astype(np.int64))
    offsets = np.append(0, np.cumsum(total))
    out = np.zeros(int(offsets[-1]), np.uint64)
    if len(words) >= SIZE:
        full = len(words) - SIZE + 1
        sums = np.zeros(full, np.uint64)
        for j in range(SIZE):
            sums += words[j : j + full] * WEIGHTS[j]
        left = np.repeat(first[1:], count) - np.arange(len(words))  # words from here to the text's end
        out[np.repeat(count >= SIZE, total)] = sums[(left >= SIZE)[:full]]
    for i in np.flatnonzero((count > 0) & (count < SIZE)):
        own = words[first[i] : first[i + 1]]
        out[offsets[i]] = (own * WEIGHTS[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    assert n == len(offsets) - 1
    return mix(out), offsets


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, shingle hashes, offsets) for runs of texts of about SLICE bytes."""
    data, offsets = lowered(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        own = offsets[lo : hi + 1]
        yield lo, hi, *shingle_hashes(*word_hashes(data[own[0] : own[-1]], own - own[0]))
        lo = hi
