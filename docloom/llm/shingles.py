"""Word-shingle hashes of Arrow text batches, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass works on; a longer document is a pass of its own.
PASS_BYTES = 2_000_000
_R = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table() -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * _R)
    table[65:91] = table[97:123]  # A-Z hash like a-z
    return table


_BYTES = _byte_table()
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = max(n, PASS_BYTES)
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _R))])
        _INVERSE = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, np.uint64(pow(int(_R), -1, 1 << 64))))])
    return _POWERS[:n], _INVERSE[:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end, and the first word of each text.

    data: bytes; bounds: where each text begins, and the end. A word's hash is a polynomial
    in its bytes, read from prefix sums, so that no Python runs per word.
    """
    solid = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], solid[:-1]])
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]])
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    power, inverse = _powers(len(data) + 1)
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * power[: len(data)], dtype=np.uint64)])
    hashes = mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, bounds)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (uint64), in row order.

    Fewer than ``size`` words: the whole sequence is one shingle; none: an empty array.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    with np.errstate(over="ignore"):
        while row < len(texts):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PASS_BYTES, "right")) - 1)
            last = min(last, len(texts))
            bounds = offsets[row : last + 1] - offsets[row]
            words, first = word_hashes(data[offsets[row] : offsets[last]], bounds)
            whole = np.zeros(max(0, len(words) - size + 1), np.uint64)
            for k in range(size):
                whole = whole * _R + words[k : k + len(whole)]
            whole = mix(whole)
            for a, b in zip(first[:-1], first[1:], strict=True):
                if b - a >= size:
                    yield np.unique(whole[a : b - size + 1])
                elif b > a:
                    h = np.uint64(b - a)
                    for w in words[a:b]:
                        h = mix(np.array([h * _R + w]))[0]
                    yield np.array([h], np.uint64)
                else:
                    yield np.zeros(0, np.uint64)
            row = last
