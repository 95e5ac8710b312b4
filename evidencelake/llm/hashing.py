"""Vectorised word hashing over Arrow batches: whole texts as bytes, many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants, the same in every process: nothing depends on which module was imported first."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


BYTE_HASH = odd(256, 1)
for _c in range(65, 91):  # A-Z hash as a-z
    BYTE_HASH[_c] = BYTE_HASH[_c + 32]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters and the bytes of other letters separates here.
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[128:] = False
NOT_LETTER[65:91] = NOT_LETTER[97:123] = False


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse, as far as a slice needs them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _BASE), np.full(n, _INVERSE)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up, self.down


class Slice(NamedTuple):
    data: np.ndarray  # bytes of the slice's texts, one after another
    offsets: np.ndarray  # of the texts, one more than there are
    word: np.ndarray  # hash of each word
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # of each text's words, one more than there are texts
    sums: np.ndarray  # prefix sums of the bytes' hashes

    def span(self, starts: np.ndarray, length: int, powers: Powers) -> np.ndarray:
        """Hashes of the `length` bytes from each start on."""
        return mix((self.sums[starts + length] - self.sums[starts]) * powers.down[starts] + np.uint64(1_000_003 * length))


def slices(texts: pa.Array, powers: Powers, separator: np.ndarray = WHITE) -> Iterator[Slice]:
    """The texts in slices, with the words of each. Null is as an empty text."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield _slice(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], powers, separator)
        first = last


def _slice(data: np.ndarray, offsets: np.ndarray, powers: Powers, separator: np.ndarray) -> Slice:
    up, down = powers.upto(len(data) + 1)
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Slice(data, offsets, word, starts, ends, np.searchsorted(starts, offsets), sums)


def word_hash(words: list[str]) -> np.ndarray:
    """Hashes of single words, as slices() gives them."""
    return np.concatenate([s.word for s in slices(pa.array(words, pa.large_string()), Powers(), np.zeros(256, bool))])
