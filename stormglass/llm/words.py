"""Words of many documents at once, their hashes and those of runs of words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text and rows that are worked on together; one larger document stands alone.
TOGETHER_BYTES, TOGETHER_ROWS = 1 << 20, 1 << 12
#: Words up to this many bytes are hashed eight bytes a step, longer ones one by one.
SHORT = 32
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: What parts terms: ASCII but for digits and letters.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Masks that keep the first k of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@lru_cache(maxsize=2)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_hashes(h: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A hash of every run of `width` hashes, by prefix sums modulo 2^64."""
    n = len(h)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(16, (n + 1).bit_length()), base)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * down[:n], out=sums[1:])
    return mixed((sums[width:] - sums[: n + 1 - width]) * up[: n + 1 - width])


@dataclass
class Words:
    """The words of a portion of documents: where they begin and end in data, and how many each document has."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    n: np.ndarray

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        size = self.ends - self.starts
        h = size.astype(np.uint64) * np.uint64(BASES[1])
        eight = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        left = np.flatnonzero(size <= SHORT)
        for at in range(0, SHORT, 8):
            left = left[size[left] > at]
            if not len(left):
                break
            part = np.ascontiguousarray(eight[self.starts[left] + at]).view(np.uint64).reshape(-1)
            h[left] = mixed((h[left] ^ (part & _FIRST[np.minimum(size[left] - at, 8)])) * np.uint64(BASES[0]))
        for k in np.flatnonzero(size > SHORT).tolist():
            h[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return h

    def ranges(self) -> Iterator[tuple[int, int]]:
        """First word and the end of the words of each document."""
        ends = np.cumsum(self.n)
        return zip((ends - self.n).tolist(), ends.tolist(), strict=True)

    def at(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def words_of(texts: list[bytes], lower: bool = False, outside: np.ndarray = _WHITE) -> Words:
    """Words are runs of anything but ASCII white space, or but the bytes marked in outside; lower changes A-Z only."""
    data = np.frombuffer(b"".join([b" ", b" ".join(texts), b" " * 8]), np.uint8)
    if lower:
        data = _LOWER[data]
    edges = np.flatnonzero(np.diff(outside[data].view(np.int8))) + 1  # a word begins, a word ends, ...
    starts, ends = edges[::2], edges[1::2]
    begin = 1 + np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, starts, ends, np.diff(np.searchsorted(starts, begin)))


def gathered(batches: Iterator[pa.RecordBatch], lower: bool = False, outside: np.ndarray = _WHITE) -> Iterator[tuple[pa.Table, Words]]:
    """Rows of a task and the words of their texts (a binary column), in portions.

    A portion ends at TOGETHER_BYTES of text or TOGETHER_ROWS rows, whichever comes first, so
    neither empty texts nor texts without spaces pile up.
    """
    rows, texts, size = [], [], 0
    for batch in batches:
        start = 0
        for k, text in enumerate(batch.column("text")):
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= TOGETHER_BYTES or len(texts) >= TOGETHER_ROWS:
                rows.append(batch.slice(start, k + 1 - start))
                yield pa.Table.from_batches(rows), words_of(texts, lower, outside)
                rows, texts, size, start = [], [], 0, k + 1
        if start < batch.num_rows:
            rows.append(batch.slice(start))
    if rows:
        yield pa.Table.from_batches(rows), words_of(texts, lower, outside)
