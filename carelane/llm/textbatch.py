"""Words of many texts at once: stable 64-bit hashes from the UTF-8 buffer of an Arrow string column."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled in one go (a longer text goes alone).
SLICE_BYTES = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: Longer words (in bytes) are hashed by a library function, one by one.
_LONG = 64
#: The first k bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: their length, then eight bytes at a time, mixed after each."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # from every byte on
    left, at = np.flatnonzero(size <= _LONG), 0
    while len(left):
        rest = size[left] - at
        out[left] = mix((out[left] ^ (eight[starts[left] + at] & _FIRST[np.minimum(rest, 8)])) + np.uint64(0xD6E8FEB86659FD93))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a slice of texts: hashes, byte starts and ends in ``data``, and ``at``: first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = True):
        self.data, self.offsets = data, offsets
        n = len(data)
        word = ~_SEPARATOR[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = True
            before[1:] = ~word[:-1]
        self.starts = np.flatnonzero(word & (before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1] = True
            after[:-1] = ~word[1:]
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1
        self.hashes = word_hashes(_FOLD[data] if fold else data, self.starts, self.ends)
        self.at = np.searchsorted(self.starts, offsets)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on (those that cross into the next text are to be ignored)."""
        h = self.hashes
        m = len(h) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        x = h[:m].copy()
        for j in range(1, k):
            x *= np.uint64(0xD6E8FEB86659FD93)
            x += h[j : j + m]
        return mix(x)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes; null texts are empty."""
    if pa.types.is_large_string(texts.type) or pa.types.is_string(texts.type):
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    else:
        raise TypeError(f"texts must be strings, not {texts.type}")
    if not len(texts):
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
