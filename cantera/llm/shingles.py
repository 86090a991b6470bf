"""Word shingles of whole texts as 64-bit hashes, computed over Arrow buffers.

Words are runs of characters outside U+0020 and U+0009 to U+000D, with A-Z lower-cased. A
text of at least ``k`` words has the set of its k-word shingles; a shorter one, if it has
words, its whole word sequence as one shingle; a null, empty or blank one, the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Bytes of text hashed at a time; one longer text is hashed alone.
CHUNK_BYTES = 1 << 18

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)], bool)
_BASE = np.uint64(0x9E6C63D0876A3F35)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the word offsets of the texts that ``bounds`` delimits."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edges] = solid[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    at = np.flatnonzero(solid)
    first = np.searchsorted(at, starts)
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    value = (_FOLD[data[at]].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, bounds)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK_BYTES."""
    if not len(texts):
        return
    values = texts.fill_null("") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(values.type) else np.int32
    offsets = np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(values):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order of rows."""
    odd = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for _, data, bounds in _chunks(texts):
        words, at = word_hashes(data, bounds)
        m = len(words) - k + 1
        rolled = mix(sum((words[j : j + m] * odd[j] for j in range(1, k)), words[:m] * odd[0])) if m > 0 else words[:0]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                short = (words[a:b] * odd[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short ^ np.uint64(0xA5A5A5A5)]))
            else:
                yield words[:0]
