"""Words, their 64-bit hashes and hashes of word sequences, for whole Arrow batches at a time.

A word is a longest run of letters and digits (Unicode categories L and N), in lower case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

WORD = re.compile(r"[^\W_]+")
#: The same on the JVM.
JVM_WORD = r"[\p{L}\p{N}]+"
_MEMO_LIMIT = 1_000_000
#: Odd multipliers of the sequence hashes (any odd 64-bit numbers do).
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 | 1 for i in range(64)], dtype=np.uint64)


class _Memo(dict):
    def __missing__(self, w: str) -> int:
        if len(self) >= _MEMO_LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_MEMO = _Memo()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ``rows`` rows, fewer where rows are long, so that a worker's memory doesn't follow the batches' size."""
    for b in batches:
        n = max(1, min(rows, b.num_rows * size // max(b.nbytes, 1)))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)


def words(text: str | None) -> list[str]:
    """The words of a text; none of a null."""
    if not text:
        return []
    if "İ" in text:  # the one letter whose lower case holds a mark, which would cut the word
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, one text after another, and the offsets at which texts begin (one more than texts)."""
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=offsets[1:])
    hashes = np.fromiter(map(_MEMO.__getitem__, chain.from_iterable(texts)), dtype=np.uint64, count=int(offsets[-1]))
    return hashes, offsets


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """For each position, the hash of the words at ``position + m`` for ``m`` in ``mask``; positions whose window would pass the end are left out."""
    n = len(hashes) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[mask[0] : mask[0] + n] * _ODD[0]
    for k, m in enumerate(mask[1:], 1):
        out += hashes[m : m + n] * _ODD[k]
    return mix(out)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The index of the text of every word."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))


def whole_windows(offsets: np.ndarray, span: int) -> np.ndarray:
    """The positions at which a window of ``span`` words lies inside one text, in ascending order."""
    counts = np.maximum(np.diff(offsets) - span + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(offsets[:-1] - (ends - counts), counts)


def shingles(texts: list[list[str]], size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word sequences of ``size`` of every text (repeated ones repeat) and the offsets of the texts among them."""
    hashes, offsets = word_hashes(texts)
    at = whole_windows(offsets, size)
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=out[1:])
    return window_hashes(hashes, tuple(range(size)))[at], out
