"""Evaluation passages inside training texts, by spaced-seed hashing.

Fixed masks read some positions of a window of words and ignore the others. The hashes that the masks give for
all windows of the evaluation items are joined with those of all windows of the documents, and around every hit
the two texts are laid over each other: words that were substituted don't break an overlap. Of any overlap of RUN
words or more with 3 of 4 equal, wherever the others stand, at least one mask reads equal words only, so none is
lost. An exact run leaves every mask whole; it is told from other overlaps where the texts are laid over each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.llm.shards import load, write_shards
from runeloom.llm.words import slices, whole_windows, window_hashes, word_hashes, words
from runeloom.work import spread

#: Words in a row that make a leak.
RUN = 12
#: The positions that count. An overlap of RUN words or more with 3 of 4 equal has a part of 12 to 23 words with as many, and each pattern of
#: substitutions in such a part leaves one of these masks whole somewhere in it (test_masks_meet_every_overlap goes through all patterns).
MASKS = ((0, 1, 3, 4, 5), (0, 1, 2, 7, 9), (0, 4, 5, 6, 7), (0, 1, 2, 4, 8))
#: Characters of evaluation items that one index is made of (about 60 MB); more items are taken in blocks of this size.
BLOCK_CHARS = 8_000_000
_BITS = 22
#: Words laid over each other at a time.
_CELLS = 1 << 21


def build(items: list[tuple[int, str | None]]) -> dict[str, np.ndarray]:
    """The hashed windows of one block of items, as arrays: for each mask its hashes in order, where they come from, and a bitmap.
    An item gives a window for every place at which a mask fits; one too short for all masks is read whole."""
    split = [words(t) for _, t in items]
    word, offsets = word_hashes(split)
    lengths = np.diff(offsets)
    out = {"ids": np.array([i for i, _ in items], dtype=np.int64), "words": word, "offsets": offsets, "need": np.minimum(lengths, RUN)}
    whole = [tuple(range(n)) for n in range(1, min(m[-1] for m in MASKS) + 1)]
    for k, mask in enumerate((*MASKS, *whole)):
        at = whole_windows(offsets, mask[-1] + 1)
        item = np.searchsorted(offsets, at, side="right") - 1
        if k >= len(MASKS):
            at, item = (x[lengths[item] == len(mask)] for x in (at, item))
        if not len(at):
            continue
        h = window_hashes(word, mask)[at]
        order = np.argsort(h, kind="stable")
        h, at, item = h[order], at[order], item[order]
        bits = np.zeros(1 << _BITS, dtype=bool)
        bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        out |= {f"{k} mask": np.array(mask), f"{k} hash": h, f"{k} at": at, f"{k} item": item, f"{k} bits": np.packbits(bits, bitorder="little")}
    return out


def _parts(n: np.ndarray) -> Iterator[slice]:
    """Slices of ``n``, one after another, each of about _CELLS in sum."""
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, side="right")))
        yield slice(at, to)
        at = to


class Index:
    """The hashed windows of one block of items."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.ids, self.words, self.offsets, self.need = (arrays[k] for k in ("ids", "words", "offsets", "need"))
        numbers = sorted({int(k.split()[0]) for k in arrays if k.endswith(" mask")})
        self.tables = [(tuple(arrays[f"{k} mask"].tolist()), *(arrays[f"{k} {x}"] for x in ("hash", "at", "item", "bits"))) for k in numbers]

    def hits(self, doc: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in the documents' words, item, position in the items' words) of equal hashes, mask by mask, about _CELLS at a time."""
        for mask, h, at, item, bits in self.tables:
            h_doc = window_hashes(doc, mask)
            bit = (h_doc >> np.uint64(64 - _BITS)).astype(np.int64)
            may = np.flatnonzero((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
            lo, hi = np.searchsorted(h, h_doc[may], side="left"), np.searchsorted(h, h_doc[may], side="right")
            n = hi - lo
            some = n > 0
            may, lo, n = may[some], lo[some], n[some]
            inside = np.searchsorted(offsets, may, side="right") == np.searchsorted(offsets, may + mask[-1], side="right")
            may, lo, n = may[inside], lo[inside], n[inside]
            for part in _parts(n):
                m = n[part]
                pick = np.repeat(lo[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.repeat(may[part], m), item[pick], at[pick]


def _runs(equal: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of texts laid over each other, one pair after another from ``starts`` on: longest run of equal words; and of the stretch
    with the best score (+1 an equal word, -2 a substituted one) its length and its equal words."""
    n, pairs = len(equal), len(starts)
    length = np.diff(starts, append=n)
    own = np.repeat(np.arange(pairs), length)
    k = np.arange(n)
    broken = np.maximum.accumulate(np.where(equal, -1, k))
    run = np.maximum.reduceat(k - np.maximum(broken, starts[own] - 1), starts)
    total = np.cumsum(np.where(equal, 1, -2))
    before = total - np.where(equal, 1, -2)  # the score up to each word, and with it
    # the lowest score before any word of the same pair: every pair lies below all that come before it
    drop = own * (3 * n + 1)
    low = np.minimum.accumulate(before - drop) + drop
    best = np.maximum.reduceat(total - low, starts)
    end = np.minimum.reduceat(np.where(total - low == best[own], k, n), starts)
    start = np.minimum.reduceat(np.where(before == low[end][own], k, n), starts)
    some = best > 0
    ones = np.concatenate([[0], np.cumsum(equal)])
    return run, np.where(some, end + 1 - start, 0), np.where(some, ones[end + 1] - ones[start], 0)


def _laid(x: np.ndarray, x_from: np.ndarray, y: np.ndarray, y_from: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """The runs, spans and equal words of every pair of stretches of ``x`` and ``y``, in their order, about _CELLS words at a time."""
    for part in _parts(length):
        n = length[part]
        starts = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(starts, n)
        yield np.stack(_runs(x[k + np.repeat(x_from[part], n)] == y[k + np.repeat(y_from[part], n)], starts))


def _search(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = load(path, block, Index)
        if ix is None:  # no item fell into the block
            return
        for b in slices(batches):
            doc, offsets = word_hashes([words(t) for t in b.column(1).to_pylist()])
            seen: dict[tuple[int, int], list[int]] = {}
            # one look at each overlay of a document and an item, however many masks and windows hit; (document, item, shift) as one number,
            # which fits: a slice is one document or 2,000 with 8 MB of text, and the items are those of one block
            found, shifts = [], len(doc) + len(ix.words)
            for p, t, q in ix.hits(doc, offsets):
                d = np.searchsorted(offsets, p, side="right") - 1
                found.append(np.unique((d * len(ix.ids) + t) * shifts + (p - offsets[d]) - (q - ix.offsets[t]) + len(ix.words)))
            if found:
                texts, shift = np.divmod(np.unique(np.concatenate(found)), shifts)
                i, t = np.divmod(texts, len(ix.ids))
                shift -= len(ix.words)
                lo = np.maximum(0, shift)
                length = np.minimum(np.diff(offsets)[i], np.diff(ix.offsets)[t] + shift) - lo
                laid = np.concatenate(list(_laid(doc, offsets[i] + lo, ix.words, ix.offsets[t] + lo - shift, length)), axis=1)
                for pair, (run, span, equal) in zip(zip(i.tolist(), t.tolist()), laid.T.tolist()):
                    # span and equal are those of one overlay: one with 3 of 4 equal in RUN words or more if there is any, then by equal words, then by score
                    best = seen.setdefault(pair, [0, 0, 0])
                    rank = [(n >= RUN and e * 4 >= n * 3, e, -n) for n, e in (best[1:], (span, equal))]
                    best[:] = [max(best[0], run), *(best[1:] if rank[0] >= rank[1] else (span, equal))]
            ids = b.column(0).to_pylist()
            cols = [[ids[i] for i, _ in seen], [int(ix.ids[t]) for _, t in seen], *([v[k] for v in seen.values()] for k in range(3)), [int(ix.need[t]) for _, t in seen]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "item", "run", "span", "equal", "need"])

    return run


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(doc, item, run, span, equal, need): each document and item with a seed hit: the longest run of equal words, the length of the best
    single overlap with substitutions and the equal words in it, and the run that makes a leak (RUN words, or all of a shorter item).

    Null and empty texts hold nothing and leak nothing. Items are the stated query set: their index is built from blocks of at most about
    BLOCK_CHARS characters by executors, kept in the shared folder and loaded by the workers, one at a time; every document meets all in turn; documents are never shuffled. A row is made for each document row, so repeated ids give repeated rows."""
    it = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    chars = it.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS) or 1
    path = write_shards(it.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("shard"), "i", "t"), blocks, lambda rows: build([(r["i"], r["t"]) for r in rows]), "items")
    src = spread(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(doc_text).alias("text")))
    found = [src.mapInArrow(_search(path, k), "doc bigint, item bigint, run bigint, span bigint, equal bigint, need bigint") for k in range(blocks)]
    return reduce(DataFrame.unionByName, found)
