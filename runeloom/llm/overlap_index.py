"""Records of one split that are, exactly or nearly, in another: a compressed full-text index of the evaluation texts.

The evaluation texts (distinct ones) are put into shards of up to SHARD_WORDS words by their number of distinct word
sequences, which alike texts have nearly in common. A shard's texts are laid end to end as word numbers; their
suffixes, in the order of the first CONTEXT words, give the Burrows-Wheeler transform, which is kept as the sorted
rows of every word, and the place of every row.

No training text passes a shard that can't hold it. Seeds of SEED words, from every STRIDE-th word of a training text
(every word in short ones), meet the seeds of the evaluation texts in one join; a seed of an evaluation text tells the
shards it occurs in and the sizes of the texts that hold it there. A training text then goes to those shards with
which it shares a seed of a text of fitting size, so the work follows the words of both sides and not their product.

In a shard, a training text is streamed through backward search over its seeds. Hits on one diagonal are joined and
extended word by word in both directions to maximal matches, which are merged into spans and counted. A shared run of
SEED + STRIDE - 1 words is always found. Every pair with a match is compared exactly, by its sets of word sequences:
how much the spans cover says nothing of the sets where texts repeat themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeloom.llm.shards import load, write_shards
from runeloom.llm.verify import asked_only, long_texts
from runeloom.llm.words import slices, whole_windows, window_hashes, word_hashes, words
from runeloom.work import materialize, spread

CONTEXT, SEED, STRIDE = 8, 6, 3
#: Texts of fewer words are searched from every word.
SHORT = 20
#: Words of one shard of the index: about 70 MB in a worker.
SHARD_WORDS = 4_000_000
#: Training texts that one task streams through a shard.
CHUNK = 20_000
#: Sizes (distinct word sequences) fall into classes, each RATIO times as large as the one before; the last is open.
RATIO, SIZES = 1.2, 56
#: Pairs with a match that are compared at a time.
_PAIRS = 4096
#: Bits of a seed's hash that the join compares; a chance meeting only sends a text to a shard in vain.
_SEED_BITS = 44


def class_of(split: list[str], field: int, fields: int) -> int:
    """A hash of the words in their order: copies in whatever format are one class; the rest of its division by ``fields`` is the field."""
    return (xxhash.xxh3_64_intdigest(" ".join(split)) >> 1) // fields * fields + field


def distinct_sequences(hashes: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The number of distinct word sequences of every text."""
    at = whole_windows(offsets, size)
    if not len(at):
        return np.zeros(len(offsets) - 1, np.int64)
    own = np.searchsorted(offsets, at, side="right") - 1
    order = np.lexsort((h := window_hashes(hashes, tuple(range(size)))[at], own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return np.bincount(own[new], minlength=len(offsets) - 1)


def seed_places(offsets: np.ndarray) -> np.ndarray:
    """The positions from which streamed texts are searched."""
    at = whole_windows(offsets, SEED)
    own = np.searchsorted(offsets, at, side="right") - 1
    local, length = at - offsets[own], np.diff(offsets)[own]
    return at[(local % STRIDE == 0) | (length < SHORT) | (local + SEED == length)]


def _texts(b: pa.RecordBatch, first: int, fields: int, least: int) -> Iterator[tuple[list[int], list[int], list[list[str]]]]:
    """Field by field: the keys, classes and words of the texts of a batch that have ``least`` words."""
    ids = b.column(0).to_pylist()
    for f in range(fields):
        rows = [(i * fields + f, w) for i, t in zip(ids, b.column(first + f).to_pylist()) if len(w := words(t)) >= least]
        yield [k for k, _ in rows], [class_of(w, f, fields) for _, w in rows], [w for _, w in rows]


def _members(least: int, fields: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            role = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            for keys, classes, split in _texts(b, 2, fields, least):
                hashes, offsets = word_hashes(split)
                cols = (keys, classes, np.diff(offsets), distinct_sequences(hashes, offsets, size))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([role[k // fields] for k in keys], pa.bool_())], names=["key", "cls", "n", "size", "held"])

    return run


def _fresh(classes: list[int], seen: set[int]) -> list[int]:
    """The places of the classes that weren't seen yet."""
    if len(seen) > 1_000_000:
        seen.clear()
    out = []
    for i, c in enumerate(classes):
        if c not in seen:
            seen.add(c)
            out.append(i)
    return out


def _train_seeds(least: int, fields: int, size: int):
    """(seed, key, size class, number of seeds) of the distinct seeds of the texts of each class that a task meets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            for keys, classes, split in _texts(b, 1, fields, least):
                new = _fresh(classes, seen)
                hashes, offsets = word_hashes([split[i] for i in new])
                at = seed_places(offsets)
                if len(at):
                    own = np.searchsorted(offsets, at, side="right") - 1
                    seed = (window_hashes(hashes, tuple(range(SEED)))[at] >> np.uint64(64 - _SEED_BITS)).astype(np.int64)
                    order = np.lexsort((seed, own))
                    own, seed = own[order], seed[order]
                    once = np.ones(len(own), bool)
                    once[1:] = (own[1:] != own[:-1]) | (seed[1:] != seed[:-1])
                    own, seed = own[once], seed[once]
                    of, n = size_class(distinct_sequences(hashes, offsets, size)), np.bincount(own, minlength=len(new)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(seed), pa.array(np.array([keys[i] for i in new], np.int64)[own]), pa.array(of[own]), pa.array(n[own])], names=["seed", "key", "size", "seeds"])

    return run


def least_share(size: int, threshold: tuple[int, int]) -> float:
    """The share of a text's seeds that one alike with it holds at least, if it is made of runs of the text. Texts of n sequences with the share t in common have x = 2t / (1 + t)
    of them in common; each run of w words holds w - size + 1 of them, so there are at most (1 - x) n / (size - 1) runs, and a run holds (w - SEED - STRIDE + 2) / STRIDE of n / STRIDE seeds or more. Texts of unequal size share more."""
    t = threshold[0] / threshold[1]
    x = 2 * t / (1 + t)
    return max(0.0, x - (1 - x) / max(size - 1, 1) * max(SEED + STRIDE - size - 1, 0))


def size_class(sizes: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log(np.maximum(sizes, 1)) / math.log(RATIO)), SIZES - 1).astype(np.int32)


def _held_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, shard, sizes as bits) of indexed texts."""
    for b in slices(batches):
        hashes, offsets = word_hashes([words(t) for t in b.column("text").to_pylist()])
        at = whole_windows(offsets, SEED)
        if len(at):
            own = np.searchsorted(offsets, at, side="right") - 1
            seed = (window_hashes(hashes, tuple(range(SEED)))[at] >> np.uint64(64 - _SEED_BITS)).astype(np.int64)
            shard, bits = b.column("shard").to_numpy()[own], np.left_shift(np.int64(1), b.column("size").to_numpy().astype(np.int64))[own]
            order = np.lexsort((bits, shard, seed))
            seed, shard, bits = seed[order], shard[order], bits[order]
            new = np.ones(len(seed), bool)
            new[1:] = (seed[1:] != seed[:-1]) | (shard[1:] != shard[:-1]) | (bits[1:] != bits[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(seed[new]), pa.array(shard[new]), pa.array(bits[new])], names=["seed", "shard", "sizes"])


def build(texts: list[str]) -> dict[str, np.ndarray]:
    """The index of a shard's texts, in their order. Word 0 ends every text; no search contains it."""
    texts = texts or [""]
    parts = [word_hashes([words(t) for t in texts[i : i + 1000]]) for i in range(0, len(texts), 1000)]
    hashes = np.concatenate([h for h, _ in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))])
    del parts
    vocabulary = np.unique(hashes)
    n = len(hashes) + len(texts)
    text = np.zeros(n, dtype=np.int32)
    starts = offsets[:-1] + np.arange(len(texts))  # each text is followed by a 0
    text[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), np.diff(offsets))] = np.searchsorted(vocabulary, hashes) + 1
    rank, k = text, 1
    while True:  # after a round, rows are in the order of their first 2k words
        key = rank.astype(np.int64)
        key *= int(rank.max()) + 2
        key[: n - k] += rank[k:]
        key[: n - k] += 1
        order = np.argsort(key, kind="stable")
        if 2 * k >= CONTEXT:
            order = order.astype(np.int32)
            break
        key = key[order]
        rank = np.empty(n, dtype=np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)])
        k *= 2
    del rank, key
    occ = text[order - 1].astype(np.int64)  # the word before each suffix; the first text is preceded by the last 0
    occ *= n + 1
    occ += np.arange(n)
    occ.sort()
    occ = (occ % (n + 1)).astype(np.int32)  # the words that they belong to are told by ``first``
    seeds = window_hashes(hashes, tuple(range(SEED)))[whole_windows(offsets, SEED)] if len(hashes) >= SEED else np.zeros(0, np.uint64)
    log = max(16, (16 * n).bit_length())
    bits = np.zeros(1 << (log - 3), dtype=np.uint8)
    bit = (seeds >> np.uint64(64 - log)).astype(np.int64)
    np.bitwise_or.at(bits, bit >> 3, np.left_shift(np.uint8(1), (bit & 7).astype(np.uint8)))
    counts = np.bincount(text, minlength=len(vocabulary) + 1)
    return {"vocabulary": vocabulary, "first": np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), "occ": occ, "place": order, "starts": starts.astype(np.int64), "bits": bits}


class Searcher:
    """Backward search, for many positions at once."""

    def __init__(self, index: dict[str, np.ndarray]):
        self.__dict__.update(index)
        self.n1 = len(self.occ) + 1
        self.log = len(self.bits).bit_length() + 2
        word = np.repeat(np.arange(len(self.first) - 1, dtype=np.int32), np.diff(self.first))
        self.occ = self.occ + word.astype(np.int64) * self.n1
        self.text = np.empty(len(self.place), dtype=np.int32)  # rows are in the order of their first words
        self.text[self.place] = word
        self.ends = np.append(self.starts, len(self.text))[1:] - 1

    def words_at(self, places: np.ndarray) -> np.ndarray:
        """Hashes of the indexed words at some places."""
        return self.vocabulary[self.text[places] - 1]

    def words_of(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of some texts of the index, and the offsets at which texts begin."""
        length = self.ends[docs] - self.starts[docs]
        offsets = np.concatenate([[0], np.cumsum(length)])
        return self.words_at(np.arange(offsets[-1]) + np.repeat(self.starts[docs] - offsets[:-1], length)), offsets

    def hits(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in the streamed words, text of the index, diagonal) for every occurrence of the searched seeds."""
        at = seed_places(offsets)
        if not len(at):
            return at, at, at
        h = window_hashes(hashes, tuple(range(SEED)))[at]
        bit = (h >> np.uint64(64 - self.log)).astype(np.int64)
        at = at[((self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool)]
        window = hashes[at[:, None] + np.arange(SEED)]
        number = np.minimum(np.searchsorted(self.vocabulary, window), len(self.vocabulary) - 1)
        known = (self.vocabulary[number] == window).all(axis=1) if len(self.vocabulary) else np.zeros(len(at), bool)
        at, number = at[known], number[known] + 1
        lo, hi = self.first[number[:, -1]], self.first[number[:, -1] + 1]
        for k in range(SEED - 2, -1, -1):
            c = number[:, k]
            lo, hi = np.searchsorted(self.occ, c * self.n1 + lo), np.searchsorted(self.occ, c * self.n1 + hi)
            if not (alive := lo < hi).all():
                at, number, lo, hi = at[alive], number[alive], lo[alive], hi[alive]
        n = hi - lo
        place = self.place[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
        at = np.repeat(at, n)
        return at, np.searchsorted(self.starts, place, side="right") - 1, place - at

    def matches(self, hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(streamed text, text of the index, first word, end) of every maximal match that holds a hit, in order; positions are those of the streamed words."""
        at, doc, diagonal = self.hits(hashes, offsets)
        own = np.searchsorted(offsets, at, side="right") - 1
        order = np.lexsort((at, diagonal, doc, own))
        at, doc, own, diagonal = at[order], doc[order], own[order], diagonal[order]
        new = np.ones(len(at), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] - at[:-1] > SEED)
        first = np.flatnonzero(new)
        if not len(first):
            return own, doc, at, at
        own, doc, diagonal, lo = own[first], doc[first], diagonal[first], at[first].copy()
        hi = at[np.append(first[1:], len(at)) - 1] + SEED
        least, most = np.maximum(offsets[own], self.starts[doc] - diagonal), np.minimum(offsets[own + 1], self.ends[doc] - diagonal)
        grow = np.flatnonzero(lo > least)
        while len(grow):
            grow = grow[hashes[lo[grow] - 1] == self.words_at(lo[grow] - 1 + diagonal[grow])]
            lo[grow] -= 1
            grow = grow[lo[grow] > least[grow]]
        grow = np.flatnonzero(hi < most)
        while len(grow):
            grow = grow[hashes[hi[grow]] == self.words_at(hi[grow] + diagonal[grow])]
            hi[grow] += 1
            grow = grow[hi[grow] < most[grow]]
        order = np.lexsort((hi, lo, doc, own))
        own, doc, lo, hi = own[order], doc[order], lo[order], hi[order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        return own[new], doc[new], lo[new], hi[new]


def merged(own: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(streamed text, text of the index, words covered, spans) of every pair: matches that overlap or touch are one span."""
    if not len(own):
        return own, doc, lo, hi
    pair = np.ones(len(own), bool)
    pair[1:] = (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(pair)
    shift = (np.cumsum(pair) - 1) * (int(hi.max()) + 2)
    far = np.maximum.accumulate(hi + shift)
    before = np.concatenate([[-1], far[:-1]])
    covered = np.maximum(hi + shift - np.maximum(lo + shift, before), 0)
    return own[first], doc[first], np.add.reduceat(covered, first), np.add.reduceat((lo + shift > before).astype(np.int64), first)


def _sets(hashes: np.ndarray, offsets: np.ndarray, size: int) -> list[set[int]]:
    """The set of word sequences of every text."""
    windows, offsets = window_hashes(hashes, tuple(range(size))).tolist(), offsets.tolist()
    return [set(windows[i : max(i, j - size + 1)]) for i, j in zip(offsets, offsets[1:])]


def _common(searcher: Searcher, hashes: np.ndarray, offsets: np.ndarray, own: np.ndarray, doc: np.ndarray, size: int, threshold: tuple[int, int]) -> np.ndarray:
    """The word sequences that each pair of a streamed text and a text of the index shares, and those that either has; zeros for pairs with less than ``threshold`` in common."""
    num, den = threshold
    out = np.zeros((2, len(own)), np.int64)
    for at in range(0, len(own), _PAIRS):
        mine, a = np.unique(own[at : at + _PAIRS], return_inverse=True)
        held, b = np.unique(doc[at : at + _PAIRS], return_inverse=True)
        streamed = [_sets(hashes[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]), size)[0] for i in mine]
        indexed = _sets(*searcher.words_of(held), size)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist()), at):
            s, t = streamed[i], indexed[j]
            if min(len(s), len(t)) * den >= num * max(len(s), len(t)):
                both = len(s & t)
                either = len(s) + len(t) - both
                if both and both * den >= num * either:
                    out[:, k] = both, either
    return out


def _build(rows: list[dict]) -> dict[str, np.ndarray]:
    classes = np.array([r["cls"] for r in rows], dtype=np.int64)
    texts = [r["text"] for r in rows]
    rows.clear()
    return build(texts) | {"classes": classes}


def _searcher(arrays: dict[str, np.ndarray]) -> tuple[Searcher, np.ndarray]:
    return Searcher({k: v for k, v in arrays.items() if k != "classes"}), arrays["classes"]


_PAIR = "cls bigint, other bigint, covered bigint, spans bigint, shared bigint, either bigint"


def _stream(path: str, fields: int, size: int, threshold: tuple[int, int]):
    """Texts (shard, key, text) against the index of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches):
            shards = b.column("shard").to_numpy()
            for k in np.unique(shards).tolist():
                searcher, classes = load(path, k, _searcher)
                rows = b.take(pa.array(np.flatnonzero(shards == k)))
                split = [words(t) for t in rows.column("text").to_pylist()]
                mine = [class_of(w, key % fields, fields) for key, w in zip(rows.column("key").to_pylist(), split)]
                new = _fresh([c * 65537 + k for c in mine], seen)
                split, mine = [split[i] for i in new], np.array([mine[i] for i in new], np.int64)
                hashes, offsets = word_hashes(split)
                own, doc, covered, spans = merged(*searcher.matches(hashes, offsets))
                same = mine[own] % fields == classes[doc] % fields
                own, doc, covered, spans = own[same], doc[same], covered[same], spans[same]
                both, either = _common(searcher, hashes, offsets, own, doc, size, threshold)
                good = both > 0
                cols = (mine[own], classes[doc], covered, spans, both, either)
                yield pa.RecordBatch.from_arrays([pa.array(c[good], pa.int64()) for c in cols], names=["cls", "other", "covered", "spans", "shared", "either"])

    return run


def _shards(classes: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """For every size class the first of its shards and their number, and the number of all shards. Neighbouring classes share a shard while it has room; only
    the words of the SIZES classes are looked at."""
    total = {r.size: r.n for r in classes.groupBy("size").agg(F.sum(F.col("n") + 1).alias("n")).collect()}
    out, shard, held = [], 0, 0
    for s in range(SIZES):
        n = total.get(s, 0)
        if held and held + n > SHARD_WORDS:
            shard, held = shard + 1, 0
        parts = -(-n // SHARD_WORDS) or 1
        out.append((shard, parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + n)
    return out, shard + (held > 0)


def overlaps(df: DataFrame, id_col: str, fields: list[str], is_eval: Column, is_train: Column, size: int = 5, least_words: int = 8, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """(train, eval, field, covered, spans, shared, either): each pair of a training record and an evaluation record, field by field, that are alike:
    their sets of ``size``-word sequences have ``threshold`` in common. ``covered`` words of the training text lie in ``spans`` matched spans.

    Nulls, blank and short texts match nothing, nor do rows with a null id or in neither split. Copies are searched once a task and compared
    once in all; every one of them is in the result, which the pairs of copies make as large as it is."""
    c = overlap_classes(df, id_col, fields, is_eval, is_train, size, least_words, threshold)
    n, (pairs, members) = len(fields), c
    out = pairs.join(members.where("not held").select("cls", F.col("key").alias("train")), "cls").join(members.where("held").select(F.col("cls").alias("other"), F.col("key").alias("eval")), "other")
    return out.select(F.expr(f"train div {n}").alias("train"), F.expr(f"eval div {n}").alias("eval"), F.expr(f"cast(pmod(cls, {n}) as int)").alias("field"), "covered", "spans", F.col("shared").cast("int").alias("shared"), F.col("either").cast("int").alias("either"))


def overlap_classes(df: DataFrame, id_col: str, fields: list[str], is_eval: Column, is_train: Column, size: int = 5, least_words: int = 8, threshold: tuple[int, int] = (4, 5)) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (cls, other, covered, spans, shared, either) of a class of equal training texts and a class of equal evaluation texts that are alike,
    and (key, cls, held) for every text of either split; key = id * fields + field. So a group of copies is one row on either side, however many records are in it."""
    spark, n = df.sparkSession, len(fields)
    least, names = max(least_words, size), [f"t{i}" for i in range(len(fields))]
    texts = [F.col(f).alias(t) for f, t in zip(fields, names)]
    rows = df.where(F.col(id_col).isNotNull() & (is_eval | is_train)).select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(is_eval, F.lit(False)).alias("held"), *texts)
    held, train = (spread(rows.where(w)).select("id", *names) for w in ("held", "not held"))
    members = materialize(spread(rows).mapInArrow(_members(least, n, size), "key bigint, cls bigint, n bigint, size bigint, held boolean"), "members")
    of_size = F.least(F.floor(F.log(F.greatest("size", F.lit(1))) / math.log(RATIO)), F.lit(SIZES - 1)).cast("int")
    classes = materialize(members.where("held").groupBy("cls").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("size").alias("size")).withColumn("size", of_size), "classes")
    places, shards = _shards(classes)
    members = members.select("key", "cls", "held")
    if not shards:
        return spark.createDataFrame([], _PAIR), members
    first, parts = (F.array(*[F.lit(p[k]) for p in places])[F.col("size")] for k in (0, 1))
    shard = (first + F.pmod(F.xxhash64("cls"), parts)).cast("int")
    chosen = materialize(classes.withColumn("shard", shard).join(long_texts(held, "id", names), "key").select("shard", "cls", "size", "text"), "chosen")

    path = write_shards(chosen.select("shard", "cls", "text"), shards, _build, "index")
    held_seeds = chosen.select("shard", "size", "text").mapInArrow(_held_seeds, "seed bigint, shard int, sizes bigint").groupBy("seed", "shard").agg(F.bit_or("sizes").alias("sizes"))
    reach = math.ceil(math.log(threshold[1] / threshold[0]) / math.log(RATIO))
    fitting = F.expr(f"shiftleft(1L, least(size + {reach}, {SIZES - 1}) + 1) - shiftleft(1L, greatest(size - {reach}, 0))")
    seeds = train.mapInArrow(_train_seeds(least, n, size), "seed bigint, key bigint, size int, seeds int")
    met = seeds.join(held_seeds, "seed").where(F.col("sizes").bitwiseAND(fitting) != 0).groupBy("key", "shard").agg(F.count(F.lit(1)).alias("hits"), F.first("seeds").alias("seeds"))
    routes = materialize(met.where(F.col("hits") >= F.col("seeds") * least_share(size, threshold)).select("key", "shard"), "routes")

    asked = {r.shard: r.n for r in routes.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
    all_, cores, base, tasks = sum(asked.values()), spark.sparkContext.defaultParallelism, 0, []
    for k, m in sorted(asked.items()):
        p = max(-(-m // CHUNK), -(-cores * m // all_))
        tasks.append((k, base, p))
        base += p
    plan = spark.createDataFrame(tasks, "shard int, base int, parts int")
    sent = asked_only(long_texts(train, "id", names), routes.select("key").distinct()).join(routes, "key").join(F.broadcast(plan), "shard")
    sent = sent.select((F.col("base") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("task"), "shard", "key", "text").repartitionById(max(base, 1), F.col("task"))
    pairs = materialize(sent.select("shard", "key", "text").mapInArrow(_stream(path, n, size, threshold), _PAIR).dropDuplicates(["cls", "other"]), "matches")
    return pairs, members
