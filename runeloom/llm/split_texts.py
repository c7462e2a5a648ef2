"""Texts over a size limit cut into pieces at natural boundaries, by agglomerative merging.

A text begins as atomic segments: its sentences, and within a sentence too long for a piece its clauses, words
or tokens. Adjacent pairs wait in a heap; the weakest boundary is merged first (token, word, clause, sentence,
line, paragraph; of equal ones the smallest pair) while the segments' size and the overlap fit the capacity. So
the boundaries that remain are the strongest that the capacity allows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.llm.tokens import TOKENIZER, Tokenizer, broadcast_ranks, tokenizer
from runeloom.work import spread

_WHITE = np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8)
TOKEN, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "St", "No", "vs", "e.g", "i.e")
NO_END = "".join(rf"(?<!\b{re.escape(a)}\.)" for a in ABBREVIATIONS)
#: What a boundary of each strength follows; the boundary is the end of the match. A sentence or clause ends before the space, which belongs to the next word's token; full-width marks end a sentence without one.
#: Words (before white space) and lines (after a line break) are told from the bytes.
_BREAKS = (
    (CLAUSE, re.compile(r"[,;:—–][\"'”’)\]]*(?=\s)")),
    (SENTENCE, re.compile(rf"(?:\.{NO_END}|[!?…])[\"'”’)\]]*(?=\s)|[。！？][\"'”’)\]」』]*")),
    (PARAGRAPH, re.compile(r"\n[ \t\r]*\n\s*")),
)


def boundaries(text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary before token i (0 to the number of tokens): its strength, -1 where it cuts a character; and the last boundary at or before it that doesn't."""
    raw = np.frombuffer(b"\n" + text.encode() + b" ", dtype=np.uint8)
    n = len(ends)
    at = np.concatenate([[0], ends])
    behind, before = raw[at + 1], raw[at]
    white = np.isin(before, _WHITE)
    strength = np.where(np.isin(behind, _WHITE) & ~white, WORD, TOKEN).astype(np.int8)
    if len(raw) - 2 != len(text):
        strength[(behind & 0xC0) == 0x80] = -1
        chars = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        offset = np.concatenate([[0], np.cumsum(1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF).astype(np.int64))])
    else:
        offset = None
    for level, pattern in _BREAKS:
        if level == PARAGRAPH:
            strength[1:][before[1:] == 10] = LINE
        found = np.fromiter((m.end() for m in pattern.finditer(text)), dtype=np.int64)
        found = found if offset is None else offset[found]
        i = np.searchsorted(at, found)
        i = i[(i <= n) & (at[np.minimum(i, n)] == found)]
        strength[i] = level
    whole = np.maximum.accumulate(np.where(strength >= 0, np.arange(n + 1), 0))
    return strength, whole


def cut(strength: np.ndarray, whole: np.ndarray, capacity: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of the tokens of every piece, in order, overlaps included."""
    n = len(strength) - 1
    room = capacity - overlap - 3  # a character has up to 4 tokens
    edges = np.flatnonzero(strength >= SENTENCE)
    edges = np.unique(np.concatenate([[0], edges, [n]]))
    for level in (CLAUSE, WORD, TOKEN):  # segments too long for a piece are cut at weaker boundaries
        long = np.flatnonzero(np.diff(edges) > room)
        if not len(long):
            break
        more = [np.flatnonzero(strength[edges[k] : edges[k + 1]] >= level) + edges[k] for k in long.tolist()]
        edges = np.unique(np.concatenate([edges, *more]))
    # tokens that a piece which begins at a segment takes from before it
    shared = (edges[:-1] - whole[np.maximum(edges[:-1] - overlap, 0)]).tolist()
    start = edges[:-1].tolist()
    end = edges[1:].tolist()
    m = len(start)
    right, left, alive = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m
    level = strength[edges].tolist()  # level[k]: the boundary before segment k

    heap = [(level[k], end[k] - start[k - 1], k) for k in range(1, m) if end[k] - start[k - 1] + shared[k - 1] <= capacity]
    heapq.heapify(heap)
    while heap:
        lev, size, b = heapq.heappop(heap)
        if not alive[b]:
            continue
        a = left[b]
        now = end[b] - start[a]
        if now + shared[a] > capacity:
            continue
        if now != size:
            heapq.heappush(heap, (lev, now, b))
            continue
        end[a], alive[b] = end[b], False
        right[a] = c = right[b]
        if c < m:
            left[c] = a
    return [(start[k] - shared[k], end[k]) for k in range(m) if alive[k]]


def pieces(text: str, ends: np.ndarray, capacity: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first token, end, text) of every piece."""
    raw = text.encode()
    strength, whole = boundaries(text, ends)
    for a, b in cut(strength, whole, capacity, overlap):
        yield a, b, raw[ends[a - 1] if a else 0 : ends[b - 1]].decode()


def _split(tok: Tokenizer, text: str, limits: list[tuple[str, int, int]]) -> Iterator[tuple]:
    least = min(c for _, c, _ in limits)
    if not text or len(text.encode()) <= least:  # a token has a byte or more
        return
    ends = tok.ends(text)
    if len(ends) <= least:
        return
    strength, whole = boundaries(text, ends)
    raw = text.encode()
    for name, capacity, overlap in limits:
        if len(ends) > capacity:
            for k, (a, b) in enumerate(cut(strength, whole, capacity, overlap)):
                yield name, k, a, b, raw[ends[a - 1] if a else 0 : ends[b - 1]].decode()


def split_texts(df: DataFrame, id_col: str, text_col: str, limits: list[tuple[str, int, int]], path: str = TOKENIZER) -> DataFrame:
    """(id, limit_name, piece, first_token, end_token, text): the pieces of every text with more tokens than the capacity of a limit (name, capacity, overlap).

    Every piece has at most ``capacity`` tokens of the text's own; each but the first begins with the last ``overlap`` tokens of the one before it
    (one to three more where the overlap would begin inside a character). Texts within a limit, nulls and empty texts have no rows for it; repeated
    rows give repeated pieces. A capacity must exceed its overlap by 8 or more. One task works on one text at a time; nothing is shuffled."""
    for name, capacity, overlap in limits:
        if overlap < 0 or capacity < overlap + 8:
            raise ValueError(f"limit {name}: capacity {capacity} is too small for an overlap of {overlap}")
    ranks = broadcast_ranks(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            rows, held = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in _split(tok, t, limits):
                    rows.append((i, *r))
                    held += len(r[-1])
                if held > 8_000_000 or len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=["id", "limit_name", "piece", "first_token", "end_token", "text"])
                    rows, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=["id", "limit_name", "piece", "first_token", "end_token", "text"])

    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")).mapInArrow(run, "id bigint, limit_name string, piece int, first_token bigint, end_token bigint, text string")
