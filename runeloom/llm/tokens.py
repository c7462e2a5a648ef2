"""Token counts and offsets by a public tokenizer, whose file is a parameter and is sent to the workers by broadcast."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

#: Ranks of a byte-level BPE in the format of tiktoken; under 1 MB.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that this vocabulary's texts are cut by before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest stretch that is encoded at once; longer ones are cut at a space or, without one, at this length, so that time grows with the text.
STRETCH = 20_000


class Tokenizer:
    def __init__(self, ranks: bytes):
        import tiktoken

        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self._encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self._size = np.zeros(max(by_bytes.values()) + 1, dtype=np.int64)
        for b, r in by_bytes.items():
            self._size[r] = len(b)

    def _stretches(self, text: str):
        at = 0
        while len(text) - at > STRETCH:
            cut = text.rfind(" ", at + STRETCH // 2, at + STRETCH)
            cut = cut if cut > at else at + STRETCH
            yield text[at:cut]
            at = cut
        yield text[at:] if at else text

    def count(self, text: str | None) -> int:
        """Tokens of a text; a null has none."""
        return sum(len(self._encoding.encode_ordinary(s)) for s in self._stretches(text)) if text else 0

    def ends(self, text: str) -> np.ndarray:
        """The byte offset at which each token ends."""
        ids = np.concatenate([np.array(self._encoding.encode_ordinary(s), dtype=np.int64) for s in self._stretches(text)])
        return np.cumsum(self._size[ids])


@lru_cache(maxsize=2)
def tokenizer(ranks: bytes) -> Tokenizer:
    return Tokenizer(ranks)


def broadcast_ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())
