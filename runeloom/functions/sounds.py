"""Sounds of the made language: segments, word shapes, and which roots are well formed."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from itertools import groupby, pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the language's sound rules.
VOWELS = "aeiou"
DIGRAPHS = "tch kh zh sh th dh gh rh ch ng ph ck".split()
RESPELLED = {"tch": "ch", "ck": "k"}
ALPHABET = "abdefghiklmnorstuvwyz"
SINGLE_INITIALS = "b d g k t f v s z sh zh th dh kh h m n l r w y".split()
INITIAL_CLUSTERS = "gr dr kr br tr fr thr khr dhr kl gl fl sk skr st str sl sm dw kv".split()
SINGLE_FINALS = "k g z d t n m l r ng f s sh zh th kh b".split()
FINAL_CLUSTERS = "nd nk nt rn rk rg rm rl rd ld lk lg zk rz".split()
MEDIAL_CODAS = "k g z d t n m l r ng s sh zh th kh b f".split()
FORBIDDEN_PAIRS = {("n", "g"), ("k", "h"), ("z", "h"), ("s", "h"), ("t", "h"), ("d", "h"), ("h", "r"), ("h", "l"), ("h", "n"), ("ng", "ng")}
RESERVED_ENDINGS = ("i", "ad", "en", "ki", "it")
MAX_MEDIAL, MAX_EXTRA = 3, 2

_SEGMENT = re.compile("|".join([*DIGRAPHS, "."]), re.S)


def segments(word: str, keep_double: bool = False) -> list[str]:
    """The sounds of a word as spelled; a doubled consonant is one sound unless ``keep_double``."""
    segs = [RESPELLED.get(s, s) for s in _SEGMENT.findall(word.lower())]
    if keep_double:
        return segs
    return segs[:1] + [s for (p, s), v in zip(pairwise(segs), vowel_flags(segs)[1:]) if v or p != s]


def vowel_flags(segs: list[str]) -> list[bool]:
    """Which segments are vowels; y is one unless a vowel follows it."""
    return [s in VOWELS or (s == "y" and (n == "" or n not in VOWELS)) for s, n in zip(segs, [*segs[1:], ""])]


def has_double(word: str) -> bool:
    """Whether two equal consonants stand together."""
    segs = segments(word, True)
    return any(a == b and not v for (a, b), v in zip(pairwise(segs), vowel_flags(segs)))


@dataclass(frozen=True)
class Shape:
    initial: str
    nuclei: tuple[str, ...]
    medials: tuple[str, ...]
    final: str


def shape(word: str) -> Shape:
    """Consonant clusters (segments joined by a point) and vowel runs of a word, from its start to its end."""
    segs = segments(word)
    runs = [(v, [s for _, s in g]) for v, g in groupby(zip(vowel_flags(segs), segs), key=lambda x: x[0])]
    clusters = [(i, ".".join(r)) for i, (v, r) in enumerate(runs) if not v]
    initial = next((c for i, c in clusters if i == 0), "")
    final = next((c for i, c in clusters if i and i == len(runs) - 1), "")
    if initial and len(runs) == 1:
        final = ""
    return Shape(initial, tuple("".join(r) for v, r in runs if v), tuple(c for i, c in clusters if 0 < i < len(runs) - 1), final)


def _dotted(*lists: list[str]) -> frozenset[str]:
    return frozenset([""] + [".".join(segments(c, True)) for x in lists for c in x])


INITIALS = _dotted(SINGLE_INITIALS, INITIAL_CLUSTERS)
FINALS = _dotted(SINGLE_FINALS, FINAL_CLUSTERS)


def legal_medial(cluster: str) -> bool:
    """Whether a cluster can stand between vowels: at most one coda consonant, then a legal beginning of a word. Forbidden pairs aren't looked at."""
    segs = cluster.split(".") if cluster else []
    if not 0 < len(segs) <= MAX_MEDIAL:
        return False
    return cluster in INITIALS or (segs[0] in MEDIAL_CODAS and ".".join(segs[1:]) in INITIALS)


@cache
def legal_medials() -> tuple[str, ...]:
    """All medial clusters for making words, those without forbidden or doubled pairs."""
    made = {".".join(filter(None, (c, i))) for c in ["", *MEDIAL_CODAS] for i in INITIALS} - {""}
    clean = lambda segs: all(p not in FORBIDDEN_PAIRS and p[0] != p[1] for p in pairwise(segs))
    return tuple(sorted(m for m in made if legal_medial(m) and clean(m.split("."))))


def root_problems(word: str) -> list[str]:
    """What keeps a word from being a root of the language, in a fixed order; letters outside the alphabet are told alone."""
    strange = sorted(set(word) - set(ALPHABET))
    if strange or not word:
        return [f"letters outside alphabet: {strange}"]
    segs, s = segments(word, True), shape(word)
    pairs = [f"geminate '{a}{b}'" if a == b and a not in VOWELS else f"forbidden sequence '{a}{b}'" for a, b in pairwise(segs) if (a == b and a not in VOWELS) or (a, b) in FORBIDDEN_PAIRS]
    extra = sum(c.count(".") for c in (s.initial, *s.medials, s.final))
    ending = next((e for e in RESERVED_ENDINGS if word.endswith(e)), None)
    tests = [
        ("'y' used as a vowel", any(v and x == "y" for x, v in zip(segs, vowel_flags(segs)))),
        *[(p, True) for p in pairs],
        ("no vowel", not s.nuclei),
        ("vowel sequence", any(len(n) > 1 for n in s.nuclei)),
        (f"illegal initial '{s.initial}'", s.initial not in INITIALS),
        (f"illegal final '{s.final}'", s.final not in FINALS),
        *[(f"illegal medial '{m}'", not legal_medial(m)) for m in s.medials],
        (f"too many clustered consonants ({extra} extra)", extra > MAX_EXTRA),
        (f"ends in reserved suffix '-{ending}'", ending is not None),
    ]
    return [text for text, wrong in tests if wrong]


# --- columns ------------------------------------------------------------------


def segments_col(word: Column) -> Column:
    """``segments(word, keep_double=True)`` on the JVM."""
    raw = F.regexp_extract_all(F.lower(word), F.lit(f"({'|'.join(DIGRAPHS)}|.)"), F.lit(1))
    return F.transform(raw, lambda s: F.when(s == "tch", "ch").when(s == "ck", "k").otherwise(s))


def has_double_col(word: Column) -> Column:
    """``has_double`` on the JVM."""
    s = segments_col(word)
    pair = lambda i: (s[i] == s[i + 1]) & ~s[i].isin(*VOWELS) & ~((s[i] == "y") & ~F.coalesce(s[i + 1].isin(*VOWELS), F.lit(False)))
    return F.when(F.size(s) < 2, False).otherwise(F.exists(F.sequence(F.lit(0), F.size(s) - 2), pair))
