"""Suffixes of the made language: one rule for the JVM and its twin in Python."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from runeloom.functions.sounds import DIGRAPHS, MEDIAL_CODAS, RESPELLED, SINGLE_INITIALS, VOWELS, legal_medial, segments

# Tag -> (form, slot). PL is -i after a consonant, -n after a vowel.
SUFFIXES = {
    "AGT": ("ki", "deriv"), "PLACE": ("az", "deriv"), "CRAFT": ("ul", "deriv"), "ADV": ("ul", "deriv"), "THING": ("ak", "deriv"),
    "LIKE": ("rak", "deriv"), "VBZ": ("ash", "deriv"), "TIME": ("ur", "deriv"), "REASON": ("os", "deriv"), "POSS": ("a", "deriv"), "DIM": ("it", "deriv"),
    "CMP": ("ar", "degree"), "ORD": ("ik", "degree"),
    "PL": ("i", "infl"), "PST": ("ad", "infl"), "PROG": ("en", "infl"),
}
SLOTS = ("deriv", "degree", "infl")
#: What every word of a part of speech can take.
PARADIGM = {"NOUN": (("PL",),), "VERB": (("PST",), ("PROG",)), "ADJ": (("CMP",), ("ADV",)), "ADV": (), "INTJ": ()}


@cache
def open_codas(form: str) -> frozenset[str]:
    """Spellings of word-final clusters after which a suffix that begins with a consonant needs no linking vowel. Clusters of three segments never are among them."""
    head = []
    for s in segments(form, True):
        if s in VOWELS:
            break
        head.append(s)
    sounds = {s: RESPELLED.get(s, s) for s in {*MEDIAL_CODAS, *SINGLE_INITIALS, *DIGRAPHS, "c", "j", "p", "q", "x"}}
    spelled = {(a,): sounds[a] for a in sounds} | {(a, b): f"{sounds[a]}.{sounds[b]}" for a in sounds for b in sounds}
    return frozenset("".join(k) for k, c in spelled.items() if legal_medial(".".join([c, *head])) and segments("".join(k), True) == c.split("."))


def attach(stem: str, tag: str) -> str:
    form = SUFFIXES[tag][0]
    after_vowel = stem[-1:] in VOWELS and stem != ""
    if tag == "PL":
        return stem + ("n" if after_vowel else "i")
    if form[0] in VOWELS:
        return (stem[:-1] if after_vowel else stem) + form
    coda = stem[len(stem.rstrip("".join(set(stem) - set(VOWELS)))) :]
    return stem + ("" if after_vowel or not coda or coda.lower() in open_codas(form) else "a") + form


def order_problem(tags: tuple[str, ...] | list[str]) -> str | None:
    """Derivations come first, then at most one degree, then at most one inflection."""
    if bad := [t for t in tags if t not in SUFFIXES]:
        return f"unknown suffix tag {bad[0]!r}"
    ranks = [SLOTS.index(SUFFIXES[t][1]) for t in tags]
    if ranks != sorted(ranks):
        return f"suffixes out of order: {'+'.join(tags)}"
    return "more than one suffix of a slot" if max(ranks.count(1), ranks.count(2), 0) > 1 else None


def inflect(root: str, *tags: str) -> str:
    if problem := order_problem(tags):
        raise ValueError(problem)
    for t in tags:
        root = attach(root, t)
    return root


# --- columns ------------------------------------------------------------------


def attach_col(stem: Column, tag: str) -> Column:
    """``attach`` on the JVM."""
    form = SUFFIXES[tag][0]
    after_vowel = stem.rlike(f"[{VOWELS}]$")
    if tag == "PL":
        return F.concat(stem, F.when(after_vowel, "n").otherwise("i"))
    if form[0] in VOWELS:
        return F.concat(F.regexp_replace(stem, f"[{VOWELS}]$", ""), F.lit(form))
    coda = F.lower(F.regexp_extract(stem, f"[^{VOWELS}]*$", 0))
    link = F.when(after_vowel | (coda == "") | coda.isin(*sorted(open_codas(form))), "").otherwise("a")
    return F.concat(stem, link, F.lit(form))


def inflect_col(root: Column, tags: Column) -> Column:
    """``inflect`` for an array of tags in each row; null where the order is wrong, a tag is unknown or either is null."""

    def step(acc: Column, tag: Column) -> Column:
        out = F.when(tag.isNull(), F.lit(None))
        for t in SUFFIXES:
            out = out.when(tag == t, attach_col(acc, t))
        return out.otherwise(F.lit(None))

    rank = F.transform(tags, lambda t: F.when(t.isin("CMP", "ORD"), 1).when(t.isin("PL", "PST", "PROG"), 2).otherwise(0))
    once = (F.size(F.filter(rank, lambda r: r == 1)) <= 1) & (F.size(F.filter(rank, lambda r: r == 2)) <= 1)
    return F.when(once & (F.array_sort(rank) == rank), F.aggregate(tags, root, step))
