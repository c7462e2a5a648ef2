"""Loan words: English lemmas spelled in the made language, with the ending of their word class."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, applied in this order to a lemma in lower case.
SPELLING = (
    ("tch", "ch"), ("ph", "f"), ("ck", "k"), ("qu", "kv"), ("q", "k"), ("x", "ks"), ("wh", "w"), ("gh", ""),
    ("ce", "se"), ("ci", "si"), ("cy", "si"), ("ch", "tsh"), ("c", "k"), ("j", "zh"), ("p", "b"),
    ("ee", "i"), ("ea", "e"), ("oo", "u"), ("ou", "u"), ("ai", "a"), ("ay", "a"), ("oa", "o"), ("ie", "i"), ("ey", "i"), ("tsh", "sh"),
)
# Patterns after the spelling rules: y as a vowel, runs of vowels, doubled consonants.
CLEANING = ((r"y(?![aeiou])", "i"), (r"([aeiou])[aeiou]+", r"\1"), (r"([^aeiou])\1+", r"\1"))
# Fixed values.
ENDINGS = {"NOUN": "uz", "VERB": "ash", "ADJ": "rak"}
SILENT_E = r"(?<=[^aeiou])e$"


def respell(lemma: str) -> str:
    w = re.sub("[^a-z]", "", lemma.lower())
    w = re.sub(SILENT_E, "", w) if len(w) > 3 else w
    for a, b in SPELLING:
        w = w.replace(a, b)
    for a, b in CLEANING:
        w = re.sub(a, b, w)
    return w or "u"


def loan(lemma: str, pos: str) -> str:
    w, ending = respell(lemma), ENDINGS.get(pos, "")
    if pos == "VERB" and len(w) > 4:
        w = w.removesuffix("at")
    return (w[:-1] if ending[:1] in ("u", "a") and w[-1] in "aeiou" else w) + ending


def respell_col(lemma: Column) -> Column:
    """``respell`` on the JVM; null stays null."""
    w = F.regexp_replace(F.lower(lemma), "[^a-z]", "")
    w = F.regexp_replace(w, "(?<=...)" + SILENT_E, "")  # only in words of more than three letters
    for a, b in SPELLING:
        w = F.replace(w, F.lit(a), F.lit(b))
    for a, b in CLEANING:
        w = F.regexp_replace(w, a, b.replace("\\", "$"))
    return F.when(lemma.isNotNull(), F.coalesce(F.nullif(w, F.lit("")), F.lit("u")))


def loan_col(lemma: Column, pos: Column) -> Column:
    """``loan`` on the JVM."""
    return _bound(respell_col(lemma), lambda w: with_ending(w, pos))


def with_ending(w: Column, pos: Column) -> Column:
    """A respelled word with the ending of its word class; a final vowel gives way to an ending in a vowel."""
    stem = F.when((pos == "VERB") & (F.length(w) > 4), F.regexp_replace(w, "at$", "")).otherwise(w)
    out = F
    for p, ending in ENDINGS.items():
        base = F.regexp_replace(stem, "[aeiou]$", "") if ending[0] in "aeiou" else stem
        out = out.when(pos == p, F.concat(base, F.lit(ending)))
    return out.otherwise(stem)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def respell_sql(lemma: str) -> str:
    """``respell`` as DuckDB SQL, whose patterns know no look-around and no references to groups."""
    w = f"regexp_replace(lower({lemma}), '[^a-z]', '', 'g')"
    w = f"(CASE WHEN length({w}) > 3 THEN regexp_replace({w}, '([^aeiou])e$', '\\1') ELSE {w} END)"
    for a, b in SPELLING:
        w = f"replace({w}, '{a}', '{b}')"
    w = f"regexp_replace(regexp_replace({w}, 'y+([^aeiouy]|$)', 'i\\1', 'g'), 'yy+', 'iy', 'g')"
    w = f"regexp_replace({w}, '([aeiou])[aeiou]+', '\\1', 'g')"
    for c in "bcdfghjklmnpqrstvwxyz":
        w = f"regexp_replace({w}, '{c}{c}+', '{c}', 'g')"
    return f"coalesce(nullif({w}, ''), 'u')"
