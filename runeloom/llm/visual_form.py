"""One form for texts that look the same.

Texts with a character that may have another look are exploded into positioned code points, joined with a
broadcast table (decomposition, look-alike letter, combining class), their combining marks are put in the order of
their classes, composed, and the strings rebuilt. Texts without such a character (plain ASCII, composed Latin
letters, common punctuation) are their own form and never exploded.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeloom.work import materialize

# Letters of other alphabets drawn like a Latin letter, by alphabet: the letters, then what they look like.
LOOK_ALIKE = {
    "Cyrillic small": ("аеорсухіјѕһԁԛԝӏүѵ", "aeopcyxijshdqwlyv"),
    "Cyrillic capital": ("АВЕЅІЈКМНОРСТУХԌԚԜҮѴӀ", "ABESIJKMHOPCTYXGQWYVI"),
    "Greek small": ("ονϲϳ", "ovcj"),
    "Greek capital": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺͿ", "ABEZHIKMNOPTYXCMJ"),
    "Armenian": ("օսոհցՕՍԼ", "ounhgOUL"),
    "phonetic": ("ɡɑ", "ga"),
}
#: Compatibility decompositions that only change the width, the style of the letter or undo a ligature of letters.
KINDS = ("<wide>", "<narrow>", "<font>")
LIGATURES = frozenset(
    c for c in range(0x80, 0x10000)
    if "LIGATURE" in unicodedata.name(chr(c), "") and unicodedata.decomposition(chr(c)).startswith("<compat>") and unicodedata.normalize("NFKD", chr(c)).isalpha()
)
#: Every space character of a line; tabs and line breaks stay.
SPACES = frozenset(chr(c) for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
#: Format characters that aren't drawn.
INVISIBLE = frozenset(chr(c) for c in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0000, 0xE01F0)))
#: Characters that are their own form whatever stands beside them but a combining mark: matched texts skip the explosion.
PLAIN = r"^[\x00-\x7FÀ-İĴ-ľŁ-ňŊ-ž‐-‗‘-‧‰-›]*$"


def _single(ch: str) -> str:
    """The form of one character, decomposed."""
    if ch in INVISIBLE:
        return ""
    if ch in SPACES:
        return " "
    d = unicodedata.decomposition(ch)
    if d.startswith(KINDS) or ord(ch) in LIGATURES:
        ch = unicodedata.normalize("NFKD", ch)
    return "".join(_look().get(c, c) for c in unicodedata.normalize("NFD", ch) if c not in INVISIBLE)


@cache
def _look() -> dict[str, str]:
    return {a: b for letters, like in LOOK_ALIKE.values() for a, b in zip(letters, like, strict=True)}


@cache
def mappings() -> tuple[tuple[str, str], ...]:
    """(character, form): every character whose form isn't itself. A few thousand rows, fixed by the Unicode standard."""
    out = []
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000 or 0xAC00 <= c < 0xD7A4:  # Hangul syllables are composed of jamo by rule and stay as they are
            continue
        ch = chr(c)
        form = _single(ch)
        if form != ch:
            out.append((ch, form))
    return tuple(out)


def mapping_table(spark: SparkSession) -> DataFrame:
    """(ch, form): the broadcast side, fixed in size by the Unicode standard."""
    return spark.createDataFrame(mappings(), "ch string, form string")


@F.pandas_udf(T.StringType())
def _composed(s):
    """The Unicode standard's canonical ordering of marks by combining class and recomposition of strings that are decomposed and mapped."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def visual_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, form): for each row with a text, its id, the 128-bit hash of the text as it is, and the form that all texts share
    which a reader can't tell apart. Rows with a null text are left out; an empty text is its own form; repeated rows stay repeated.

    Code points keep their position; the mapping may give none (invisible), one or several characters. Exploded
    characters of a text are brought together by a partial aggregation in the task that exploded them, so that
    the shuffle carries one row for each text that has any."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("raw", F.unhex(F.md5("text")))
    plain = F.col("text").rlike(PLAIN)
    odd = src.where(~plain).withColumn("row", F.monotonically_increasing_id())
    chars = odd.select("row", "id", "raw", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    hit = chars.join(F.broadcast(mapping_table(df.sparkSession)), "ch", "left")
    part = F.struct("pos", F.coalesce("form", "ch").alias("c"))
    built = hit.groupBy("row").agg(F.first("id").alias("id"), F.first("raw").alias("raw"), F.sort_array(F.collect_list(part)).alias("xs"))
    built = built.select("id", "raw", _composed(F.concat_ws("", F.transform("xs", lambda x: x["c"]))).alias("form"))
    return src.where(plain).select("id", "raw", F.col("text").alias("form")).unionByName(built)


def alike_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(a, b), a < b: each pair of ids whose texts differ but have one form. Blank texts are left out.

    Texts are compared by hash. Forms with a single text (nearly all) end in an aggregation with partial
    minima and maxima; pairs are made between the different texts of a form, then given their ids by equi-joins on (form, text)."""
    some = df.where(F.col(id_col).isNotNull() & ~F.col(text_col).rlike(r"^[\s\p{Z}]*$"))
    rows = visual_form(some, id_col, text_col).select("id", "raw", F.unhex(F.md5("form")).alias("fk"))
    rows = materialize(rows, "forms")
    several = rows.groupBy("fk").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("fk")
    members = materialize(rows.join(several, "fk"), "members")
    texts = members.select("fk", "raw").distinct()
    pairs = texts.withColumnRenamed("raw", "ra").join(texts.withColumnRenamed("raw", "rb"), "fk").where("ra < rb")
    out = pairs.join(members.select("fk", F.col("raw").alias("ra"), F.col("id").alias("x")), ["fk", "ra"]).join(members.select("fk", F.col("raw").alias("rb"), F.col("id").alias("y")), ["fk", "rb"])
    return out.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
