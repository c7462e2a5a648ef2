"""Glossing and validation of texts in the made language.

Distinct tokens are analysed once each and joined back; the lexicon, some thousand words, goes to the workers by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.functions.glossing import Glosser
from runeloom.work import spread

#: Rows of the lexicon up to which it is taken to the driver and broadcast; a language has no more words.
MAX_ENTRIES = 200_000
KINDS = ("word", "name", "number", "loan", "unknown")


def entries(df: DataFrame, *more: str) -> list[dict]:
    """The rows (kz, en, and ``more``) of a lexicon table, in the order of the words; entries without a word or an English side are left out, nulls elsewhere are empty."""
    e = df.select("kz", F.filter("en", lambda x: x.isNotNull()).alias("en"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in more])
    rows = e.where(F.col("kz").isNotNull() & (F.col("kz") != "") & (F.size("en") > 0)).orderBy("kz", "en").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"a lexicon has at most {MAX_ENTRIES} entries")
    return [r.asDict() for r in rows]


def load_glosser(content: DataFrame, functions: DataFrame) -> Glosser:
    return Glosser.of(entries(content, "origin"), entries(functions, "cat"))


#: What stands before a word, hyphens on their own included, and the word.
_GAP_WORD = r"(?U)((?:[^\w\-]|-+(?=[^\w\-]|$))*)([\w\-]+)"


def token_types(df: DataFrame, text_col: str) -> DataFrame:
    """(token, first, n): distinct tokens of a text column, apart for those that begin a sentence: the first of a text, and those with a sentence end or an opening quote between them and the word before."""
    part = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(_GAP_WORD), F.lit(k))
    x = spread(df.select(text_col)).select(F.posexplode(F.arrays_zip(part(1).alias("gap"), part(2).alias("token"))).alias("i", "x")).where(F.col("x.token").rlike(r"(?U)^\w"))
    first = (F.col("i") == 0) | F.col("x.gap").rlike('[.!?"“]')
    return x.select("x.token", first.alias("first")).groupBy("token", "first").agg(F.count(F.lit(1)).alias("n"))


def analyze_types(types: DataFrame, content: DataFrame, functions: DataFrame) -> DataFrame:
    """(token, first, n, root, tags, kind, gloss) for distinct tokens (token, first, n)."""
    shared = types.sparkSession.sparkContext.broadcast(load_glosser(content, functions))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Glosser = shared.value
        for p in parts:
            a = [g.analyze(t, bool(f)) for t, f in zip(p["token"], p["first"])]
            yield p.assign(root=[x.root for x in a], tags=["+".join(x.tags) for x in a], kind=[x.kind for x in a], gloss=[g.gloss(x) for x in a])

    # distinct tokens are few bytes but much work: as many tasks as the session's shuffles have, whatever their size
    n = int(types.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return types.repartition(n, "token", "first").mapInPandas(run, "token string, first boolean, n bigint, root string, tags string, kind string, gloss string")


def gloss_texts(df: DataFrame, text_col: str, content: DataFrame, functions: DataFrame, out: str = "gloss", width: int = 100) -> DataFrame:
    """``df`` with an interlinear gloss of each text; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(load_glosser(content, functions))

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else shared.value.interlinear(t, width))

    return df.withColumn(out, run(F.col(text_col)))


def validate_texts(df: DataFrame, id_col: str, text_col: str, content: DataFrame, functions: DataFrame) -> DataFrame:
    """(id, one count for each kind of word, ok): whether a text is in the made language. A null text has null counts and isn't ok."""
    shared = df.sparkSession.sparkContext.broadcast(load_glosser(content, functions))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g: Glosser = shared.value
        for p in parts:
            kinds = [None if t is None else [a.kind for _, a in g.tokens(t) if a] for t in p["text"]]
            cols = {k: pd.array([None if x is None else x.count(k) for x in kinds], dtype="Int64") for k in KINDS}
            yield pd.DataFrame({"id": p["id"], **cols, "ok": [x is not None and "unknown" not in x for x in kinds]})

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} bigint" for k in KINDS) + ", ok boolean"
    return spread(src).mapInPandas(run, schema)


def kind_counts(analyzed: DataFrame) -> DataFrame:
    """(kind, tokens, share) over analysed types."""
    n = analyzed.groupBy("kind").agg(F.sum("n").alias("tokens"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("tokens").alias("total")))).select("kind", "tokens", (F.col("tokens") / F.col("total")).alias("share"))


def unknown_words(analyzed: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent tokens that aren't of the language."""
    return analyzed.where("kind = 'unknown'").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(top)
