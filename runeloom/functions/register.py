"""The language's functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runeloom.functions.glossing import Glosser
from runeloom.functions.loan import loan, respell
from runeloom.functions.morphology import inflect, order_problem
from runeloom.functions.sounds import root_problems


def register(spark: SparkSession, glosser: Glosser | None = None) -> None:
    """``respell(word)``, ``loan(word, pos)``, ``inflect(root, tags)`` (tags joined by +; null where they don't fit), ``check_root(word)`` (problems as an array); with a
    ``glosser`` also ``gloss_word(word)`` and the table function ``analyses(word)``. Batches of Arrow; in DataFrame code the column functions on the JVM are faster."""

    @F.pandas_udf("string")
    def respell_(w: pd.Series) -> pd.Series:
        return w.map(respell, na_action="ignore")

    @F.pandas_udf("string")
    def loan_(w: pd.Series, pos: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else loan(a, p or "") for a, p in zip(w, pos)])

    @F.pandas_udf("string")
    def inflect_(root: pd.Series, tags: pd.Series) -> pd.Series:
        def one(r, t):
            ts = [x for x in (t or "").split("+") if x]
            return None if r is None or t is None or order_problem(ts) else inflect(r, *ts)

        return pd.Series([one(r, t) for r, t in zip(root, tags)])

    @F.pandas_udf("array<string>")
    def check_root_(w: pd.Series) -> pd.Series:
        return w.map(root_problems, na_action="ignore")

    for name, f in (("respell", respell_), ("loan", loan_), ("inflect", inflect_), ("check_root", check_root_)):
        spark.udf.register(name, f)
    if glosser is None:
        return

    @F.pandas_udf("string")
    def gloss_word_(w: pd.Series) -> pd.Series:
        return w.map(lambda x: glosser.gloss(glosser.analyze(x)), na_action="ignore")

    spark.udf.register("gloss_word", gloss_word_)

    @F.udtf(returnType="root string, tags string")
    class Analyses:
        def eval(self, word: str) -> Iterator[tuple[str, str]]:
            for root, tags in glosser.analyses(word.lower()) if word else []:
                yield root, "+".join(tags)

    spark.udtf.register("analyses", Analyses)


def register_stories(spark: SparkSession, marker: str = "<|endoftext|>") -> None:
    """The table function ``stories(text)``: the stories of one text with marker lines."""

    @F.udtf(returnType="place int, story string")
    class Stories:
        def eval(self, text: str):
            parts: list[list[str]] = [[]]
            for line in (text or "").split("\n"):
                if marker in line:
                    parts.append([])
                else:
                    parts[-1].append(line)
            yield from enumerate(s for s in ("\n".join(p).strip() for p in parts) if s)

    spark.udtf.register("stories", Stories)
