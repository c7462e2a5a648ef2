"""Translation as a DataFrame operator: one pass of Python over whole texts, without a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.functions.parsing import TOKEN_SCHEMA, Token
from runeloom.functions.rewriting import Language, Stats, Translator
from runeloom.operators.glosses import entries
from runeloom.work import spread

RESULT = "kz string, words bigint, loans bigint, loan_rate double, unknown bigint, names bigint, loan_words map<string,bigint>, unknown_words map<string,bigint>"


def load_language(content: DataFrame, functions: DataFrame, phrases: dict[str, str] | None = None, alias: dict[tuple[str, str], tuple[str, str]] | None = None) -> Language:
    """The lexicon for the workers; it is a language's, so bounded, and its size is checked."""
    return Language(entries(content), entries(functions, "cat"), phrases, alias)


def _row(text: str | None, stats: Stats) -> tuple:
    return (text, stats.tokens, stats.loans, round(stats.loans / stats.tokens, 4) if stats.tokens else 0.0, stats.unknown, stats.names, dict(stats.loan_words), dict(stats.unknown_words))


def _frame(ids: pd.Series, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kz", "words", "loans", "loan_rate", "unknown", "names", "loan_words", "unknown_words"])
    out.insert(0, "id", ids.to_numpy())
    return out


def translate(df: DataFrame, id_col: str, text_col: str, lang: Language, keep_text: bool = False) -> DataFrame:
    """(id, kz, words, loans, loan_rate, unknown, names, loan_words, unknown_words): every text translated with the parser by rule. A null text gives a null with counts of 0.
    With ``keep_text`` the column ``text`` comes along, which costs no second way to the workers."""
    shared = df.sparkSession.sparkContext.broadcast(lang)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Translator(shared.value)
        for p in parts:
            out = _frame(p["id"], [_row(None, Stats()) if x is None else _row(*t.translate(x)) for x in p["text"]])
            yield out.assign(text=p["text"].to_numpy()) if keep_text else out

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread(src).mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, {RESULT}" + ", text string" * keep_text)


def translate_parsed(df: DataFrame, id_col: str, sentences_col: str, lang: Language) -> DataFrame:
    """The same for texts that another parser has read: an array of sentences, each an array of tokens in the schema of the parse stage."""
    shared = df.sparkSession.sparkContext.broadcast(lang)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Translator(shared.value)
        for p in parts:
            rows = []
            for sents in p["s"]:
                stats = Stats()
                text = None if sents is None else t.sentences([[Token(**(x if isinstance(x, dict) else x.asDict())) for x in s] for s in sents], stats)
                rows.append(_row(text, stats))
            yield _frame(p["id"], rows)

    src = df.select(F.col(id_col).alias("id"), F.col(sentences_col).cast(f"array<{TOKEN_SCHEMA}>").alias("s"))
    return spread(src).mapInPandas(run, f"id {src.schema['id'].dataType.simpleString()}, {RESULT}")


def translate_text(text: str, lang: Language) -> tuple[str, Stats]:
    """One text, on the driver."""
    return Translator(lang).translate(text)
