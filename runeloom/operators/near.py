"""Near spellings: deletion neighbourhoods and the exact one-edit test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deletions(word: Column) -> Column:
    """The word and every spelling with one character less."""
    n = F.length(word)
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.when(n > 0, F.array_union(F.array(word), cuts)).otherwise(F.array(word))


def near_join(queries: DataFrame, index: DataFrame, word: str = "word") -> DataFrame:
    """(query, hit): pairs that share a spelling of their deletion neighbourhoods, equal words included. That is one insertion, deletion,
    substitution or adjacent exchange, and some words two edits apart. An equi-join on the exploded keys; nulls meet nothing."""
    side = lambda df, name: df.select(F.col(word).alias(name)).where(F.col(name).isNotNull()).distinct().select(name, F.explode(deletions(F.col(name))).alias("key"))
    return side(queries, "query").join(side(index, "hit"), "key").select("query", "hit").distinct()


def within_one(a: Column, b: Column) -> Column:
    """Whether one substitution, insertion, deletion or adjacent exchange makes one word the other; equal words aren't."""
    n = F.length(a)
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, n)) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((n == F.length(b)) & swapped))


def within_one_pairs(words: DataFrame, word: str = "word", least: int = 3) -> DataFrame:
    """(a, b), a < b: words of ``least`` letters or more that are one edit apart. Candidates come from the near join."""
    w = words.where(F.length(word) >= least)
    return near_join(w, w, word).where("query < hit").where(within_one(F.col("query"), F.col("hit"))).select(F.col("query").alias("a"), F.col("hit").alias("b"))


def near_hits(queries: DataFrame, index: DataFrame, word: str = "word", least: int = 4, top: int = 3) -> DataFrame:
    """(query, hits): of each query of ``least`` letters or more, the first ``top`` neighbours in order, itself left out."""
    return near_join(queries.where(F.length(word) >= least), index, word).where("query <> hit").groupBy("query").agg(F.slice(F.array_sort(F.collect_set("hit")), 1, top).alias("hits"))
