"""Counts of sounds over words, blended distributions, the trigram model and scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeloom.functions.sounds import VOWELS, has_double, segments, segments_col, shape

LAMBDAS = (0.6, 0.3, 0.1)
KINDS = ("initial", "final", "medial", "nucleus", "final_nucleus", "consonant", "syllables", "ending2", "ending3", "trigram", "geminate")


def _word_rows(w: str) -> Iterator[tuple[str, str]]:
    s, segs = shape(w), segments(w)
    yield from (("initial", s.initial), ("final", s.final), ("syllables", str(len(s.nuclei))), ("ending2", w[-2:]), ("ending3", w[-3:]))
    yield from (("medial", m) for m in s.medials)
    yield from (("nucleus", n) for n in s.nuclei)
    if s.nuclei:
        yield "final_nucleus", s.nuclei[-1] + ("C" if s.final else "#")
    yield from (("consonant", c) for c in segs if c not in VOWELS + "y")
    padded = ["<", "<", *segs, ">"]
    yield from (("trigram", " ".join(t)) for t in zip(padded, padded[1:], padded[2:]))
    if has_double(w):
        yield "geminate", "yes"


def sound_counts(words: DataFrame, source: str = "source", word: str = "word") -> DataFrame:
    """(source, kind, key, n): clusters, nuclei, endings, syllables and trigrams of the distinct words of every source. Null and empty words are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([(s, *r) for s, w in zip(p["source"], p["word"]) for r in _word_rows(w)], columns=["source", "kind", "key"])

    distinct = words.select(F.col(source).alias("source"), F.col(word).alias("word")).where("word <> ''").distinct()
    return distinct.mapInPandas(run, "source string, kind string, key string").groupBy("source", "kind", "key").agg(F.count(F.lit(1)).alias("n"))


def trigrams(words: DataFrame, source: str = "source", word: str = "word") -> DataFrame:
    """(source, a, b, c, n): segment trigrams of distinct words between marks of beginning and end, on the JVM; doubled consonants stay two."""
    d = words.select(F.col(source).alias("source"), F.col(word).alias("word")).where("word <> ''").distinct()
    return d.select("source", F.explode(_triples(F.col("word"))).alias("t")).select("source", "t.a", "t.b", "t.c").groupBy("source", "a", "b", "c").agg(F.count(F.lit(1)).alias("n"))


def _triples(word: Column) -> Column:
    s = F.concat(F.array(F.lit("<"), F.lit("<")), segments_col(word), F.array(F.lit(">")))
    return F.transform(F.sequence(F.lit(0), F.size(s) - 3), lambda i: F.struct(F.get(s, i).alias("a"), F.get(s, i + 1).alias("b"), F.get(s, i + 2).alias("c")))


def percent_table(counts: DataFrame, kind: str, sources: list[str], top: int = 25) -> DataFrame:
    """key, one column of percentages for each source, and the combined one; the ``top`` keys by combined count, ties by key."""
    c = counts.where(F.col("kind") == kind).groupBy("key").pivot("source", sources).agg(F.sum("n")).na.fill(0)
    total = c.agg(*[F.sum(s).alias(f"__{s}") for s in sources])
    x = c.crossJoin(F.broadcast(total)).withColumn("combined_n", sum((F.col(s) for s in sources), F.lit(0)))
    pct = lambda n, t: F.coalesce(100 * n / F.nullif(t, F.lit(0)), F.lit(0.0))
    whole = sum((F.col(f"__{s}") for s in sources), F.lit(0))
    return x.orderBy(F.desc("combined_n"), "key").limit(top).select("key", *[pct(F.col(s), F.col(f"__{s}")).alias(s) for s in sources], pct(F.col("combined_n"), whole).alias("combined"), "combined_n")


def blend(counts: DataFrame, sizes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(kind, key, p): the weighted sum over sources of a key's count for each word of the source. ``sizes``: (source, words)."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    x = counts.join(F.broadcast(sizes), "source").where(F.col("source").isin(*weights))
    return x.groupBy("kind", "key").agg(F.sum(F.try_element_at(w, F.col("source")) * F.col("n") / F.col("words")).alias("p"))


def trigram_model(tri: DataFrame) -> dict[str, DataFrame]:
    """The model's tables from (a, b, c, n): trigrams, their contexts, bigrams, theirs, single segments, and the totals. Their size is that of the set of sounds, cubed at most."""
    s = F.sum("n").alias("n")
    uni = tri.groupBy("c").agg(s)
    return {
        "tri": tri.groupBy("a", "b", "c").agg(s), "tri_of": tri.groupBy("a", "b").agg(s), "bi": tri.groupBy("b", "c").agg(s),
        "bi_of": tri.groupBy("b").agg(s), "uni": uni, "total": uni.agg(F.sum("n").alias("total"), (F.count(F.lit(1)) + 1).alias("vocabulary")),
    }


def log_probability(words: DataFrame, model: dict[str, DataFrame], word: str = "word") -> DataFrame:
    """(word, logprob) of distinct words: the mean log2 of 0.6 p(c|ab) + 0.3 p(c|b) + 0.1 p(c), add-one on the last; joins with the model's broadcast tables."""
    t = words.select(F.col(word).alias("word")).where("word <> ''").distinct().select("word", F.explode(_triples(F.col("word"))).alias("t")).select("word", "t.*")
    for name, keys in (("tri", ["a", "b", "c"]), ("tri_of", ["a", "b"]), ("bi", ["b", "c"]), ("bi_of", ["b"]), ("uni", ["c"])):
        t = t.join(F.broadcast(model[name].withColumnRenamed("n", name)), keys, "left")
    t = t.crossJoin(F.broadcast(model["total"]))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.col(b), F.lit(0.0))
    p = LAMBDAS[0] * ratio("tri", "tri_of") + LAMBDAS[1] * ratio("bi", "bi_of") + LAMBDAS[2] * (F.coalesce("uni", F.lit(0)) + 1) / (F.col("total") + F.col("vocabulary"))
    return t.groupBy("word").agg(F.avg(F.log2(p)).alias("logprob"))


def numbers(values: Iterable[float]) -> Column:
    """An array of fixed numbers, made of one literal."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def percentile_in(scores: DataFrame, reference: list[float], col: str = "logprob") -> DataFrame:
    """``scores`` with ``percentile``: the share of a fixed, sorted reference sample (some thousand values) that isn't above the score."""
    return scores.withColumn("percentile", 100.0 * F.size(F.filter(numbers(sorted(reference)), lambda r: r <= F.col(col))) / len(reference))
