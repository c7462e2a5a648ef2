"""Words of a text column as counted types, with lemma and part of speech looked up in the lexicon.

This is the relational tagger: no context, every type once. Another tagger may supply the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.operators.lexicon import sense_index
from runeloom.operators.vocabulary import COVERED_POS, function_index
from runeloom.work import spread

WORD = r"[\p{L}\p{N}]+"
#: Endings taken off a word, in this order of preference, what replaces them, and how long the word must be at least.
ENDINGS = (("s", "", 4), ("es", "", 5), ("ies", "y", 5), ("ed", "", 5), ("ed", "e", 5), ("ied", "y", 5), ("ing", "", 6), ("ing", "e", 6), ("er", "", 5), ("est", "", 6))


def word_types(df: DataFrame, text_col: str, place_col: str) -> DataFrame:
    """(word, n, place): distinct words as written, how often, and the first place. Partial counts precede the only shuffle."""
    w = spread(df.select(text_col, place_col)).select(F.col(place_col).alias("place"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))


def tag_types(types: DataFrame, content: DataFrame, functions: DataFrame) -> DataFrame:
    """``types`` with (lemma, pos, like_num): function words by the first part of speech of their category, then words of the lexicon as they are or without an ending,
    then numbers, names (with a capital), and nouns. The lexicon is a dictionary of some thousand senses; it is broadcast by Spark where it is small enough."""
    low = F.lower("word")
    tries = F.array(F.struct(F.lit(0).alias("place"), low.alias("lemma")), *[F.struct(F.lit(i).alias("place"), F.when((F.length("word") >= n) & low.endswith(e), F.concat(F.expr(f"left(lower(word), length(word) - {len(e)})"), F.lit(r))).alias("lemma")) for i, (e, r, n) in enumerate(ENDINGS, 1)])
    cands = types.select("word", F.explode(tries).alias("t")).select("word", F.col("t.place").alias("k"), F.col("t.lemma").alias("lemma")).where("lemma is not null")
    best = cands.join(sense_index(content).select("lemma", "pos"), "lemma").groupBy("word").agg(F.min(F.struct("k", "pos", "lemma")).alias("b")).select("word", "b.*")
    fun = function_index(functions).groupBy("word").agg(F.min("pos").alias("fpos")).withColumnRenamed("word", "low")
    x = types.withColumn("low", low).join(F.broadcast(fun), "low", "left").join(best, "word", "left")
    digits = F.col("word").rlike(r"^\p{N}+$")
    pos = F.when(digits, "NUM").when(F.col("fpos").isNotNull(), F.col("fpos")).when(F.col("pos").isNotNull(), F.col("pos")).when(F.col("word").rlike(r"^\p{Lu}"), "PROPN").otherwise("NOUN")
    lemma = F.when(digits | F.col("fpos").isNotNull() | F.col("lemma").isNull(), F.col("low")).otherwise(F.col("lemma"))
    return x.select("word", "n", "place", lemma.alias("lemma"), pos.alias("pos"), digits.alias("like_num"))


def tags_sql(source: str) -> str:
    """DuckDB: WITH tables up to ``tagged`` (word, n, place, lemma, pos, like_num, bucket columns left to the caller); ``source`` selects (place, text)."""
    tries = " UNION ALL ".join(["SELECT word, 0 AS k, lower(word) AS lemma FROM types", *[f"SELECT word, {i}, lower(word)[:-{len(e) + 1}] || '{r}' FROM types WHERE length(word) >= {n} AND lower(word) LIKE '%{e}'" for i, (e, r, n) in enumerate(ENDINGS, 1)]])
    cats = ", ".join(f"('{c}', '{p}')" for c, x in COVERED_POS.items() for p in x)
    return rf"""src AS ({source}),
types AS (SELECT word, count(*) AS n, min(place) AS place FROM (SELECT place, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS word FROM src) GROUP BY word),
sense AS (SELECT kz, regexp_extract(s, '^(.*)/', 1) AS lemma, regexp_extract(s, '([^/]*)$', 1) AS pos FROM (SELECT kz, unnest(en) AS s FROM lexicon)),
tries AS ({tries}),
best AS (SELECT word, min({{'k': k, 'pos': pos, 'lemma': lemma}}) AS b FROM tries JOIN (SELECT DISTINCT lemma, pos FROM sense) USING (lemma) GROUP BY word),
cats(cat, pos) AS (VALUES {cats}),
fidx AS (SELECT DISTINCT word, pos FROM (SELECT cat, regexp_replace(lower(unnest(en)), ' \(.*', '') AS word FROM function_words) JOIN cats USING (cat) WHERE word NOT LIKE '% %'),
fpos AS (SELECT word AS low, min(pos) AS fpos FROM fidx GROUP BY word),
tagged AS (SELECT t.word, n, place, regexp_matches(t.word, '^\p{{N}}+$') AS like_num,
  CASE WHEN like_num OR fpos IS NOT NULL OR b IS NULL THEN lower(t.word) ELSE b.lemma END AS lemma,
  CASE WHEN like_num THEN 'NUM' WHEN fpos IS NOT NULL THEN fpos WHEN b IS NOT NULL THEN b.pos WHEN regexp_matches(t.word, '^\p{{Lu}}') THEN 'PROPN' ELSE 'NOUN' END AS pos
  FROM types t LEFT JOIN fpos ON low = lower(t.word) LEFT JOIN best ON best.word = t.word)"""
