"""Vocabulary coverage: token classes, worklists, folding, curves, merged corpora.

Tokens come as types with their number ``n`` and the place ``place`` where they first occur, so that everything after the
first count works on distinct words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runeloom.functions.english import ly_bases_col, participle_candidates_col
from runeloom.operators.ranking import ranked
from runeloom.work import materialize

# Categories of function words -> parts of speech that they may cover.
COVERED_POS = {
    "article": ["DET", "NUM", "PRON"],
    "pronoun": ["PRON", "NOUN"],
    "possessive": ["PRON", "DET"],
    "determiner": ["DET", "PRON", "ADJ"],
    "correlative": ["ADV", "PRON", "SCONJ", "DET", "NOUN"],
    "quantifier": ["DET", "ADJ", "PRON", "ADV", "NOUN"],
    "numeral": ["NUM"],
    "preposition": ["ADP", "SCONJ", "ADV", "PART"],
    "conjunction": ["CCONJ", "SCONJ", "PRON", "DET", "ADP"],
    "particle": ["PART", "AUX", "ADV", "INTJ"],
    "interjection": ["INTJ", "ADV"],
    "verb": ["VERB", "AUX"],
}
# Fixed values: (lemma, part of speech) that the grammar of the made language absorbs.
ABSORBED = {
    "AUX": ["be", "have", "do", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "let", "ought", "need", "dare", "’ll", "’d", "’ve", "’m", "’re"],
    "PART": ["to", "not", "n't", "'s", "’s", "'", "n’t"],
    "PRON": ["there", "n’t", "’s", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves"],
    "DET": ["’s"],
    "VERB": ["be"],
}
IGNORED_POS = ("PUNCT", "SPACE", "SYM", "X")
CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV", "INTJ")
TARGETS = (0.90, 0.95, 0.97, 0.98, 0.99, 0.995)


def function_index(functions: DataFrame) -> DataFrame:
    """(word, pos): every single English word of the function words (kz, en, cat) with the parts of speech that it may cover. A qualifier in brackets is dropped; several words in a row aren't in the index."""
    cats = F.create_map(*[x for c, p in COVERED_POS.items() for x in (F.lit(c), F.array(*map(F.lit, p)))])
    e = functions.select("cat", F.explode("en").alias("w")).withColumn("word", F.regexp_replace(F.lower("w"), r" \(.*", "")).where(~F.col("word").contains(" "))
    return e.select("word", F.explode(F.try_element_at(cats, F.col("cat"))).alias("pos")).distinct()


def classify(tokens: DataFrame, index: DataFrame) -> DataFrame:
    """``tokens`` (lemma, pos, like_num) with ``bucket``: number, name, absorbed, function, content or fgap, the first that holds. Punctuation and such is left out. The index of function words is a closed class of some hundred words."""
    t = tokens.where(~F.col("pos").isin(*IGNORED_POS)).withColumn("lemma", F.lower("lemma"))
    absorbed = reduce(lambda a, b: a | b, [(F.col("pos") == p) & F.col("lemma").isin(*w) for p, w in ABSORBED.items()])
    hit = index.select(F.col("word").alias("lemma"), "pos", F.lit(True).alias("is_function"))
    t = t.join(F.broadcast(hit), ["lemma", "pos"], "left")
    bucket = F.when((F.col("pos") == "NUM") | F.col("like_num"), "number").when(F.col("pos") == "PROPN", "name").when(absorbed, "absorbed").when(F.col("is_function"), "function")
    return t.withColumn("bucket", bucket.when(F.col("pos").isin(*CONTENT_POS), "content").otherwise("fgap")).drop("is_function")


def bucket_shares(classified: DataFrame) -> DataFrame:
    """(bucket, tokens, share)."""
    n = classified.groupBy("bucket").agg(F.sum("n").alias("tokens"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("tokens").alias("total")))).select("bucket", "tokens", (F.col("tokens") / F.col("total")).alias("share"))


def sense_counts(classified: DataFrame) -> DataFrame:
    """(lemma, pos, count, place): content senses, how often, and the first place."""
    return classified.where("bucket = 'content'").groupBy("lemma", "pos").agg(F.sum("n").alias("count"), F.min("place").alias("place"))


def with_examples(ranked: DataFrame, texts: DataFrame, place_col: str, text_col: str) -> DataFrame:
    """``place`` replaced by ``example``: the first 120 characters of the text of that place, on one line. Only as many texts as senses are fetched."""
    t = texts.select(F.col(place_col).alias("place"), F.substring(F.regexp_replace(F.trim(text_col), "\n", " "), 1, 120).alias("example"))
    return ranked.join(t, "place", "left").drop("place")


def rekey(senses: DataFrame, changes: DataFrame) -> DataFrame:
    """Merge senses into others: ``changes`` (lemma, pos, to_lemma, to_pos), corrections or folds. A sense that exists keeps its place; one that only arises takes the first of those merged."""
    x = senses.join(changes, ["lemma", "pos"], "left")
    x = x.select(F.coalesce("to_lemma", "lemma").alias("lemma"), F.coalesce("to_pos", "pos").alias("pos"), "count", "place", F.col("to_lemma").isNotNull().alias("moved"))
    own = F.min(F.when(~F.col("moved"), F.col("place")))
    return x.groupBy("lemma", "pos").agg(F.sum("count").alias("count"), F.coalesce(own, F.min("place")).alias("place"))


def move_bucket(classified: DataFrame, items: DataFrame, bucket: str) -> DataFrame:
    """Content senses of ``items`` (lemma, pos) counted as ``bucket``: corrections of the tagger (function words) or words to skip (absorbed)."""
    x = classified.join(F.broadcast(items.select("lemma", "pos", F.lit(True).alias("hit"))), ["lemma", "pos"], "left")
    return x.withColumn("bucket", F.when(F.col("hit") & (F.col("bucket") == "content"), bucket).otherwise(F.col("bucket"))).drop("hit")


def _best(cands: DataFrame, targets: DataFrame, to_pos: str) -> DataFrame:
    """Of every sense's candidates (lemma, pos, place, to_lemma), the first that is a target's lemma."""
    hit = cands.join(targets.select(F.col("lemma").alias("to_lemma")).distinct(), "to_lemma", "left_semi")
    return hit.groupBy("lemma", "pos").agg(F.min_by("to_lemma", "place").alias("to_lemma")).withColumn("to_pos", F.lit(to_pos))


def fold_adverbs(senses: DataFrame) -> DataFrame:
    """Adverbs whose adjective is among the senses are counted with it: (lemma, pos, to_lemma, to_pos)."""
    adv = senses.where("pos = 'ADV'").select("lemma", "pos", F.posexplode(F.concat(F.array("lemma"), ly_bases_col(F.col("lemma")))).alias("place", "to_lemma"))
    return _best(adv, senses.where("pos = 'ADJ'"), "ADJ")


def fold_participles(senses: DataFrame) -> DataFrame:
    """Adjectives that are participles of a verb among the senses are counted with it. Comes after the adverbs."""
    adj = senses.where("pos = 'ADJ'").select("lemma", "pos", F.posexplode(participle_candidates_col(F.col("lemma"))).alias("place", "c"))
    return _best(adj.select("lemma", "pos", "place", F.col("c.verb").alias("to_lemma")), senses.where("pos = 'VERB'"), "VERB")


def worklist(senses: DataFrame, words: int | Column, free: int | Column) -> DataFrame:
    """(rank, lemma, pos, count, per_million, cum_coverage, place), most frequent first, ties by lemma and part of speech. ``words``: all tokens; ``free``: those that need no entry.

    Made on distinct senses, after all counting; they are ranked by range, so no task holds them all."""
    x = ranked(senses.select("lemma", "pos", "count", "place", F.lit(words).alias("__words"), F.lit(free).alias("__free")), F.desc("count"), "lemma", "pos", total="count")
    return x.select("rank", "lemma", "pos", "count", (F.col("count") * 1e6 / F.col("__words")).alias("per_million"), ((F.col("running") + F.col("__free")) / F.col("__words")).alias("cum_coverage"), "place")


def entries_needed(ranked: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """(target, needed): the smallest rank whose coverage reaches each target, null where none does."""
    return ranked.agg(*[F.min(F.when(F.col("cum_coverage") >= t, F.col("rank"))).alias(str(i)) for i, t in enumerate(targets)]).select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(str(i)).alias("needed")) for i, t in enumerate(targets)])).alias("x")).select("x.*")


def coverage_at(ranked: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """(k, coverage) for each k that the worklist reaches."""
    return ranked.where(F.col("rank").isin(*ks)).select(F.col("rank").alias("k"), F.col("cum_coverage").alias("coverage"))


def pos_mix(ranked: DataFrame, top: int = 2000) -> DataFrame:
    return ranked.where(F.col("rank") <= top).groupBy("pos").agg(F.count(F.lit(1)).alias("senses"))


def gap_words(classified: DataFrame, top: int = 60) -> DataFrame:
    """The most frequent words of closed classes that no function word covers."""
    return classified.where("bucket = 'fgap'").groupBy("lemma", "pos").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "lemma", "pos").limit(top)


def coverage(tokens: DataFrame, functions: DataFrame, alias: DataFrame | None = None, function_items: DataFrame | None = None, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(classified tokens, worklist): classes, corrections (aliases, then function words, then skipped ones), adverbs, participles, ranks."""
    c = classify(tokens, function_index(functions))
    if alias is not None:
        a = alias.select("lemma", "pos", "to_lemma", "to_pos")
        x = c.join(F.broadcast(a), ["lemma", "pos"], "left")
        hit = F.col("to_lemma").isNotNull() & (F.col("bucket") == "content")
        c = x.withColumns({"lemma": F.when(hit, F.col("to_lemma")).otherwise(F.col("lemma")), "pos": F.when(hit, F.col("to_pos")).otherwise(F.col("pos"))}).drop("to_lemma", "to_pos")
    c = move_bucket(c, function_items, "function") if function_items is not None else c
    c = move_bucket(c, skip, "absorbed") if skip is not None else c
    c = materialize(c, "classified")  # distinct words: small beside the texts, which are read once
    senses = materialize(sense_counts(c), "senses")
    senses = rekey(senses, fold_adverbs(senses))
    senses = rekey(senses, fold_participles(senses))
    total = c.agg(F.sum("n").alias("words"), F.sum(F.when(~F.col("bucket").isin("content", "fgap"), F.col("n")).otherwise(0)).alias("free"))
    return c, worklist(senses.crossJoin(F.broadcast(total)), F.col("words"), F.col("free"))


def merge_worklists(lists: list[DataFrame]) -> DataFrame:
    """(lemma, pos, count, per_million, example) over several corpora: the mean rate (0 where a corpus lacks the sense), summed counts, the example of the corpus with the highest rate, the first of equals."""
    x = reduce(DataFrame.unionByName, [d.select("lemma", "pos", "count", "per_million", "example", F.lit(i).alias("corpus")) for i, d in enumerate(lists)])
    return x.groupBy("lemma", "pos").agg(F.sum("count").alias("count"), (F.sum("per_million") / len(lists)).alias("per_million"), F.max_by("example", F.struct("per_million", -F.col("corpus"))).alias("example"))


def merged_worklist(merged: DataFrame, free: float) -> DataFrame:
    """The merged worklist with ``rank`` and ``cum_coverage``: the mean share that needs no entry (``free``) and the summed mean rates up to each sense."""
    x = ranked(merged.withColumn("__rate", F.col("per_million") / 1e6), F.desc("per_million"), "lemma", "pos", total="__rate")
    return x.select("rank", "lemma", "pos", "count", "per_million", (F.col("running") + F.lit(free)).alias("cum_coverage"), "example")


def goal_entries(merged: DataFrame, rates: DataFrame, free: DataFrame, covered: DataFrame, goal: float) -> DataFrame:
    """The smallest number of uncovered senses, taken in the merged order, with which every corpus reaches ``goal``: (needed, senses).

    ``rates``: (corpus, lemma, pos, per_million); ``free``: (corpus, share that needs no entry). 0 if all reach it already; all of them if never."""
    known = covered.select("lemma", "pos").distinct()
    base = rates.join(known, ["lemma", "pos"], "left_semi").groupBy("corpus").agg((F.sum("per_million") / 1e6).alias("known"))
    base = free.join(base, "corpus", "left").select("corpus", (F.col("free") + F.coalesce("known", F.lit(0.0))).alias("start"))
    todo = ranked(merged.join(known, ["lemma", "pos"], "left_anti"), F.desc("per_million"), "lemma", "pos").select("lemma", "pos", F.col("rank").alias("n"))
    run = Window.partitionBy("corpus").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    steps = rates.join(todo, ["lemma", "pos"]).join(F.broadcast(base), "corpus").select("corpus", "n", (F.col("start") + F.sum(F.col("per_million") / 1e6).over(run)).alias("got"))
    reached = steps.groupBy("corpus").agg(F.min(F.when(F.col("got") >= goal, F.col("n"))).alias("n"))
    each = base.join(reached, "corpus", "left").select(F.when(F.col("start") >= goal, 0).otherwise(F.col("n")).alias("n"))
    size = todo.agg(F.count(F.lit(1)).alias("senses"))
    return each.agg(F.max("n").alias("most"), F.count_if(F.col("n").isNull()).alias("never")).crossJoin(size).select(F.when(F.col("never") > 0, F.col("senses")).otherwise(F.coalesce("most", F.lit(0))).alias("needed"), "senses")


def covered_share(ranked: DataFrame, senses: DataFrame, free: float | Column) -> DataFrame:
    """The share of tokens that a lexicon's senses cover, from the worklist's rates."""
    hit = ranked.join(senses.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_semi")
    return hit.agg((F.coalesce(F.sum("per_million"), F.lit(0.0)) / 1e6 + free).alias("covered"), F.count(F.lit(1)).alias("senses"))


def next_uncovered(ranked: DataFrame, senses: DataFrame, k: int = 40) -> DataFrame:
    """The most frequent senses that the lexicon lacks."""
    return ranked.join(senses.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_anti").orderBy("rank").limit(k)
