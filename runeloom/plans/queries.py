"""The registered queries of the core operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeloom.functions import english, loan, morphology, text
from runeloom.operators import glosses, lexicon, near, packing, phonotactics, tagging, translation, vocabulary, wordgen
from runeloom.operators.ranking import ranked
from runeloom.sources.records import parse_records
from runeloom.tables import table
from runeloom.work import materialize, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SHARD = 500
CAP, MIN_WORDS, VAL_SHARE = 0.05, 20, 0.05
KS = (100, 250, 500, 750, 1000, 1500, 2000, 3000, 5000)
GOAL = 0.97
CORPORA = ("train", "val", "test")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# --- texts --------------------------------------------------------------------


@query
def norm_text(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of every document, by its hash, and its words."""
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.norm_key(t).alias("norm_sha1"), text.word_count(t).alias("words"))


@query
def apostrophes(spark: SparkSession, d: str) -> DataFrame:
    """Documents with straight apostrophes, by hash."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(english.normalize_apostrophes(F.col("text"))).alias("text_md5"))


@query
def modern_english(spark: SparkSession, d: str) -> DataFrame:
    """Documents in modern English, by hash."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(english.modernize_col(F.col("text"))).alias("text_md5"))


@query
def exact_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose normal form no earlier one has."""
    return packing.dedupe(spread(table(spark, d, "documents", "doc_id", "text")), "text", "doc_id").select("doc_id")


@query
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """The split that each document's normal form chooses."""
    return spread(table(spark, d, "documents", "doc_id", "text")).where("text is not null").select("doc_id", text.split_of(F.col("text"), VAL_SHARE).alias("split"))


# --- corpus -------------------------------------------------------------------

_COUNTS = (F.col, ("unknown_n", "loans", "words"))


def _records(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "parallel_records", "ordinal", "en", "words", "loans", "unknown_n", *more))


@query
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many records each test drops; kept ones too."""
    x = packing.drop_reasons(_records(spark, d), "en", "ordinal", F.col("unknown_n"), F.col("loans"), F.col("words"), CAP, MIN_WORDS)
    return x.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("stories"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    rows = _records(spark, d, "kz").where("en is not null and kz is not null").withColumn("chars", F.length("kz"))
    return packing.pack(rows, "en", "ordinal", F.col("unknown_n"), F.col("loans"), F.col("words"), CAP, MIN_WORDS, VAL_SHARE)


@query
def pack_records(spark: SparkSession, d: str) -> DataFrame:
    """Which records are kept, and in which split."""
    return _packed(spark, d).select("ordinal", "pack_split")


@query
def pack_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stories, words, characters and loans of each split."""
    return packing.pack_counts(_packed(spark, d), F.col("chars"), F.col("loans"), F.col("words"))


@query
def shard_stats(spark: SparkSession, d: str) -> DataFrame:
    """Stories, words, loans and unknown words of each shard."""
    rows = table(spark, d, "parallel_records", "ordinal", "words", "loans", "unknown_n")
    return packing.shard_stats(rows, "ordinal", SHARD, F.col("words"), F.col("loans"), F.col("unknown_n"))


@query
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals and the loan rate."""
    rows = table(spark, d, "parallel_records", "words", "loans", "unknown_n")
    return packing.run_summary(rows, F.col("words"), F.col("loans"), F.col("unknown_n"))


@query
def top_loans(spark: SparkSession, d: str) -> DataFrame:
    """The 100 most frequent loan words."""
    return packing.top_words(table(spark, d, "text_stats", "loan_words"), "loan_words", 100)


@query
def loan_rate_hist(spark: SparkSession, d: str) -> DataFrame:
    """Stories by loan rate in hundredths."""
    return packing.rate_histogram(table(spark, d, "parallel_records", "loans", "words"), F.col("loans"), F.col("words"))


@query
def loan_bags(spark: SparkSession, d: str) -> DataFrame:
    """Each record's loan words as a sorted list with repeats, joined by spaces."""
    return table(spark, d, "text_stats", "ordinal", "loan_words").select("ordinal", F.array_join(text.bag_to_list(F.col("loan_words")), " ").alias("loan_list"))


@query
def shard_records(spark: SparkSession, d: str) -> DataFrame:
    """The records in the JSON lines of shard files."""
    return parse_records(table(spark, d, "shard_lines", "line_no", "line"), "line").select("line_no", "id", "words", "loans", "loan_rate", "unknown", "names", F.array_join("loan_words", " ").alias("loan_list"), F.md5("en").alias("en_md5"))


# --- vocabulary ---------------------------------------------------------------


def _tagged(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    rows = table(spark, d, "parallel_records", "ordinal", "en", "split")
    rows = rows.where(F.col("split") == split) if split else rows
    return tagging.tag_types(tagging.word_types(rows, "en", "ordinal"), table(spark, d, "lexicon"), table(spark, d, "function_words"))


def _coverage(spark: SparkSession, d: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    return vocabulary.coverage(_tagged(spark, d, split), table(spark, d, "function_words"))


@query
def tagged_types(spark: SparkSession, d: str) -> DataFrame:
    """Distinct English words with count, lemma and part of speech."""
    return _tagged(spark, d)


@query
def word_freq_rank(spark: SparkSession, d: str) -> DataFrame:
    """Distinct English words by frequency."""
    t = tagging.word_types(table(spark, d, "parallel_records", "ordinal", "en"), "en", "ordinal").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    return ranked(t, F.desc("n"), "word").select("word", "n", "rank")


@query
def bucket_shares(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each class and their share."""
    x = vocabulary.bucket_shares(_coverage(spark, d)[0])
    return x.select("bucket", "tokens", F.round("share", 6).alias("share"))


@query
def coverage_worklist(spark: SparkSession, d: str) -> DataFrame:
    """Content senses by frequency, adverbs and participles folded, with cumulative coverage and an example."""
    w = vocabulary.with_examples(_coverage(spark, d)[1], table(spark, d, "parallel_records", "ordinal", "en"), "ordinal", "en")
    return w.select("rank", "lemma", "pos", "count", F.round("per_million", 1).alias("per_million"), F.round("cum_coverage", 4).alias("cum_coverage"), "example")


@query
def coverage_need(spark: SparkSession, d: str) -> DataFrame:
    """Entries needed for each target of coverage."""
    return vocabulary.entries_needed(_coverage(spark, d)[1])


@query
def coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Coverage with the k most frequent entries."""
    return vocabulary.coverage_at(_coverage(spark, d)[1], KS).select("k", F.round("coverage", 6).alias("coverage"))


@query
def pos_mix(spark: SparkSession, d: str) -> DataFrame:
    """Parts of speech of the 2,000 most frequent entries."""
    return vocabulary.pos_mix(_coverage(spark, d)[1])


@query
def gap_words(spark: SparkSession, d: str) -> DataFrame:
    """Closed-class words without a function word, the 60 most frequent."""
    return vocabulary.gap_words(_coverage(spark, d)[0])


@query
def lexicon_status(spark: SparkSession, d: str) -> DataFrame:
    """The share of tokens that the lexicon's senses cover on top of those that need no entry."""
    c, w = _coverage(spark, d)
    free = c.agg((F.sum(F.when(~F.col("bucket").isin("content", "fgap"), F.col("n")).otherwise(0)) / F.sum("n")).alias("free"))
    x = vocabulary.covered_share(w, lexicon.sense_index(table(spark, d, "lexicon")), 0.0).crossJoin(F.broadcast(free))
    return x.select("senses", F.round(F.col("covered") + F.col("free"), 6).alias("covered"), F.round("free", 6).alias("free"))


@query
def next_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """The 40 most frequent senses that the lexicon lacks."""
    return vocabulary.next_uncovered(_coverage(spark, d)[1], lexicon.sense_index(table(spark, d, "lexicon"))).select("rank", "lemma", "pos", "count")


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    parts = [_coverage(spark, d, s) for s in CORPORA]
    lists = [materialize(w.withColumn("example", F.col("place").cast("string")), "worklist") for _, w in parts]
    return vocabulary.merge_worklists(lists), lists, [c for c, _ in parts]


@query
def merge_worklists(spark: SparkSession, d: str) -> DataFrame:
    """The worklists of three corpora (the splits) as one."""
    return _merged(spark, d)[0].select("lemma", "pos", "count", F.round("per_million", 4).alias("per_million"))


@query
def merged_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The merged worklist in order, with its rank and cumulative coverage over the corpora's mean share that needs no entry."""
    merged, _, classified = _merged(spark, d)
    free = [c.agg((F.sum(F.when(~F.col("bucket").isin("content", "fgap"), F.col("n")).otherwise(0)) / F.sum("n")).alias("free")).first().free or 0.0 for c in classified]
    w = vocabulary.merged_worklist(merged, sum(free) / len(free))
    return w.select("rank", "lemma", "pos", F.round("cum_coverage", 6).alias("cum_coverage"))


@query
def merge_goal(spark: SparkSession, d: str) -> DataFrame:
    """How many new senses bring every corpus to the goal."""
    merged, lists, classified = _merged(spark, d)
    rates = reduce(DataFrame.unionByName, [w.select(F.lit(s).alias("corpus"), "lemma", "pos", "per_million") for s, w in zip(CORPORA, lists)])
    free = reduce(DataFrame.unionByName, [c.agg((F.sum(F.when(~F.col("bucket").isin("content", "fgap"), F.col("n")).otherwise(0)) / F.sum("n")).alias("free")).select(F.lit(s).alias("corpus"), "free") for s, c in zip(CORPORA, classified)])
    return vocabulary.goal_entries(merged, rates, free, lexicon.sense_index(table(spark, d, "lexicon")), GOAL)


# --- words --------------------------------------------------------------------


def _types(spark: SparkSession, d: str) -> DataFrame:
    t = tagging.word_types(table(spark, d, "parallel_records", "ordinal", "en"), "en", "ordinal")
    return t.select(F.lower("word").alias("word")).distinct()


@query
def loan_respell(spark: SparkSession, d: str) -> DataFrame:
    """Every English word in the spelling of the made language."""
    return _types(spark, d).select("word", loan.respell_col(F.col("word")).alias("respelled"))


@query
def loan_stem(spark: SparkSession, d: str) -> DataFrame:
    """Loan stems of every English word as noun, verb and adjective."""
    parts = ("NOUN", "VERB", "ADJ")
    stems = F.transform(F.array(loan.respell_col(F.col("word"))), lambda w: F.struct(*[loan.with_ending(w, F.lit(p)).alias(p.lower()) for p in parts]))
    return _types(spark, d).select("word", F.explode(stems).alias("s")).select("word", "s.*")


@query
def ly_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Adjectives that an English adverb may come from, in order."""
    return _types(spark, d).where(F.col("word").endswith("ly")).select("word", F.array_join(english.ly_bases_col(F.col("word")), " ").alias("bases"))


@query
def participle_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Verbs that an English adjective may be a participle of, in order."""
    c = english.participle_candidates_col(F.col("word"))
    return _types(spark, d).where(F.col("word").rlike("(ed|ing)$")).select("word", F.array_join(F.transform(c, lambda x: F.concat(x["verb"], F.lit("+"), x["tag"])), " ").alias("verbs"))


def _roots(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lexicon", "kz", "origin").unionByName(table(spark, d, "function_words", "kz", "origin"))
    return both.select(F.col("kz").alias("word"), F.lower("origin").alias("source")).distinct()


@query
def near_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words of the made language that share a deletion neighbour."""
    w = _roots(spark, d)
    return near.near_join(w, w).where("query < hit")


@query
def within_one_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Words of the made language that are one edit apart."""
    return near.within_one_pairs(_roots(spark, d).select("word").distinct())


@query
def near_hits(spark: SparkSession, d: str) -> DataFrame:
    """The first three neighbours of each word among the others."""
    w = _roots(spark, d)
    return near.near_hits(w, w).select("query", F.array_join("hits", ",").alias("hits"))


@query
def segment_words(spark: SparkSession, d: str) -> DataFrame:
    """The sounds of every word of the made language."""
    from runeloom.functions.sounds import has_double_col, segments_col

    return _roots(spark, d).select("word").distinct().select("word", F.array_join(segments_col(F.col("word")), ".").alias("segments"), has_double_col(F.col("word")).alias("doubled"))


@query
def sound_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Segment trigrams of the words of each origin."""
    return phonotactics.trigrams(_roots(spark, d))


@query
def sound_counts(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, nuclei, endings, syllables and trigrams of the words of each origin."""
    return phonotactics.sound_counts(_roots(spark, d))


@query
def ending_percent(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent last pairs of letters, in per cent of each origin."""
    sources = ["derived", "invented"]
    x = phonotactics.percent_table(phonotactics.sound_counts(_roots(spark, d).where(F.col("source").isin(sources))), "ending2", sources)
    return x.select("key", *[F.round(c, 4).alias(c) for c in (*sources, "combined")])


@query
def blend_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Word endings blended over two origins by weight."""
    w = _roots(spark, d)
    x = phonotactics.blend(phonotactics.sound_counts(w).where("kind = 'ending2'"), w.groupBy("source").agg(F.count(F.lit(1)).alias("words")), {"invented": 0.7, "derived": 0.3})
    return x.select("key", F.round("p", 8).alias("p"))


@query
def trigram_logprob(spark: SparkSession, d: str) -> DataFrame:
    """How likely every word of the made language is under the trigram model of the lexicon."""
    w = _roots(spark, d)
    model = phonotactics.trigram_model(phonotactics.trigrams(w.select("word", F.lit("all").alias("source")).distinct()))
    return phonotactics.log_probability(w, model).select("word", F.round("logprob", 6).alias("logprob"))


@query
def paradigm_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every inflected form of every content word."""
    return lexicon.paradigm(table(spark, d, "lexicon", "kz", "en")).select("kz", "pos", F.array_join("tags", "+").alias("tags"), "form").distinct()


@query
def suffixed_words(spark: SparkSession, d: str) -> DataFrame:
    """Every word of the lexicon with the agent and likeness suffixes, where linking vowels come in."""
    w = F.col("kz")
    return table(spark, d, "lexicon", "kz").distinct().select("kz", *[morphology.attach_col(w, t).alias(t.lower()) for t in ("AGT", "LIKE", "PL", "POSS")])


@query
def sense_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The compiled index from sense to word."""
    return lexicon.sense_index(table(spark, d, "lexicon", "kz", "en"))


@query
def lexicon_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Spellings used twice and senses that several words own."""
    x = lexicon.validate(table(spark, d, "lexicon"), table(spark, d, "function_words"))
    return x.where(F.col("rule").isin("spelling", "sense")).select("rule", "kz").distinct()


@query
def lexicon_check(spark: SparkSession, d: str) -> DataFrame:
    """All findings about the lexicon."""
    return lexicon.validate(table(spark, d, "lexicon"), table(spark, d, "function_words"))


# --- glosses ------------------------------------------------------------------


def _analyzed(spark: SparkSession, d: str) -> DataFrame:
    types = glosses.token_types(table(spark, d, "parallel_records", "kz"), "kz")
    return glosses.analyze_types(types, table(spark, d, "lexicon"), table(spark, d, "function_words"))


@query
def gloss_types(spark: SparkSession, d: str) -> DataFrame:
    """Distinct tokens of the texts in the made language, taken apart."""
    return _analyzed(spark, d)


@query
def validate_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each kind and their share."""
    return glosses.kind_counts(_analyzed(spark, d)).select("kind", "tokens", F.round("share", 6).alias("share"))


@query
def unknown_words(spark: SparkSession, d: str) -> DataFrame:
    """The 30 most frequent tokens that aren't of the language."""
    return glosses.unknown_words(_analyzed(spark, d))


@query
def validate_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record's words by kind, and whether its text is in the made language."""
    return glosses.validate_texts(table(spark, d, "parallel_records", "ordinal", "kz"), "ordinal", "kz", table(spark, d, "lexicon"), table(spark, d, "function_words")).withColumnRenamed("id", "ordinal")


# --- translation and new words ------------------------------------------------


@query
def translate_records(spark: SparkSession, d: str) -> DataFrame:
    """Every English story in the made language, by rule."""
    lang = translation.load_language(table(spark, d, "lexicon"), table(spark, d, "function_words"))
    return translation.translate(table(spark, d, "parallel_records", "ordinal", "en"), "ordinal", "en", lang).withColumnRenamed("id", "ordinal")


def _generator(spark: SparkSession, d: str) -> tuple[wordgen.Style, wordgen.Model, wordgen.WordLists]:
    """Style, model and word lists from the lexicon, a table that never grows. English words are those of the senses, source words those of borrowed entries."""
    w = _roots(spark, d).select("word", F.lit("all").alias("source")).distinct()
    counts = phonotactics.blend(phonotactics.sound_counts(w), w.groupBy("source").agg(F.count(F.lit(1)).alias("words")), {"all": 1.0})
    blended: dict[str, dict[str, float]] = {}
    for r in counts.where(F.col("kind").isin("initial", "final", "medial", "syllables")).orderBy("kind", "key").collect():
        blended.setdefault(r.kind, {})[r.key] = r.p
    model = {k: materialize(t, "model") for k, t in phonotactics.trigram_model(phonotactics.trigrams(w)).items()}
    senses = table(spark, d, "lexicon", "en").select(F.explode("en").alias("s")).select(F.lower(F.substring_index("s", "/", 1)).alias("e")).where("e <> ''").distinct()
    lists = wordgen.WordLists(existing=frozenset(r.word for r in w.collect() if r.word), english=frozenset(r.e for r in senses.collect()))
    return wordgen.Style(blended), model, lists


@query
def new_roots(spark: SparkSession, d: str) -> DataFrame:
    """A hundred new roots that fit the lexicon and stay apart."""
    found = wordgen.generate_roots(spark, *_generator(spark, d), 100)
    return spark.createDataFrame(found, "word string, percentile double")


@query
def root_scores(spark: SparkSession, d: str) -> DataFrame:
    """How every word of the made language scores among sampled ones, and what English words it is near to."""
    style, model, lists = _generator(spark, d)
    return wordgen.score_words(_roots(spark, d), model, wordgen.reference_scores(spark, style, model), wordgen.WordLists(english=lists.english))


def _seeds(spark: SparkSession, worklist: DataFrame):
    """Decisions made beforehand, made of the worklist: the rarest sense comes along out of turn."""
    from runeloom.operators import review

    last = worklist.orderBy(F.desc("rank")).first()
    return review.Seeds(extra=[f"{last.lemma}/{last.pos}"] if last else [])


@query
def review_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next 600 senses for the lexicon, and the rarest one out of turn, with words proposed for them."""
    from runeloom.operators import review

    style, model, lists = _generator(spark, d)
    covered = lexicon.sense_index(table(spark, d, "lexicon"))
    taken = [(r.kz, r.pos) for r in covered.select("kz", "pos").distinct().collect()] + [(r.kz, "") for r in table(spark, d, "function_words", "kz").collect()]
    w = materialize(vocabulary.with_examples(_coverage(spark, d)[1], table(spark, d, "parallel_records", "ordinal", "en"), "ordinal", "en"), "worklist")
    return review.propose(spark, w, covered, taken, style, model, lists, _seeds(spark, w), 600)
