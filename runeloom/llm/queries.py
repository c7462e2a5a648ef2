"""The queries pN_... of the nine problems, over whole tables, and their SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeloom.llm import oracles
from runeloom.llm.format_copies import copies_of_first, copy_counts, json_field
from runeloom.llm.leaks import leaks
from runeloom.llm.near_duplicates import near_duplicate_groups
from runeloom.llm.overlap_index import overlaps
from runeloom.llm.pack import COST_SHARE, MAX_DOCS, containers
from runeloom.llm.sample import block_sample, sample_sql
from runeloom.llm.split_texts import split_texts
from runeloom.llm.terms import map_terms, term_counts, text_terms, total_records
from runeloom.llm.visual_form import alike_pairs
from runeloom.tables import table

#: TESTDATA.md: three words in a row, texts of 8 words or more, 60 % in common.
ALIKE = {"size": 3, "least_words": 8, "threshold": (3, 5)}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of near-duplicate parallel records."""
    groups = near_duplicate_groups(table(spark, d, "parallel_records", "ordinal", "en", "kz"), "ordinal", ["en", "kz"], **ALIKE)
    return groups.where(F.col("id") != F.col("group")).select(F.col("group").alias("group_ordinal"), F.col("id").alias("ordinal"))


#: 51 of the 1,024 positions of every block: 5 %.
PER_BLOCK = 51


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The chosen 5 % of the parallel records, ids as a whole."""
    rows = table(spark, d, "parallel_records", "ordinal", "id", "delivery", "en")
    return block_sample(rows, "id", "en", "ordinal", "delivery", PER_BLOCK).select("ordinal", "id", "en")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parallel records whose English texts differ but look the same."""
    pairs = alike_pairs(table(spark, d, "parallel_records", "ordinal", "en"), "ordinal", "en")
    return pairs.select(F.col("a").alias("ordinal_a"), F.col("b").alias("ordinal_b"))


def _p4_sources(spark: SparkSession, d: str):
    yield "parallel_records", table(spark, d, "parallel_records", "ordinal", "en"), "ordinal", F.col("en")
    yield "shard_lines", table(spark, d, "shard_lines", "line_no", "line"), "line_no", json_field(F.col("line"), "en")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of English stories that differ in format only, each with the first of its table."""
    a, b = (copies_of_first(df, no, text).select(F.lit(name).alias("table_name"), "first_no", "copy_no") for name, df, no, text in _p4_sources(spark, d))
    return a.unionByName(b)


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct English story of either table with the number of its copies."""
    a, b = (copy_counts(df, no, text).select(F.lit(name).alias("table_name"), "first_no", "copies", "collided") for name, df, no, text in _p4_sources(spark, d))
    return a.unionByName(b)


def _p5(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "parallel_records", "ordinal", "split", "en", "kz")
    return overlaps(rows, "ordinal", ["en", "kz"], F.col("split").isin("val", "test"), F.col("split") == "train", **ALIKE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a train record and a val or test record that are alike."""
    return _p5(spark, d).select(F.least("train", "eval").alias("ordinal_a"), F.greatest("train", "eval").alias("ordinal_b")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Per split and source: evaluation records that train holds, exactly or nearly, and the train records that hold them."""
    pairs = _p5(spark, d).groupBy("eval").agg(F.max(F.col("shared") / F.col("either")).alias("best"), F.count_distinct("train").alias("n"))
    rows = table(spark, d, "parallel_records", "ordinal", "split", "source").where(F.col("split").isin("val", "test"))
    r = rows.join(pairs, F.col("ordinal") == F.col("eval"), "left").groupBy("split", "source")
    return r.agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("in_train"), F.count_if(F.col("best") == 1).alias("exact"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term of the texts in the made language and of the loan and unknown words, with its counts and mark."""
    kz = table(spark, d, "parallel_records", "kz")
    blocks, totals = text_terms(kz, "kz", "kz"), total_records(kz, "kz", F.count("kz"))
    for field in ("loan_words", "unknown_words"):
        stats = table(spark, d, "text_stats", "ordinal", field)
        blocks = blocks.unionByName(map_terms(stats, "ordinal", field, field))
        totals = totals.unionByName(total_records(stats, field, F.count_distinct("ordinal")))
    return term_counts(blocks, totals).withColumnRenamed("field", "field_name")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms that are too rare or too common."""
    return p6_terms(spark, d).where("mark is not null").select("field_name", "term", "mark")


def _limits(spark: SparkSession, d: str) -> list:
    """The rows of size_limits, a table of a few rows that never grows."""
    return sorted(tuple(r) for r in table(spark, d, "size_limits", "limit_name", "capacity", "overlap").collect())


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The documents' texts in containers of each capacity."""
    limits = [(n, c) for n, c, _ in _limits(spark, d)]
    return containers(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", limits).withColumnRenamed("id", "doc_id")


def p7_room(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each capacity, the tokens in them and the shares of room for tokens, documents and attention cost that stay unused."""
    t = F.col("tokens")
    x = p7_containers(spark, d).where("container is not null").groupBy("limit_name", "capacity")
    x = x.agg(F.count_distinct("container").alias("containers"), F.sum(t).alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(t * t).alias("cost"))
    free = lambda used, most: 1 - F.col(used) / (F.col("containers") * most)
    return x.select("limit_name", "capacity", "containers", "tokens", free("tokens", F.col("capacity")).alias("unused"), free("items", F.lit(MAX_DOCS)).alias("documents_unused"), free("cost", COST_SHARE * F.col("capacity") * F.col("capacity")).alias("cost_unused"))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each capacity, the documents that are assigned and how often a rule of the packing is broken (SQL expects all documents and no breach)."""
    x = p7_containers(spark, d)
    t = F.col("tokens")
    one = x.where("container is not null").groupBy("limit_name", "container").agg(F.sum(t).alias("tokens"), F.count(F.lit(1)).alias("items"), F.sum(t * t).alias("cost"), F.first("capacity").alias("capacity"))
    full = F.col("capacity") * F.col("capacity") * COST_SHARE
    held = one.groupBy("limit_name").agg(F.count_if(F.col("tokens") > F.col("capacity")).alias("over_tokens"), F.count_if(F.col("items") > MAX_DOCS).alias("over_documents"), F.count_if((F.col("items") > 1) & (F.col("cost") > full + 0.5)).alias("over_cost"))
    doc = x.groupBy("limit_name", "capacity", "doc_id").agg(F.sum(t).alias("tokens"), F.count(F.lit(1)).alias("items"), F.count_if((t > 0) & (t < F.col("capacity"))).alias("parts"), F.count_if(F.col("container").isNull()).alias("none"))
    doc = doc.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("documents"), F.sum("none").alias("without_tokens"), F.count_if((F.col("parts") > 1) | (F.col("items") > F.ceil(F.col("tokens") / F.col("capacity")) + F.col("none"))).alias("cut_needlessly"))
    out = doc.join(held, "limit_name", "left")
    return out.select("limit_name", "capacity", "documents", "without_tokens", "cut_needlessly", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("over_tokens", "over_documents", "over_cost")])


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the documents' texts that are over a limit."""
    return split_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", _limits(spark, d)).withColumnRenamed("id", "doc_id")


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item: 12 of its words in a row, or all words of a shorter one."""
    return _p8(spark, d).where("run >= need").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Each evaluation item with the number of documents that hold it in equal words, and in words of which some were substituted (12 or more, 3 of 4 equal)."""
    x = _p8(spark, d).where("run >= need or (span >= 12 and equal * 4 >= span * 3)")
    n = x.groupBy("item").agg(F.count_if(F.expr("run >= need")).alias("exact_docs"), F.count(F.lit(1)).alias("docs"), F.max("equal").alias("most_words"))
    it = table(spark, d, "eval_items", "item_id", "suite", "split").join(n, F.col("item_id") == F.col("item"), "left")
    return it.select("item_id", "suite", "split", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("exact_docs", "docs", "most_words")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_sample": p1_sample, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_counts": p4_counts, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_terms": p6_terms, "p7_containers": p7_containers, "p7_room": p7_room, "p7_checks": p7_checks, "p8_found": p8_found, "p8_report": p8_report, "p9_pieces": p9_pieces}
ORACLES: dict[str, str] = oracles.ORACLES | {"p1_sample": sample_sql("parallel_records", "ordinal, id, en", "id", "en", "ordinal", "delivery", PER_BLOCK)}
