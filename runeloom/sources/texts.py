"""Story files, worklists, review batches, word lists of source languages."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MARKER = "<|endoftext|>"
WORKLIST = "rank INT, lemma STRING, pos STRING, count BIGINT, per_million DOUBLE, cum_coverage DOUBLE, example STRING"
STRIP = r"(?U)^\s+|\s+$"


def read_stories(spark: SparkSession, path: str, marker: str = MARKER, keep_blank: bool = False, limit: int | None = None) -> DataFrame:
    """(ordinal, en): the stories of text files that are separated by lines with ``marker``; the rest of such a line is dropped, stories are stripped. Blank ones are
    dropped before they are numbered unless ``keep_blank``; ``limit`` keeps the first ones.

    Chunks between markers are read in parallel, in splits of any size, and numbered by file and place with one small count for each partition."""
    # a marker's line: what precedes the marker in it goes, and what follows it up to the line's end
    x = spark.read.option("lineSep", marker).text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).toDF("value", "file", "block", "at")
    last = x.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"))  # one row for each file
    x = x.join(F.broadcast(last), "file").withColumn("is_last", F.struct("block", "at") == F.col("last"))
    order = Window.partitionBy("file", "block").orderBy("at")  # a split of a file at a time, never a file
    first = (F.col("block") == 0) & (F.row_number().over(order) == 1)
    x = x.withColumn("body", F.when(first, F.col("value")).otherwise(F.regexp_extract("value", r"(?s)^[^\n]*\n(.*)$", 1)))
    x = x.withColumn("body", F.when(F.col("is_last"), F.col("body")).otherwise(F.regexp_replace("body", r"[^\n]*\z", "")))
    x = x.withColumn("en", F.regexp_replace("body", STRIP, "")).where((F.col("en") != "") | (F.lit(keep_blank) & (F.col("body") != "")))
    per = x.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))  # one row for each split
    before = per.select("file", "block", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    out = x.select("file", "block", (F.row_number().over(order) - 1).alias("k"), "en").join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("k")).alias("ordinal"), "en")
    return out.where(F.col("ordinal") < limit) if limit is not None else out


def read_worklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(WORKLIST).option("sep", "\t").option("header", True).csv(path)


def write_worklist(df: DataFrame, path: str) -> None:
    """Tab-separated, in the order of the ranks; rates with one place, coverage with four."""
    cols = ["rank", "lemma", "pos", "count", F.round("per_million", 1).alias("per_million"), F.format_string("%.4f", F.col("cum_coverage").cast("double")).alias("cum_coverage"), F.coalesce("example", F.lit("")).alias("example")]
    df.select(*cols).orderBy("rank").coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A batch as it comes back from a spreadsheet: all columns text, a mark of byte order allowed."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def write_review(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


# --- word lists of source languages -------------------------------------------


def split_heads(head):
    """The words of an entry's head, in lower case: what stands in brackets is dropped and doesn't part a word, other signs do."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(F.replace(head, F.lit("’"), F.lit("'"))), r"\(\w+\)", ""), F.lit("([a-z]+)"), F.lit(1))


def _lines(df: DataFrame, start: str, stop: list[str]) -> DataFrame:
    """(no, line) between the first line that holds ``start`` and the next that begins with one of ``stop``; lists are documents of some thousand lines."""
    x = df.select("no", F.trim("line").alias("line"))
    begin = x.where(F.col("line").contains(start)).agg(F.min("no").alias("b"))
    x = x.crossJoin(F.broadcast(begin)).where("no > b")
    ends = x.where(" or ".join(f"startswith(line, '{s}')" for s in stop)).agg(F.min("no").alias("e"))
    return x.crossJoin(F.broadcast(ends)).where("e is null or no < e").select("no", "line")


def parse_colon_list(df: DataFrame, source: str, start: str, stop: list[str], reversed_from: str, english: list[str], names: list[str]) -> DataFrame:
    """(word, source, kind, tag, gloss) of a list "head: gloss"; after a line that begins with ``reversed_from`` head and gloss change places."""
    x = _lines(df, start, stop)
    turn = x.where(F.col("line").startswith(reversed_from)).agg(F.min("no").alias("t"))
    x = x.where(F.col("line").contains(":")).crossJoin(F.broadcast(turn))
    left, right = F.trim(F.substring_index("line", ":", 1)), F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    back = F.col("t").isNotNull() & (F.col("no") > F.col("t"))
    x = x.select("no", F.when(back, right).otherwise(left).alias("head"), F.when(back, left).otherwise(right).alias("gloss"))
    x = x.where(F.col("head").rlike(r"(?U)^\p{L}") & (F.length("head") <= 60))
    x = x.select("no", F.posexplode(split_heads(F.col("head"))).alias("k", "word"), "gloss")
    tag = F.when(F.col("word").isin(*names), "name").when(F.lower("gloss").contains("unofficial"), "unofficial").otherwise("official")
    return x.select("word", F.lit(source).alias("source"), F.when(F.col("word").isin(*english), "exclude").otherwise("native").alias("kind"), tag.alias("tag"), "gloss", "no", "k")


def parse_tagged_list(df: DataFrame, source: str, other: str, start: str, stop: list[str], english: list[str], calques: list[str]) -> DataFrame:
    """``source`` and ``other``: names of the two languages, as tags tell them. (word, source, kind, tag, gloss) of a list "Head (tag): gloss"; the head ends at the first bracket, colon or closing quote."""
    x = _lines(df, start, stop).where("line <> '' and not startswith(line, '(')")
    m = lambda k: F.regexp_extract("line", r"^([^(:”]+)(?:\(([^)]*)\))?[ :”]*(.*)$", k)
    x = x.select("no", F.trim(m(1)).alias("head"), F.lower(m(2)).alias("t"), F.trim(m(3)).alias("gloss"), F.col("line").rlike("[(:”]").alias("has")).where("has").where(F.col("head").rlike(r"(?U)^\p{Lu}"))
    t = F.col("t")
    kind = F.when(t == "ai", "exclude").when(t.contains(other) & ~t.contains(source), "dup").otherwise("native")
    tag = F.when(t.contains(source[:4]), source).when(t.contains(other[:4]), other).when(t.contains("specul"), "speculative").otherwise("uncertain")
    x = x.select("no", F.posexplode(split_heads(F.col("head"))).alias("k", "word"), kind.alias("kind"), tag.alias("tag"), "gloss")
    kind = F.when(F.col("kind") != "native", F.col("kind")).when(F.col("word").isin(*calques), "calque").when(F.col("word").isin(*english) | (F.length("word") < 2), "exclude").otherwise("native")
    return x.select("word", F.lit(source).alias("source"), kind.alias("kind"), "tag", "gloss", "no", "k")


def merge_source_words(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists, each word once a source (its first row); second-list words that copy the first list, by kind or by spelling of a native word, are left out."""
    one = lambda df: df.withColumn("rn", F.row_number().over(Window.partitionBy("word", "source").orderBy("no", "k"))).where("rn = 1").drop("rn")
    native = first.select("word").distinct()
    rest = second.where("kind <> 'dup'")
    rest = rest.where("kind <> 'native'").unionByName(rest.where("kind = 'native'").join(native, "word", "left_anti").select(*rest.columns))
    return one(first).unionByName(one(rest)).select("word", "source", "kind", "tag", "gloss")


def native_words(words: DataFrame) -> DataFrame:
    """The distinct native words that aren't names: what sounds are counted on."""
    return words.where("kind = 'native' and tag <> 'name'").select("source", "word").distinct()


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of downloaded files, to be held against their manifest."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def local_checksum(path: str) -> str:
    """The same for one large file, read in blocks."""
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def single_text(spark: SparkSession, text: str) -> DataFrame:
    """One text as a table, so that every operator also serves a command line."""
    return spark.createDataFrame([(0, text)], "ordinal bigint, en string")
