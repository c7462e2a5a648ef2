"""The corpus from stories to packed files: translate, report, pack."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeloom.functions.rewriting import Language
from runeloom.functions.text import split_of
from runeloom.operators import packing
from runeloom.operators.translation import translate
from runeloom.sources import records
from runeloom.work import materialize


#: Shards that the manifest lists; the table shard_stats beside it has all.
LISTED_SHARDS = 10_000


@dataclass(frozen=True)
class Options:
    source: str = "stories"
    shard_size: int = 5000
    max_stories: int | None = None
    max_loan_rate: float = 0.05
    min_words: int = 20
    val_share: float = 0.05
    rows_per_file: int = 100_000


def translate_stories(stories: DataFrame, lang: Language, o: Options) -> DataFrame:
    """(shard, ordinal, id, en, kz, words, loans, loan_rate, unknown, names, loan_words) of stories (ordinal, en). Shards depend on ordinals alone; loan words are a sorted list with repeats."""
    s = stories.where(F.col("ordinal") < o.max_stories) if o.max_stories is not None else stories
    t = translate(s, "ordinal", "en", lang, keep_text=True)
    bag = F.array_sort(F.flatten(F.transform(F.map_entries("loan_words"), lambda e: F.array_repeat(e["key"], e["value"].cast("int")))))
    ordinal = F.col("id")
    return t.select(packing.shard_of(ordinal, o.shard_size).alias("shard"), ordinal.alias("ordinal"), F.concat(F.lit(o.source + "-"), ordinal.cast("string")).alias("id"), F.col("text").alias("en"), "kz", "words", "loans", "loan_rate", "unknown", "names", bag.alias("loan_words"))


def run_translate(stories: DataFrame, lang: Language, out: str, o: Options, versions: dict[str, str] | None = None, allow_mixed: bool = False) -> None:
    """Write the shards that aren't there yet (or are too short) and the manifest. Refuses to go on with other versions, or another shard size, than the run began with."""
    spark, manifest = stories.sparkSession, f"{out}/translate_manifest.json"
    now = {"source": o.source, "shard_size": o.shard_size, "fingerprint": versions or {}}
    if records.exists(spark, manifest):
        old = json.loads(records.read_text(spark, manifest))
        if old["shard_size"] != o.shard_size:
            raise ValueError(f"the run has shards of {old['shard_size']} stories")
        if old["fingerprint"] != now["fingerprint"] and not allow_mixed:
            raise ValueError("the run began with another lexicon or code; allow_mixed goes on all the same")
    s = stories.withColumn("shard", packing.shard_of(F.col("ordinal"), o.shard_size))
    s = s.where(F.col("ordinal") < o.max_stories) if o.max_stories is not None else s
    if records.exists(spark, f"{out}/shards"):
        s = records.missing_shards(s, spark.read.json(f"{out}/shards").select("shard"))
    records.write_shards(translate_stories(s.drop("shard"), lang, o).drop("ordinal"), f"{out}/shards", mode="overwrite")
    done = records.read_records(spark, f"{out}/shards")
    total = packing.run_summary(done, F.col("words"), F.col("loans"), F.col("unknown")).first().asDict()
    stats = packing.shard_stats(done, "ordinal", o.shard_size, F.col("words"), F.col("loans"), F.col("unknown"))
    stats.write.mode("overwrite").parquet(f"{out}/shard_stats")
    # the table has every shard; the manifest repeats the first ones, so that the driver holds no list that grows
    first = spark.read.parquet(f"{out}/shard_stats").orderBy("shard").limit(LISTED_SHARDS).collect()
    records.write_manifest(spark, manifest, now | {"totals": total, "shards": {str(r.shard): {k: r[k] for k in ("stories", "words", "loans", "unknown")} for r in first}})


def report(spark: SparkSession, out: str) -> DataFrame:
    """Totals of a run, from its data."""
    return packing.run_summary(records.read_records(spark, f"{out}/shards"), F.col("words"), F.col("loans"), F.col("unknown"))


def run_pack(spark: SparkSession, src: str, out: str, o: Options, overwrite: bool = False) -> DataFrame:
    """Filter, dedupe and split the run's records; write Parquet of the target text, parallel lines, manifest and report. Returns the packed counts."""
    mode = "overwrite" if overwrite else "errorifexists"
    rows = records.read_records(spark, f"{src}/shards").withColumn("chars", F.length("kz"))
    args = ("en", "ordinal", F.col("unknown"), F.col("loans"), F.col("words"), o.max_loan_rate, o.min_words)
    # the filters run once; what follows reads the marked rows
    marked = packing.drop_reasons(rows.withColumn("pack_split", split_of(F.col("en"), o.val_share)), *args)
    marked = materialize(marked.select("id", "en", "kz", "chars", "words", "loans", "loan_words", "pack_split", "reason"), "packed")
    packed = marked.where("reason is null")
    records.write_parquet_shards(packed, f"{out}/kz", "kz", "pack_split", o.rows_per_file, mode)
    records.write_parallel(packed, f"{out}/parallel", "pack_split", mode)
    counts = packing.pack_counts(packed, F.col("chars"), F.col("loans"), F.col("words"))
    dropped = marked.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("stories")).orderBy("reason")
    top = packed.select(F.explode("loan_words").alias("loan")).groupBy("loan").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "loan")
    by = {r.pack_split: r.asDict() for r in counts.collect()}
    total = {k: sum(r[k] for r in by.values()) for k in ("stories", "words", "chars", "loans")}
    drops = {r.reason: r.stories for r in dropped.collect()}
    rate = round(total["loans"] / max(total["words"], 1), 4)
    records.write_manifest(spark, f"{out}/pack_manifest.json", {"options": asdict(o), "splits": by, "dropped": drops, "loan_rate": rate})
    lines = [f"# Packed corpus: {o.source}", "", f"- kept {total['stories']:,} stories; dropped {sum(drops.values()):,}: " + ", ".join(f"{k} {v:,}" for k, v in drops.items()), f"- words {total['words']:,}, characters {total['chars']:,}, loan rate {rate:.2%}", "", "## Most frequent loans", "", *records.markdown_table(top, 100)]
    records.write_text(spark, f"{out}/REPORT.md", "\n".join(lines) + "\n")
    return counts
