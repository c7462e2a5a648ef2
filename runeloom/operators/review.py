"""Batches of new words for review: propose, and apply what was decided.

Which senses a batch holds, what they depend on and which share a word is told by joins; making words for some
hundred senses is sequential by nature and done on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runeloom.functions.morphology import inflect
from runeloom.operators.lexicon import merge_entries, validate
from runeloom.operators.wordgen import RELAXATIONS, Model, Style, Taken, WordLists, apart, candidates, reference_scores, syllables_for

FIELDS = ("rank", "english", "pos", "count", "example", "proposed", "origin", "from_or_base", "alt1", "alt2", "alt3", "decision", "note")
SCHEMA = ", ".join(f"`{f}` string" for f in FIELDS)
YES, NO = ("", "ok", "y", "yes"), ("x", "n", "no", "skip")


@dataclass
class Seeds:
    """Decisions made beforehand: sense "lemma/POS" -> {kz, origin, from} or {base: "@sense+TAG" or "root+TAG"} or {same: sense}; extra senses; lemmas whose senses don't share a word."""

    senses: dict[str, dict] = field(default_factory=dict)
    extra: list[str] = field(default_factory=list)
    homonyms: list[str] = field(default_factory=list)

    def needs(self) -> list[tuple[str, str]]:
        refs = {s: d.get("same") or (d["base"][1:].split("+")[0] if d.get("base", "").startswith("@") else None) for s, d in self.senses.items()}
        return [(s, r) for s, r in refs.items() if r]


def select_batch(worklist: DataFrame, covered: DataFrame, seeds: Seeds, n: int) -> DataFrame:
    """(sense, rank, place): the ``n`` most frequent senses that aren't covered, the extra ones, and what they need, whatever the depth."""
    spark = worklist.sparkSession
    have = covered.select(F.concat_ws("/", "lemma", "pos").alias("sense")).distinct()
    ranked = worklist.select(F.concat_ws("/", "lemma", "pos").alias("sense"), F.col("rank").cast("bigint").alias("rank"))
    batch = ranked.join(have, "sense", "left_anti").orderBy("rank").limit(n).select("sense", F.lit(0).alias("step"), F.col("rank").alias("o"))
    extra = spark.createDataFrame([(s, i) for i, s in enumerate(seeds.extra)], "sense string, o bigint")
    batch = batch.unionByName(extra.join(have, "sense", "left_anti").select("sense", F.lit(1).alias("step"), "o"))
    needs = spark.createDataFrame(seeds.needs(), "sense string, need string")
    batch.createOrReplaceTempView("__batch")
    needs.join(have.withColumnRenamed("sense", "need"), "need", "left_anti").createOrReplaceTempView("__needs")
    closure = spark.sql("""WITH RECURSIVE c AS (SELECT sense, step, o FROM __batch UNION ALL SELECT n.need, c.step + 2, c.o FROM c JOIN __needs n ON n.sense = c.sense WHERE c.step < 40) SELECT * FROM c""")
    first = closure.groupBy("sense").agg(F.min(F.struct("step", "o")).alias("f"))
    return first.join(ranked, "sense", "left").select("sense", "rank", F.row_number().over(Window.orderBy("f", "sense")).alias("place"))


def shared_leaders(batch: DataFrame, covered: DataFrame, seeds: Seeds) -> DataFrame:
    """(sense, leader): senses that take the word of another sense of their lemma: one fixed beforehand, else one of the lexicon, else the most frequent."""
    spark = batch.sparkSession
    fixed = spark.createDataFrame([(s, "kz" in d) for s, d in seeds.senses.items()], "sense string, fixed boolean")
    x = batch.join(F.broadcast(fixed), "sense", "left").withColumn("lemma", F.expr("left(sense, length(sense) - length(substring_index(sense, '/', -1)) - 1)"))
    x = x.where(~F.col("lemma").isin(*seeds.homonyms)) if seeds.homonyms else x
    owner = covered.groupBy("lemma").agg(F.min(F.concat_ws("/", "lemma", "pos")).alias("owner"))
    lead = x.groupBy("lemma").agg(F.min_by(F.when(F.col("fixed"), F.col("sense")), F.when(F.col("fixed"), F.col("place"))).alias("seeded"), F.min_by("sense", "place").alias("top")).join(owner, "lemma", "left")
    lead = lead.select("lemma", F.coalesce("seeded", "owner", "top").alias("leader"))
    return x.where("fixed is null").join(lead, "lemma").where("sense <> leader").select("sense", "leader")


def propose(spark: SparkSession, worklist: DataFrame, covered: DataFrame, taken: list[tuple[str, str]], style: Style, model: Model, lists: WordLists, seeds: Seeds, n: int = 600, seed: int = 1) -> DataFrame:
    """A batch for review, in the columns FIELDS. ``covered``: (lemma, pos, kz); ``taken``: (word, pos) of the lexicon, pos empty for function words.

    Every sense gets a word: fixed, shared, derived, or a new root with three alternatives; none clashes with the lexicon or another of the batch."""
    chosen = select_batch(worklist, covered, seeds, n).orderBy("place").collect()
    known = {f"{r.lemma}/{r.pos}": r.kz for r in covered.collect()}
    leader = {r.sense: r.leader for r in shared_leaders(spark.createDataFrame(chosen, "sense string, rank bigint, place int"), covered, seeds).collect()} if chosen else {}
    info = {f"{r.lemma}/{r.pos}": r for r in worklist.join(spark.createDataFrame([(r.sense.rpartition("/")[0], r.sense.rpartition("/")[2]) for r in chosen], "lemma string, pos string"), ["lemma", "pos"], "left_semi").collect()}
    pos_of: dict[str, set[str]] = {}
    for r in chosen:
        pos_of.setdefault(leader.get(r.sense, r.sense), set()).add(r.sense.rpartition("/")[2])
    out: dict[str, dict] = {s: {"proposed": d["kz"], "origin": d.get("origin", "invented"), "from_or_base": d.get("from", ""), "alts": []} for r in chosen if (d := seeds.senses.get(s := r.sense)) and "kz" in d}
    given = Taken(lists)
    for w, p in [*taken, *((o["proposed"], "") for o in out.values())]:
        given.add(w, [p] if p else [])
    reference = reference_scores(spark, style, model)
    made: dict[int, list[tuple[str, float]]] = {}
    pools: dict[tuple[int, float], list[str]] = {}

    def take(count: int, syllables: int, pos: set[str]) -> list[str]:
        got: list[str] = []
        for more, least in RELAXATIONS:
            key = (syllables + more, least)
            if key[0] not in made:
                made[key[0]] = candidates(spark, style, model, lists, 40_000, key[0], reference=reference)
            if key not in pools:
                pools[key] = [w for w, _ in apart(made[key[0]], max(60, 8 * len(chosen)), least)]
            pool = pools[key]
            for w in list(pool):
                if len(got) == count:
                    return got
                if given.free(w, pos):
                    got.append(w)
                    pool.remove(w)
                    given.add(w, pos)
        if len(got) < count:
            raise RuntimeError(f"no {count} words of about {syllables} syllables are left")
        return got

    fresh = [r for r in chosen if r.sense not in out and r.sense not in leader and not seeds.senses.get(r.sense, {}).keys() & {"base", "same"}]
    for r in fresh:
        out[r.sense] = {"proposed": take(1, syllables_for(r.rank, seed, r.sense), pos_of.get(r.sense, set()))[0], "origin": "invented", "from_or_base": "", "alts": []}
    for r in fresh:  # after all words are given, so that no alternative clashes with one
        out[r.sense]["alts"] = take(3, syllables_for(r.rank, seed, r.sense), pos_of.get(r.sense, set()))
    word = lambda s: out[s]["proposed"] if s in out else known.get(s)
    for _ in range(3):
        for r in chosen:
            d = seeds.senses.get(r.sense, {})
            ref = d.get("same") or leader.get(r.sense)
            if ref and word(ref):
                out[r.sense] = {"proposed": word(ref), "origin": "shared", "from_or_base": "@" + ref, "alts": []}
            elif "base" in d:
                root, *tags = d["base"].split("+")
                root = word(root[1:]) if root.startswith("@") else root
                if root:
                    out[r.sense] = {"proposed": inflect(root, *tags), "origin": "derived", "from_or_base": d["base"], "alts": []}
    if missing := [r.sense for r in chosen if r.sense not in out]:
        raise RuntimeError(f"unresolved senses: {missing}")
    text = lambda v: "" if v is None else str(v)
    rows = []
    for r in chosen:
        o, i = out[r.sense], info.get(r.sense)
        lemma, _, pos = r.sense.rpartition("/")
        alts = (o["alts"] + ["", "", ""])[:3]
        rows.append((text(r.rank), lemma, pos, text(i["count"]) if i else "", text(i["example"]) if i and "example" in i else "", o["proposed"], o["origin"], o["from_or_base"], *alts, "", ""))
    return spark.createDataFrame(rows, SCHEMA)


def decide(review: DataFrame) -> DataFrame:
    """``review`` with ``final``: the proposal (blank, ok, y, yes), an alternative (1 to 3), null where refused (x, n, no, skip), else the word that was written in."""
    d = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    final = F.when(d.isin(*YES), F.col("proposed")).when(d.isin(*NO), F.lit(None)).when(d == "1", F.col("alt1")).when(d == "2", F.col("alt2")).when(d == "3", F.col("alt3")).otherwise(d)
    return review.withColumn("final", F.nullif(final, F.lit("")))


def accepted(review: DataFrame, covered: DataFrame) -> DataFrame:
    """(kz, sense, origin, from_lang, base) of what was accepted. Shared words follow the decision on the sense that they share; derived ones are made anew from their base's final word."""
    x = decide(review).withColumn("sense", F.concat_ws("/", "english", "pos")).where("final is not null")
    known = covered.select(F.concat_ws("/", "lemma", "pos").alias("sense"), F.col("kz").alias("final"))
    ref = F.regexp_extract("from_or_base", r"^@([^+]+)", 1)
    for _ in range(3):  # chains of shared and derived words
        words = x.select("sense", "final").unionByName(known).groupBy("sense").agg(F.first("final").alias("ref_word"))
        x = x.withColumn("ref", ref).join(words.withColumnRenamed("sense", "ref"), "ref", "left")
        own = ~F.lower(F.trim(F.coalesce("decision", F.lit("")))).isin(*YES)
        tags = F.slice(F.split("from_or_base", r"\+"), 2, 99)
        x = x.withColumn("final", F.when(own, F.col("final")).when((F.col("origin") == "shared") & F.col("ref_word").isNotNull(), F.col("ref_word")).when((F.col("origin") == "derived") & F.col("ref_word").isNotNull(), _inflected("ref_word", tags)).otherwise(F.col("final")))
        x = x.withColumn("root", F.coalesce("ref_word", F.split("from_or_base", r"\+")[0])).drop("ref", "ref_word")
    changed = F.col("final") != F.col("proposed")
    origin = F.when(changed & (F.col("origin") == "derived") & ~F.lower(F.trim(F.coalesce("decision", F.lit("")))).isin(*YES), "invented").otherwise(F.col("origin"))
    base = F.when(F.col("origin") == "derived", F.concat_ws("+", F.array("root"), F.slice(F.split("from_or_base", r"\+"), 2, 99)))
    return x.select(F.col("final").alias("kz"), "sense", origin.alias("origin"), F.when(F.col("origin") == "borrowed", F.col("from_or_base")).alias("from_lang"), F.when(origin == "derived", base).alias("base"))


def _inflected(root: str, tags):
    from runeloom.functions.morphology import inflect_col

    return inflect_col(F.col(root), tags)


def apply_review(content: DataFrame, functions: DataFrame, review: DataFrame, covered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the lexicon with the accepted words, findings about it): nothing is to be written while there are errors."""
    new = merge_entries(content, accepted(review, covered))
    return new, validate(new, functions)
