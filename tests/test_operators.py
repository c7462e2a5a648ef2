"""Operators on small tables."""

import json
import math
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runeloom.functions.glossing import Glosser
from runeloom.functions.register import register, register_stories
from runeloom.functions.rewriting import Language
from runeloom.operators import glosses, lexicon, near, packing, phonotactics, review, translation, vocabulary, wordgen
from runeloom.functions.sounds import root_problems, segments, shape
from runeloom.plans.corpus import Options, report, run_pack, run_translate
from runeloom.sources import decisions, records, texts
from runeloom.streaming import texts as streams
from runeloom.work import materialize, shared_dir, spread

RECORDS = "n int, en string, words int, loans int, unknown int"


@pytest.fixture(scope="module")
def records_df(spark):
    data = [(0, "One story about a dwarf", 50, 0, 0), (1, "one  STORY about a\tdwarf ", 50, 0, 0), (2, "Many loans", 50, 10, 0), (3, "Unknown one", 50, 0, 1), (4, "Short", 5, 0, 0), (5, "Another story", 50, 2, 0), (6, None, 50, 0, 0), (7, None, 50, 0, 0)]
    return spark.createDataFrame(data, RECORDS)




def test_drop_reasons(records_df):
    x = packing.drop_reasons(records_df, "en", "n", records_df.unknown, records_df.loans, records_df.words)
    assert {r.n: r.reason for r in x.collect()} == {0: None, 1: "duplicate", 2: "loan rate", 3: "unknown tokens", 4: "too short", 5: None, 6: None, 7: None}
    assert x.columns == [*records_df.columns, "reason"]


def test_dedupe_and_first(records_df):
    assert sorted(r.n for r in packing.dedupe(records_df, "en", "n").collect()) == [0, 2, 3, 4, 5]
    assert packing.dedupe(records_df.limit(0), "en", "n").count() == 0


def test_summaries(spark, records_df):
    s = packing.run_summary(records_df, records_df.words, records_df.loans, records_df.unknown).first()
    assert (s.stories, s.words, s.loans, s.unknown) == (8, 355, 12, 1) and math.isclose(s.loan_rate, 12 / 355)
    none = packing.run_summary(records_df.limit(0), records_df.words, records_df.loans, records_df.unknown).first()
    assert (none.stories, none.words, none.loan_rate) == (0, 0, 0)
    assert {(r.shard, r.stories) for r in packing.shard_stats(records_df, "n", 3, records_df.words, records_df.loans, records_df.unknown).collect()} == {(0, 3), (1, 3), (2, 2)}
    h = spark.createDataFrame([(0, 0), (1, 200), (1, 40), (30, 100), (None, None)], "l int, w int")
    assert {(r.percent, r.stories) for r in packing.rate_histogram(h, h.l, h.w).collect()} == {(0, 2), (1, 1), (3, 1), (20, 1)}


def test_near(spark):
    words = ["grim", "grum", "grm", "gri", "girm", "kazak", "kazakk", "x", "", None, "grim"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r.query, r.hit) for r in near.near_join(df, df).collect()}
    keys = {w: wordgen.neighbourhood(w) for w in words if w is not None}
    assert got == {(a, b) for a in keys for b in keys if keys[a] & keys[b]}
    assert {(r.a, r.b) for r in near.within_one_pairs(df).collect()} == {("gri", "grim"), ("grim", "grm"), ("grim", "grum"), ("girm", "grim"), ("grm", "grum"), ("girm", "grm"), ("gri", "grm"), ("kazak", "kazakk")}
    assert {r.query: r.hits for r in near.near_hits(df, df).collect()}["kazak"] == ["kazakk"]


def test_sounds(spark):
    words = ["gromdal", "gammuz", "skreka", "az", "gromdal", None, ""]
    counts = phonotactics.sound_counts(spark.createDataFrame([("s", w) for w in words], "source string, word string"))
    got = {(r.kind, r.key): r.n for r in counts.collect()}
    assert got["initial", "g.r"] == 1 and got["geminate", "yes"] == 1 and got["final_nucleus", "a#"] == 1 and got["syllables", "2"] == 3
    assert {k for k, _ in got} <= set(phonotactics.KINDS)
    table = phonotactics.percent_table(counts, "syllables", ["s"]).collect()
    assert [(r.key, r.s, r.combined_n) for r in table] == [("2", 75.0, 3), ("1", 25.0, 1)]


def test_model_on_tables_and_in_tasks(spark):
    words = ["grund", "karak", "drashki", "az", "zharr"]
    df = spark.createDataFrame([("s", w) for w in words], "source string, word string")
    tri = phonotactics.trigrams(df)
    segs = lambda w: ["<", "<", *segments(w, True), ">"]
    n: Counter = Counter()
    for w in words:
        x = segs(w)
        for a, b, c in zip(x, x[1:], x[2:]):
            n.update([(a, b, c), ("of", a, b), (b, c), ("of", b), c])
    single = {k: v for k, v in n.items() if isinstance(k, str)}
    probe = spark.createDataFrame([(w,) for w in [*words, "xyz", "khorn"]], "word string")
    for r in phonotactics.log_probability(probe, phonotactics.trigram_model(tri)).collect():
        x, ps = segs(r.word), []
        for a, b, c in zip(x, x[1:], x[2:]):
            ps.append(0.6 * n[a, b, c] / max(n["of", a, b], 1) + 0.3 * n[b, c] / max(n["of", b], 1) + 0.1 * (n[c] + 1) / (sum(single.values()) + len(single) + 1))
        assert math.isclose(r.logprob, sum(map(math.log2, ps)) / len(ps))
    p = phonotactics.percentile_in(probe.withColumn("logprob", F.length("word").cast("double")), [1.0, 2.0, 3.0, 4.0])
    assert {r.word: r.percentile for r in p.collect()}["az"] == 50.0


def test_coverage_chain(spark):
    rows = [("The", "the", "DET", 5), ("dwarf", "dwarf", "NOUN", 4), ("scared", "scared", "ADJ", 2), ("scare", "scare", "VERB", 1), ("quickly", "quickly", "ADV", 3), ("quick", "quick", "ADJ", 1), ("was", "be", "AUX", 2), ("Lily", "Lily", "PROPN", 2), ("7", "7", "NUM", 1), ("upon", "upon", "ADP", 1), ("mum", "mum", "NOUN", 1), (".", ".", "PUNCT", 9), ("course", "course", "NOUN", 1), ("all", "all", "ADV", 1)]
    tokens = spark.createDataFrame([(w, lem, p, n, i, p == "NUM") for i, (w, lem, p, n) in enumerate(rows)], "word string, lemma string, pos string, n bigint, place bigint, like_num boolean")
    functions = spark.createDataFrame([("ta", ["the", "you all"], "article"), ("bin", ["in (place)"], "preposition")], "kz string, en array<string>, cat string")
    alias = spark.createDataFrame([("mum", "NOUN", "mom", "NOUN")], "lemma string, pos string, to_lemma string, to_pos string")
    sense = lambda *s: spark.createDataFrame([x.split("/") for x in s], "lemma string, pos string")
    c, w = vocabulary.coverage(tokens, functions, alias, sense("all/ADV"), sense("course/NOUN"))
    assert {r.bucket: r.tokens for r in vocabulary.bucket_shares(c).collect()} == {"function": 6, "content": 12, "absorbed": 3, "name": 2, "number": 1, "fgap": 1}
    got = [(r.rank, r.lemma, r.pos, r["count"]) for r in w.orderBy("rank").collect()]
    assert got == [(1, "dwarf", "NOUN", 4), (2, "quick", "ADJ", 4), (3, "scare", "VERB", 3), (4, "mom", "NOUN", 1)]
    last = w.orderBy(F.desc("rank")).first()
    assert math.isclose(last.cum_coverage, 24 / 25) and math.isclose(last.per_million, 1e6 / 25)
    assert [r.lemma for r in vocabulary.gap_words(c).collect()] == ["upon"]
    assert [(r.target, r.needed) for r in vocabulary.entries_needed(w, (0.6, 0.9, 0.99)).collect()] == [(0.6, 1), (0.9, 3), (0.99, None)]
    assert [r.lemma for r in vocabulary.next_uncovered(w, sense("dwarf/NOUN"), 2).collect()] == ["quick", "scare"]


def test_merge_and_goal(spark):
    make = lambda rows: spark.createDataFrame(rows, "lemma string, pos string, count bigint, per_million double, example string")
    a, b = make([("x", "NOUN", 10, 100000.0, "in a"), ("y", "VERB", 5, 50000.0, "in a")]), make([("x", "NOUN", 2, 20000.0, "in b"), ("z", "ADJ", 9, 90000.0, "in b")])
    m = vocabulary.merge_worklists([a, b])
    assert {r.lemma: (r["count"], r.per_million, r.example) for r in m.collect()} == {"x": (12, 60000.0, "in a"), "y": (5, 25000.0, "in a"), "z": (9, 45000.0, "in b")}
    rates = a.select(F.lit("a").alias("corpus"), "lemma", "pos", "per_million").unionByName(b.select(F.lit("b").alias("corpus"), "lemma", "pos", "per_million"))
    free = spark.createDataFrame([("a", 0.8), ("b", 0.8)], "corpus string, free double")
    none = spark.createDataFrame([], "lemma string, pos string")
    need = lambda known, goal: vocabulary.goal_entries(m, rates, free, known, goal).first().needed
    assert (need(none, 0.8), need(none, 0.82), need(none, 0.895), need(none, 0.99)) == (0, 1, 2, 3)
    assert need(spark.createDataFrame([("x", "NOUN")], "lemma string, pos string"), 0.895) == 1


LEX = "kz string, en array<string>, origin string, from_lang string, base string, notes string"
FUN = "kz string, en array<string>, cat string, origin string"
GOOD = [("grund", ["anvil/NOUN"], "invented", None, None, None), ("thaluk", ["walk/VERB"], "invented", None, None, None), ("gawi", ["dwarf/NOUN"], "borrowed", "old", None, None), ("gawit", ["beardling/NOUN"], "derived", None, "gawi+DIM", None)]


@pytest.fixture(scope="module")
def functions(spark):
    return spark.createDataFrame([("ta", ["the"], "article", "invented"), ("zu", ["be"], "verb", "invented")], FUN)


def findings(spark, functions, extra, **kw):
    return {(r.severity, r.rule) for r in lexicon.validate(spark.createDataFrame(GOOD + extra, LEX), functions, **kw).collect()}


def test_clean_lexicon(spark, functions):
    assert findings(spark, functions, []) == set()


@pytest.mark.parametrize("row, rule", [
    (("grund", ["iron/NOUN"], "invented", None, None, None), "spelling"), (("khorn", ["anvil/NOUN"], "invented", None, None, None), "sense"), (("khorn", ["iron/METAL"], "invented", None, None, None), "bad sense"),
    (("khorn", ["iron/NOUN"], "found", None, None, None), "origin"), (("khoorn", ["iron/NOUN"], "invented", None, None, None), "root"), (("khorn", ["iron/NOUN"], "borrowed", "", None, None), "borrowed"),
    (("khorn", ["iron/NOUN"], "derived", None, "nobody+AGT", None), "base"), (("khorn", ["iron/NOUN"], "derived", None, "grund+AGT", None), "base"), (("khorn", ["iron/NOUN"], "derived", None, "grund+PL+AGT", None), "base"),
    (("grind", ["iron/NOUN"], "invented", None, None, None), "near"), (("thalukad", ["iron/NOUN"], "borrowed", "x", None, None), "form"),
])
def test_findings(spark, functions, row, rule):
    assert ("error", rule) in findings(spark, functions, [row])


def test_word_list_findings(spark, functions):
    words = spark.createDataFrame([("grund",), ("gawin",)], "word string")
    got = findings(spark, functions, [], english=words, profane=["thaluk"], profane_parts=["luk"])
    assert got == {("error", "english"), ("warning", "english"), ("error", "profane")}


def test_compile_and_merge(spark, functions, tmp_path):
    content = spark.createDataFrame(GOOD, LEX)
    out = json.loads(lexicon.compile_lexicon(content, functions, f"{tmp_path}/build/lexicon.json").read_text())
    assert out["en_index"]["dwarf/NOUN"] == "gawi" and out["content"][0]["forms"] == {"grundi": ["PL"]}
    bad = lexicon.validate(spark.createDataFrame(GOOD + GOOD[:1], LEX), functions)
    with pytest.raises(ValueError):
        lexicon.compile_lexicon(content, functions, f"{tmp_path}/x.json", bad)
    new = spark.createDataFrame([("grund", "smithy/NOUN", "shared", None, None), ("khorn", "iron/NOUN", "invented", None, None)], "kz string, sense string, origin string, from_lang string, base string")
    m = {r.kz: r for r in lexicon.merge_entries(content, new).collect()}
    assert m["grund"].en == ["anvil/NOUN", "smithy/NOUN"] and m["grund"].origin == "invented" and m["khorn"].en == ["iron/NOUN"] and len(m) == 5


def test_yaml_and_fingerprint(spark, tmp_path):
    a, b = tmp_path / "core.yaml", tmp_path / "more.yaml"
    a.write_bytes(b"entries:\r\n- {kz: grund, en: [anvil/NOUN], origin: invented}\r\n")
    one = lexicon.fingerprint([str(a)])
    a.write_bytes(a.read_bytes().replace(b"\r\n", b"\n"))
    assert lexicon.fingerprint([str(a)]) == one and len(one) == 12
    assert [(r.kz, r.tier) for r in lexicon.load_content_yaml(spark, [str(a), str(b)]).collect()] == [("grund", "core")]
    out = lexicon.load_content_yaml(spark, [str(a)])
    assert [p.name for p in lexicon.write_content_yaml(out, f"{tmp_path}/new")] == ["core.yaml"] and lexicon.write_content_yaml(out, f"{tmp_path}/new") == []
    assert lexicon.load_content_yaml(spark, [f"{tmp_path}/new/core.yaml"]).collect() == out.collect()
    for text in ("- {kz: x, en: [yes], origin: invented}", "- {kz: x, en: [anvil], origin: invented}", "- {kz: x, en: [anvil/METAL], origin: invented}"):
        b.write_text("entries:\n" + text)
        with pytest.raises(ValueError):
            lexicon.load_content_yaml(spark, [str(b)])


def generator(spark):
    blended = {"initial": {"g.r": 2.0, "k": 1.0, "": 0.5}, "final": {"k": 1.0, "n": 1.0, "": 0.4}, "medial": {"z": 1.0, "m.d": 1.0}, "syllables": {"1": 1.0, "2": 2.0}}
    tri = spark.createDataFrame([("<", "<", "g", 3), ("<", "g", "r", 3), ("a", "k", ">", 2), ("a", "n", ">", 1), ("g", "r", "a", 2), ("r", "a", "k", 2)], "a string, b string, c string, n bigint")
    return wordgen.Style(blended, 3), phonotactics.trigram_model(tri)


def test_samples(spark):
    style, _ = generator(spark)
    made = lambda style, n, *k: [r.word for r in wordgen.sample_words(spark.range(n), style, *k).orderBy("number").collect()]
    words = made(style, 300)
    again = wordgen.sample_words(spark.range(300).repartition(7), wordgen.Style(style.blended, 3)).orderBy("number")
    assert words == [r.word for r in again.collect()] and words != made(wordgen.Style(style.blended, 4), 300)
    assert sum(not root_problems(w) for w in words) > 150
    assert all(len(shape(w).nuclei) == 2 for w in made(style, 100, 2))


def test_draws_take_room_by_weight(spark):
    weights = {"a": 1.0, "b": 0.0, "c": 3.0}
    got = Counter(r.k for r in spark.range(4000).select(wordgen.drawn(weights, wordgen.uniform_col(F.lit(5), F.col("id"))).alias("k")).collect())
    assert set(got) == {"a", "c"} and 2850 < got["c"] < 3150
    u = spark.range(50).select(wordgen.uniform_col(F.lit("x"), F.col("id")).alias("u")).collect()
    assert [r.u for r in u] == [wordgen.uniform("x", i) for i in range(50)] and all(0 <= r.u < 1 for r in u)


def test_rejections_and_warnings(spark):
    lists = wordgen.WordLists(existing=frozenset({"grak", "kazun"}), english=frozenset({"gran", "karun", "gruns"}), sources=frozenset({"thorm", "thor"}), profane=frozenset({"shut"}), profane_parts=("zuz",))
    words = spark.createDataFrame([(w,) for w in ["grak", "gran", "kazuz", "shut", "thor", "thorm", "karu", "xq", "gruns", "bolg", "karuk", None, ""]], "word string")
    _, model = generator(spark)
    got = {r.word: r for r in wordgen.score_words(words, model, [-3.0, -1.0], lists).collect()}
    want = {"grak": "too close to an existing word", "gran": "english word", "kazuz": "profane", "shut": "profane", "thor": "identical to a source word", "bolg": None}
    assert {w: got[w].reject for w in want} == want and got["xq"].reject.startswith("illegal: letters") and set(got) == {w for (w,) in words.collect() if w}
    assert got["karuk"].flags == ["near-english:karun"] and got["thorm"].flags == ["near-source:thor"] and got["karu"].flags == [] and got["bolg"].syllables == 1


def test_generated_roots(spark):
    style, model = generator(spark)
    lists = wordgen.WordLists(existing=frozenset({"grak", "kazun"}), english=frozenset({"gran"}), profane_parts=("zuz",))
    got = wordgen.generate_roots(spark, style, model, lists, 20)
    words = [w for w, _ in got]
    assert len(words) == 20 and got == wordgen.generate_roots(spark, style, model, lists, 20)
    assert {r.reject for r in wordgen.score_words(spark.createDataFrame([(w,) for w in words], "word string"), model, [0.0], lists).collect()} == {None}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    assert near.near_join(df, df).where("query <> hit").count() == 0
    assert wordgen.syllables_for(5, "x") == 1 and {wordgen.syllables_for(None, i) for i in range(50)} == {1, 2}


def test_propose_and_apply(spark, functions):
    content = spark.createDataFrame(GOOD, LEX)
    covered = lexicon.sense_index(content)
    work = spark.createDataFrame([(i + 1, *s.split("/"), 100 - i, "an example") for i, s in enumerate(["dwarf/NOUN", "iron/NOUN", "iron/VERB", "walker/NOUN", "stroll/VERB", "stone/NOUN", "mist/NOUN"])], "rank bigint, lemma string, pos string, count bigint, example string")
    seeds = review.Seeds({"walker/NOUN": {"base": "@walk/VERB+AGT"}, "stroll/VERB": {"same": "wander/VERB"}, "stone/NOUN": {"kz": "kurm", "origin": "borrowed", "from": "old"}}, extra=["beer/NOUN"])
    taken = [("grund", "NOUN"), ("thaluk", "VERB"), ("gawi", "NOUN"), ("gawit", "NOUN"), ("ta", ""), ("zu", "")]
    batch = review.propose(spark, work, covered, taken, *generator(spark), wordgen.WordLists(existing=frozenset(w for w, _ in taken)), seeds, 5)
    rows = {f"{r.english}/{r.pos}": r for r in batch.collect()}
    assert set(rows) == {"iron/NOUN", "iron/VERB", "walker/NOUN", "stroll/VERB", "stone/NOUN", "beer/NOUN", "wander/VERB"}
    assert rows["iron/VERB"].proposed == rows["iron/NOUN"].proposed and rows["iron/VERB"].origin == "shared"
    assert rows["walker/NOUN"].proposed == "thalukki" and rows["stone/NOUN"].proposed == "kurm" and rows["stroll/VERB"].proposed == rows["wander/VERB"].proposed
    words = Counter(w for r in rows.values() if r.origin == "invented" for w in (r.proposed, r.alt1, r.alt2, r.alt3))
    assert max(words.values()) == 1 and "" not in words
    decided = batch.withColumn("decision", F.when(F.concat_ws("/", "english", "pos") == "iron/NOUN", "2").when(F.col("english") == "beer", "no").when(F.col("english") == "stone", "khorn").otherwise("ok"))
    new, found = review.apply_review(content, functions, decided, covered)
    got = {s: r.kz for r in new.collect() for s in r.en}
    assert got["iron/NOUN"] == got["iron/VERB"] == rows["iron/NOUN"].alt2 and "beer/NOUN" not in got and got["stone/NOUN"] == "khorn" and got["walker/NOUN"] == "thalukki"
    assert not [r for r in found.collect() if r.rule in ("spelling", "sense", "base", "near")]


def test_story_files(spark, tmp_path):
    text = "One\nstory.\n<|endoftext|>\n  \n<|endoftext|>\nTwo <|endoftext|> rest of it\nThree\n\nparts\n<|endoftext|>\nfour without end"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    got = [(r.ordinal, r.en) for r in texts.read_stories(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [(0, "One\nstory."), (1, "Three\n\nparts"), (2, "four without end")]
    assert [r.en for r in texts.read_stories(spark, str(tmp_path), keep_blank=True, limit=3).orderBy("ordinal").collect()] == ["One\nstory.", "", "Three\n\nparts"]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "a.txt").write_text("\n<|endoftext|>\n".join(f"story {i}" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [r.en for r in texts.read_stories(spark, str(tmp_path)).orderBy("ordinal").collect()] == [f"story {i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_worklist_and_review_files(spark, tmp_path):
    w = spark.createDataFrame([(1, "dwarf", "NOUN", 4, 1234.56, 0.98765, 'an "example"\tx'), (2, "axe", "NOUN", 3, 1.0, 0.99, None)], "rank int, lemma string, pos string, count bigint, per_million double, cum_coverage double, example string")
    texts.write_worklist(w, f"{tmp_path}/w")
    back = texts.read_worklist(spark, f"{tmp_path}/w").orderBy("rank").collect()
    assert (back[0].per_million, back[0].cum_coverage, back[0]["count"]) == (1234.6, 0.9877, 4)
    b = spark.createDataFrame([tuple('a "b", c' if f == "example" else f for f in review.FIELDS)], review.SCHEMA)
    texts.write_review(b, f"{tmp_path}/r")
    assert texts.read_review(spark, f"{tmp_path}/r").collect() == b.collect()


def test_source_lists(spark):
    lines = lambda s: spark.createDataFrame(list(enumerate(s.split("\n"))), "no int, line string")
    a = texts.parse_colon_list(lines("preface: no\nSection: Lexicon\nBar, Barak: wall (unofficial)\nAz-Dreugi: axe thing\n: x\nNumerals\nOne (1): Ong\nI have scoured all\nlate: no"), "one", "Section", ["I have scoured"], "Numerals", ["wall"], ["az"])
    got = {(r.word, r.kind, r.tag, r.gloss) for r in a.collect()}
    assert got == {("bar", "native", "unofficial", "wall (unofficial)"), ("barak", "native", "unofficial", "wall (unofficial)"), ("az", "native", "name", "axe thing"), ("dreugi", "native", "official", "axe thing"), ("ong", "native", "official", "One (1)")}
    b = texts.parse_tagged_list(lines("What we know\nZ(s)empel (uncertain): temple\nVictraz: victory\nBar (onetongue): wall\nlower: no\nThing (AI): x\nNumbering\nNo: no"), "twotongue", "onetongue", "What we know", ["Numbering"], [], ["victraz"])
    assert {(r.word, r.kind) for r in b.collect()} >= {("victraz", "calque"), ("bar", "dup"), ("thing", "exclude")}
    merged = texts.merge_source_words(a, b)
    assert ("bar", "one") in {(r.word, r.source) for r in merged.collect()} and ("bar", "") not in {(r.word, r.source) for r in merged.collect()}
    assert texts.native_words(merged).where("word = 'az'").isEmpty()


def test_record_files(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("s-"), "id").alias("id"), F.lit("é text").alias("en"), F.lit("kz").alias("kz"), F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"), (F.col("id") / 1000).cast("int").alias("shard"))
    records.write_shards(rows, f"{tmp_path}/shards")
    back = records.read_records(spark, f"{tmp_path}/shards")
    assert back.count() == 5000 and back.agg(F.max("ordinal")).first()[0] == 4999
    records.write_parquet_shards(rows.coalesce(1), f"{tmp_path}/pq", "kz", rows_per_file=2000)
    files = sorted((tmp_path / "pq").glob("*.parquet"))
    meta = [pq.ParquetFile(f).metadata for f in files]
    assert sorted(m.num_rows for m in meta) == [1000, 2000, 2000] and max(m.row_group(i).num_rows for m in meta for i in range(m.num_row_groups)) <= 1024
    assert meta[0].row_group(0).column(0).compression == "ZSTD" and [c.name for c in pq.ParquetFile(files[0]).schema] == ["text"]
    records.write_parallel(rows, f"{tmp_path}/par", "split")
    line = next((tmp_path / "par" / "split=val").glob("*.json")).read_text().splitlines()[0]
    assert set(json.loads(line)) == {"id", "en", "kz"} and "é" in line
    todo = records.missing_shards(rows, rows.where("shard < 3 and id <> 's-7'"))
    assert {r.shard for r in todo.select("shard").distinct().collect()} == {0, 3, 4}


def test_json_lines(spark):
    lines = ['{"id": "a", "words": 3, "loan_words": ["x", "y"]}', '{"id": "b"', "", None, "[1]", '{"words": "many", "en": "e"}']
    got = records.parse_records(spark.createDataFrame(list(enumerate(lines)), "no int, line string"), "line").orderBy("no").collect()
    assert [(r.no, r.id, r.words, r.loan_words, r.en) for r in got] == [(0, "a", 3, ["x", "y"], None), (5, None, None, None, "e")]


CONTENT = [{"kz": "gawi", "en": ["dwarf/NOUN"]}, {"kz": "drash", "en": ["forge/VERB"]}, {"kz": "az", "en": ["axe/NOUN"]}]
FUNCTION_ROWS = [{"kz": "ta", "en": ["the"], "cat": "article"}]


def test_corpus_from_stories_to_files(spark, tmp_path):
    story = "The dwarf forged the axe. " * 6
    (tmp_path / "in.txt").write_text("\n<|endoftext|>\n".join([story, story.upper().capitalize(), "Short one.", "Banana bananas banana. " * 9, *[f"The dwarf forged the axe {i} times. " * 5 for i in range(40)]]))
    lang, o = Language(CONTENT, FUNCTION_ROWS), Options(shard_size=10, max_loan_rate=0.3, rows_per_file=7)
    stories = texts.read_stories(spark, f"{tmp_path}/in.txt")
    run_translate(stories.where("ordinal < 25"), lang, f"{tmp_path}/out", o, {"lexicon": "1"})
    with pytest.raises(ValueError):
        run_translate(stories, lang, f"{tmp_path}/out", o, {"lexicon": "2"})
    run_translate(stories, lang, f"{tmp_path}/out", o, {"lexicon": "1"})  # the short shard and the missing ones
    assert report(spark, f"{tmp_path}/out").first().stories == 44
    m = json.loads((tmp_path / "out" / "translate_manifest.json").read_text())
    assert [m["shards"][str(k)]["stories"] for k in range(5)] == [10, 10, 10, 10, 4]
    counts = run_pack(spark, f"{tmp_path}/out", f"{tmp_path}/packed", o)
    p = json.loads((tmp_path / "packed" / "pack_manifest.json").read_text())
    assert sum(r.stories for r in counts.collect()) + sum(p["dropped"].values()) == 44 and p["dropped"].keys() >= {"too short", "loan rate"}
    assert "## Most frequent loans" in (tmp_path / "packed" / "REPORT.md").read_text()
    with pytest.raises(Exception, match="(?i)exists"):
        run_pack(spark, f"{tmp_path}/out", f"{tmp_path}/packed", o)
    run_pack(spark, f"{tmp_path}/out", f"{tmp_path}/packed", o, overwrite=True)


def test_translate_tables(spark):
    df = spark.createDataFrame([(1, "The dwarf forged the axe."), (2, None), (3, "")], "no bigint, en string")
    got = {r.id: r for r in translation.translate(df, "no", "en", Language(CONTENT, FUNCTION_ROWS)).collect()}
    assert got[1].kz == "Ta gawi drashad ta az." and got[1].words == 5 and got[2].kz is None and got[3].kz == "" and got[3].loan_rate == 0
    from runeloom.functions.parsing import parse

    lang = Language(CONTENT, FUNCTION_ROWS)
    tokens = [[vars(t) for t in s] for s in parse("The dwarf forged the axe.", lang.by_lemma)]
    parsed = spark.createDataFrame([(1, tokens), (2, None)], f"no bigint, s array<{translation.TOKEN_SCHEMA}>")
    assert {r.id: r.kz for r in translation.translate_parsed(parsed, "no", "s", lang).collect()} == {1: "Ta gawi drashad ta az.", 2: None}


def test_gloss_tables(spark):
    c = spark.createDataFrame([("gawi", ["dwarf/NOUN"], "borrowed"), ("drash", ["forge/VERB"], "invented")], "kz string, en array<string>, origin string")
    f = spark.createDataFrame([("ta", ["the"], "article")], "kz string, en array<string>, cat string")
    df = spark.createDataFrame([(1, "Ta gawi drashad."), (2, "the blueberry."), (3, None), (4, "")], "no bigint, kz string")
    got = {r.id: (r.word, r.unknown, r.ok) for r in glosses.validate_texts(df, "no", "kz", c, f).collect()}
    assert got == {1: (3, 0, True), 2: (0, 1, False), 3: (None, None, False), 4: (0, 0, True)}
    g = glosses.load_glosser(c, f)
    odd = 'One, two... (three) - four! -- Five "six" seven-eight. - nine ...... ten'
    firsts, begins = [], True
    for t in __import__("re").findall(r"[\w\-]+|[^\w\s]", odd):
        if t[0].isalnum():
            firsts.append((t, begins))
            begins = False
        else:
            begins = begins or t in '.!?"“'
    assert g is not None and {(r.token, r.first) for r in glosses.token_types(df.limit(1).select(F.lit(odd).alias("kz")), "kz").collect()} == set(firsts)
    a = glosses.analyze_types(glosses.token_types(df, "kz"), c, f)
    assert {(r.token, r.first) for r in a.collect()} == {("Ta", True), ("gawi", False), ("drashad", False), ("the", True), ("blueberry", False)}
    assert [r.token for r in glosses.unknown_words(a).collect()] == ["blueberry"]
    assert {r.no: r.gloss for r in glosses.gloss_texts(df, "kz", c, f).collect()}[1] == "Ta  gawi  drashad\nthe dwarf forge-PST"


def test_sql_functions(spark):
    register(spark, Glosser.of([{"kz": "gawi", "en": ["dwarf/NOUN"], "origin": "x"}], []))
    register_stories(spark)
    r = spark.sql("select respell('cheese') a, loan('banana', 'NOUN') b, inflect('gawi', 'DIM+PL') c, inflect('gawi', 'PL+DIM') d, check_root('gawi') e, gloss_word('gawin') f").first()
    assert (r.a, r.b, r.c, r.d, r.f) == ("shis", "bananuz", "gawiti", None, "dwarf-PL") and "reserved" in r.e[0]
    assert [(x.root, x.tags) for x in spark.sql("select * from analyses('gawin')").collect()] == [("gawi", "PL")]
    assert [x.story for x in spark.sql("select * from stories('a\n<|endoftext|>\n\n<|endoftext|>\nb')").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"Story {i % 6}", 50, 0 if i != 3 else 9, 0) for i in range(12)], "n int, en string, words int, loans int, unknown_n int").withColumn("at", F.timestamp_seconds(F.col("n") * 600))
    rows.where("n < 6").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    rows.where("n >= 6").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    s = streams.read_table_stream(spark, f"{tmp_path}/in/*", rows.schema)
    streams.run_to_memory(streams.pack_stream(s, "en", "at", "3 hours"), "packed")
    assert sorted(r.en for r in spark.table("packed").collect()) == [f"Story {i}" for i in range(6)]
    streams.run_to_memory(streams.loan_rate_windows(s, "at"), "rates", "complete")
    assert sorted((r.stories, r.loans) for r in spark.table("rates").collect()) == [(6, 0), (6, 9)]


def test_work_tables(spark):
    df = spark.range(10).withColumn("x", F.array(F.lit("a")))
    back = materialize(df)
    assert back.dtypes == df.dtypes and sorted(back.collect()) == sorted(df.collect())
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert spread(df.coalesce(1)).rdd.getNumPartitions() >= 4


def test_decision_files(spark, tmp_path):
    (tmp_path / "p.yaml").write_text("phrases:\n  once upon a time: gez {day/NOUN+PL}\n")
    (tmp_path / "c.yaml").write_text("alias:\n  scar/VERB: scare/VERB\nskip: [x/NOUN]\nfunction: [all/ADV]\n")
    (tmp_path / "s.yaml").write_text("senses:\n  stone/NOUN: {kz: kurm, origin: borrowed, from: old}\n  walker/NOUN: {base: '@walk/VERB+AGT'}\nextra: [beer/NOUN]\n")
    (tmp_path / "f.tsv").write_text("word\tzipf\nHouse\t5.2\nhall\t4\n")
    (tmp_path / "w.txt").write_text("Bad # remark\n\n# all\nworse\n")
    assert decisions.read_phrases(f"{tmp_path}/p.yaml") == {"once upon a time": "gez {day/NOUN+PL}"}
    assert decisions.read_corrections(f"{tmp_path}/c.yaml") == ({("scar", "VERB"): ("scare", "VERB")}, [("x", "NOUN")], [("all", "ADV")])
    seeds = decisions.read_seeds(f"{tmp_path}/s.yaml")
    assert seeds.needs() == [("walker/NOUN", "walk/VERB")] and seeds.extra == ["beer/NOUN"] and seeds.senses["stone/NOUN"]["kz"] == "kurm"
    assert decisions.read_frequencies(f"{tmp_path}/f.tsv") == {"house": 5.2, "hall": 4.0} and decisions.read_words(f"{tmp_path}/w.txt") == {"bad", "worse"}
    (tmp_path / "s.yaml").write_text("senses:\n  stone/NOUN: {kz: kurm, same: x/NOUN}\n")
    with pytest.raises(ValueError):
        decisions.read_seeds(f"{tmp_path}/s.yaml")
