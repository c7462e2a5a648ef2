"""Command line: python -m runeloom COMMAND. Tables are Parquet folders or files; the lexicon is read with --lexicon and --functions."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from runeloom.functions.rewriting import Translator
from runeloom.operators import glosses, lexicon, phonotactics, review, tagging, translation, vocabulary, wordgen
from runeloom.plans import corpus, reports
from runeloom.session import session
from runeloom.sources import decisions, texts
from runeloom.work import materialize


def _text(a: argparse.Namespace) -> str:
    return " ".join(a.text) or sys.stdin.read()


def _tables(spark: SparkSession, a: argparse.Namespace):
    return spark.read.parquet(a.lexicon), spark.read.parquet(a.functions)


def _language(spark, a):
    phrases = decisions.read_phrases(a.phrases) if a.phrases else None
    alias = decisions.read_corrections(a.corrections)[0] if a.corrections else None
    return translation.load_language(*_tables(spark, a), phrases, alias)


def _frequencies(a: argparse.Namespace) -> dict[str, float]:
    return decisions.read_frequencies(a.english) if a.english else {}


def _options(a: argparse.Namespace) -> corpus.Options:
    return corpus.Options(**{k: v for k, v in vars(a).items() if k in corpus.Options.__dataclass_fields__})


def cmd_translate(spark, a) -> int:
    out, s = Translator(_language(spark, a)).translate(_text(a))
    print(out)
    print(f"[{s.tokens} words, {s.loans} loans, {s.names} names, {s.unknown} unknown]", file=sys.stderr)
    return 0


def cmd_gloss(spark, a) -> int:
    print(glosses.load_glosser(*_tables(spark, a)).interlinear(_text(a), a.width))
    return 0


def cmd_validate(spark, a) -> int:
    """Text, or a file of JSON lines with kz; 1 where a word isn't of the language."""
    joined = " ".join(a.text)
    df = spark.read.schema("kz string").json(joined) if joined and Path(joined).exists() else texts.single_text(spark, _text(a)).withColumnRenamed("en", "kz")
    types = glosses.analyze_types(glosses.token_types(df, "kz"), *_tables(spark, a)).cache()
    for r in glosses.kind_counts(types).orderBy(F.desc("tokens")).collect():
        print(f"{r.kind}: {r.tokens:,} ({r.share:.2%})")
    bad = glosses.unknown_words(types).collect()
    print("unknown:", ", ".join(f"{r.token} {r.n}" for r in bad) or "none")
    return int(bool(bad))


def cmd_lexicon(spark, a) -> int:
    content, functions = _tables(spark, a)
    found = lexicon.validate(content, functions)
    if a.action == "check":
        rows = found.orderBy("severity", "rule", "kz").collect()
        print("\n".join(f"{r.severity}: {r.kz}: {r.message}" for r in rows) or "no findings")
        return int(any(r.severity == "error" for r in rows))
    if a.action == "build":
        print(lexicon.compile_lexicon(content, functions, a.out, found))
    elif a.action == "fingerprint":
        print(lexicon.fingerprint([a.lexicon, a.functions]))
    else:
        w = texts.read_worklist(spark, a.worklist)
        first = w.orderBy("rank").first()
        free = first.cum_coverage - first.per_million / 1e6 if first else 0.0
        senses = lexicon.sense_index(content)
        print(f"covered: {vocabulary.covered_share(w, senses, free).first().covered:.2%}, without entries {free:.2%}")
        for r in vocabulary.next_uncovered(w, senses).collect():
            print(f"{r['rank']:>6} {r.lemma}/{r.pos} ({r['count']})")
    return 0


def _generator(spark, a):
    content, functions = _tables(spark, a)
    words = content.select("kz").unionByName(functions.select("kz")).select(F.col("kz").alias("word"), F.lit("all").alias("source")).distinct()
    counts = phonotactics.blend(phonotactics.sound_counts(words), words.groupBy("source").agg(F.count(F.lit(1)).alias("words")), {"all": 1.0})
    blended: dict[str, dict[str, float]] = {}
    for r in counts.where(F.col("kind").isin("initial", "final", "medial", "syllables")).orderBy("kind", "key").collect():
        blended.setdefault(r.kind, {})[r.key] = r.p
    model = {k: materialize(t, "model") for k, t in phonotactics.trigram_model(phonotactics.trigrams(words)).items()}
    common = frozenset(w for w, z in _frequencies(a).items() if z >= a.common)
    parts = tuple(sorted(decisions.read_words(a.profane))) if a.profane else ()
    return wordgen.Style(blended, a.seed), model, wordgen.WordLists(existing=frozenset(r.word for r in words.collect()), english=common, profane_parts=parts)


def cmd_wordgen(spark, a) -> int:
    style, model, lists = _generator(spark, a)
    if a.score:
        ref = wordgen.reference_scores(spark, style, model)
        for r in wordgen.score_words(spark.createDataFrame([(w,) for w in a.score], "word string"), model, ref, lists).orderBy("word").collect():
            print(f"{r.word}: {r.percentile:.0f} {r.reject or 'ok'} {' '.join(r.flags)}")
        return 0
    for w, p in wordgen.generate_roots(spark, style, model, lists, a.n, a.syllables, a.least, a.clean):
        print(f"{w} {p:.0f}")
    return 0


def cmd_corpus(spark, a) -> int:
    if a.action == "translate":
        corpus.run_translate(texts.read_stories(spark, a.input), _language(spark, a), a.out, _options(a), {"lexicon": lexicon.fingerprint([a.lexicon, a.functions])}, a.allow_mixed)
    elif a.action == "report":
        print(corpus.report(spark, a.input).first().asDict())
    else:
        corpus.run_pack(spark, a.input, a.out, _options(a), a.overwrite).show()
    return 0


def cmd_coverage(spark, a) -> int:
    stories = texts.read_stories(spark, a.input, keep_blank=True, limit=a.max_stories)
    content, functions = _tables(spark, a)
    c, w = vocabulary.coverage(tagging.tag_types(tagging.word_types(stories, "en", "ordinal"), content, functions), functions)
    texts.write_worklist(vocabulary.with_examples(w, stories, "ordinal", "en"), f"{a.out}/{a.source}_lemmas")
    print(reports.coverage_report(f"{a.out}/coverage_{a.source}.md", a.source, c, w, stories.count()))
    return 0


def cmd_merge(spark, a) -> int:
    lists = [texts.read_worklist(spark, p) for p in a.inputs]
    merged = vocabulary.merge_worklists(lists)
    first = [w.orderBy("rank").first() for w in lists]
    free = [r.cum_coverage - r.per_million / 1e6 for r in first]
    total = sum(free) / len(free)
    out = vocabulary.merged_worklist(merged, total)
    texts.write_worklist(out, f"{a.out}/{a.source}_lemmas")
    rates = lists[0].limit(0).select(F.lit("").alias("corpus"), "lemma", "pos", "per_million")
    for i, w in enumerate(lists):
        rates = rates.unionByName(w.select(F.lit(str(i)).alias("corpus"), "lemma", "pos", "per_million"))
    frees = spark.createDataFrame([(str(i), f) for i, f in enumerate(free)], "corpus string, free double")
    print(vocabulary.goal_entries(merged, rates, frees, lexicon.sense_index(spark.read.parquet(a.lexicon)), a.goal).first().needed)
    return 0


def cmd_review(spark, a) -> int:
    content, functions = _tables(spark, a)
    covered = lexicon.sense_index(content)
    if a.action == "propose":
        taken = [(r.kz, r.pos) for r in covered.select("kz", "pos").distinct().collect()] + [(r.kz, "") for r in functions.select("kz").collect()]
        texts.write_review(review.propose(spark, texts.read_worklist(spark, a.input), covered, taken, *_generator(spark, a), decisions.read_seeds(a.seeds) if a.seeds else review.Seeds(), a.n, a.seed), a.out)
        return 0
    new, found = review.apply_review(content, functions, texts.read_review(spark, a.input), covered)
    errors = found.where("severity = 'error'").collect()
    print("\n".join(f"{r.kz}: {r.message}" for r in errors) or "no errors")
    if not errors and not a.dry_run:
        new.write.parquet(a.out)
    return int(bool(errors))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="runeloom", description=__doc__)
    p.add_argument("--lexicon", default="lexicon.parquet")
    p.add_argument("--functions", default="function_words.parquet")
    for name, what in (("phrases", "YAML of phrases"), ("corrections", "YAML of corrections"), ("seeds", "YAML of a review's seeds"), ("english", "list of words with zipf frequencies"), ("profane", "list of parts that no word may hold")):
        p.add_argument(f"--{name}", help=what)
    p.add_argument("--common", type=float, default=3.0, help="zipf frequency from which an English word is avoided")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *args, **options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for x in args:
            c.add_argument(x, **({"nargs": "*"} if x == "text" else {"nargs": "+"} if x == "inputs" else {}))
        for k, v in options.items():
            flag = "--" + k.replace("_", "-")
            c.add_argument(flag, action="store_true") if v is False else c.add_argument(flag, type=type(v) if v is not None else int, default=v) if not isinstance(v, list) else c.add_argument(flag, nargs="*", default=v)
        return c

    command("translate", cmd_translate, "text")
    command("gloss", cmd_gloss, "text", width=100)
    command("validate", cmd_validate, "text")
    command("lexicon", cmd_lexicon, out="build/lexicon.json", worklist="worklist").add_argument("action", choices=["check", "build", "status", "fingerprint"])
    command("wordgen", cmd_wordgen, n=20, syllables=None, seed=1, clean=False, least=30.0, score=[])
    c = command("corpus", cmd_corpus, source="stories", shard_size=5000, max_stories=None, allow_mixed=False, max_loan_rate=0.05, min_words=20, val_share=0.05, rows_per_file=100_000, overwrite=False, out="out")
    c.add_argument("action", choices=["translate", "report", "pack"])
    c.add_argument("input")
    command("coverage", cmd_coverage, "input", source="stories", max_stories=None, out="out")
    command("merge", cmd_merge, "inputs", source="merged", goal=0.97, out="out")
    c = command("review", cmd_review, n=600, seed=1, out="out", dry_run=False)
    c.add_argument("action", choices=["propose", "apply"])
    c.add_argument("input")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    return a.run(SparkSession.getActiveSession() or session(), a)
