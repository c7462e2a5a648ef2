"""Markdown reports: coverage of a corpus, sounds of word lists. Tables are aggregated on the cluster; only their short results come to the driver."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.operators import phonotactics, vocabulary
from runeloom.sources.records import markdown_table

BUCKETS = ("content", "function", "absorbed", "name", "number", "fgap")
POSITIONS = (("Syllables per word", "syllables", 6), ("Word-initial clusters", "initial", 35), ("Word-final clusters", "final", 30), ("Medial clusters", "medial", 35), ("Vowel nuclei", "nucleus", 15), ("Last vowel, open (#) or closed (C)", "final_nucleus", 12), ("Consonants", "consonant", 30), ("Last two letters", "ending2", 25), ("Last three letters", "ending3", 20))


def _write(path: str, lines: list[str]) -> Path:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return p


def coverage_report(path: str, name: str, classified: DataFrame, ranked: DataFrame, stories: int, ks: tuple[int, ...] = (100, 250, 500, 750, 1000, 1500, 2000, 3000, 5000)) -> Path:
    """Classes of tokens, entries needed for each target, coverage at k, parts of speech, closed-class gaps."""
    share = {r.bucket: (r.tokens, r.share) for r in vocabulary.bucket_shares(classified).collect()}
    words = sum(n for n, _ in share.values())
    free = 1 - sum(share.get(b, (0, 0.0))[1] for b in ("content", "fgap"))
    need = {r.target: r.needed for r in vocabulary.entries_needed(ranked).collect()}
    at = vocabulary.coverage_at(ranked, ks).orderBy("k")
    lines = [f"# Coverage: {name}", "", f"- stories: {stories:,}", f"- words: {words:,}", f"- distinct content senses: {ranked.count():,}", f"- covered without any entry: {free:.2%}", "", "## Classes of words", "", "| class | words | share |", "|---|---:|---:|"]
    lines += [f"| {b} | {share.get(b, (0, 0))[0]:,} | {share.get(b, (0, 0.0))[1]:.2%} |" for b in BUCKETS]
    lines += ["", "## Entries needed", "", "| coverage | entries |", "|---|---:|", *[f"| {t:.1%} | {need[t] if need[t] is not None else 'not reached'} |" for t in vocabulary.TARGETS]]
    lines += ["", "## Coverage with the most frequent entries", "", *markdown_table(at.select("k", F.format_string("%.2f%%", 100 * F.col("coverage")).alias("coverage")), len(ks))]
    lines += ["", "## Parts of speech of the 2,000 most frequent", "", *markdown_table(vocabulary.pos_mix(ranked).orderBy(F.desc("senses"), "pos"), 10)]
    return _write(path, [*lines, "", "## Closed-class words without an entry", "", *markdown_table(vocabulary.gap_words(classified), 60)])


def sound_report(path: str, words: DataFrame, sources: list[str]) -> Path:
    """Tables of clusters, vowels and endings of the words (source, word), in per cent of each source."""
    counts = phonotactics.sound_counts(words)
    sizes = {r.source: r.n for r in words.where("word <> ''").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    lines = ["# Sounds of the source words", "", *[f"- {s}: {sizes.get(s, 0):,} words" for s in sources]]
    for title, kind, top in POSITIONS:
        t = phonotactics.percent_table(counts, kind, sources, top)
        shown = t.select(F.when(F.col("key") == "", "∅").otherwise(F.col("key")).alias(kind), *[F.format_string("%.1f%%", c).alias(c) for c in (*sources, "combined")])
        lines += ["", f"## {title}", "", *markdown_table(shown, top)]
    return _write(path, lines)
