"""The lexicon as tables: senses, checks, status, compiled form, merging, fingerprint."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runeloom.functions.morphology import PARADIGM, inflect_col
from runeloom.functions.sounds import root_problems
from runeloom.operators.near import within_one_pairs

CONTENT_POS = ("NOUN", "VERB", "ADJ", "ADV", "INTJ")
ORIGINS = ("invented", "borrowed", "derived")
BORROWED_BUDGET = 60


def senses(content: DataFrame) -> DataFrame:
    """(lemma, pos, kz): one row for each sense "lemma/POS" of the content words; a sense without a lemma or with another class has ``bad`` set."""
    s = content.select("kz", F.explode("en").alias("sense"))
    s = s.withColumn("pos", F.substring_index("sense", "/", -1)).withColumn("lemma", F.expr("left(sense, length(sense) - length(pos) - 1)"))
    return s.select("lemma", "pos", "kz", (~F.col("sense").contains("/") | (F.col("lemma") == "") | ~F.col("pos").isin(*CONTENT_POS)).alias("bad"))


def sense_index(content: DataFrame) -> DataFrame:
    """(lemma, pos, kz): the compiled index, one word for each good sense, the first by spelling where several claim it."""
    return senses(content).where("not bad").groupBy("lemma", "pos").agg(F.min("kz").alias("kz"))


def function_words(functions: DataFrame, cats: Iterable[str] | None = None) -> DataFrame:
    """(word, kz): single English words of the function words; of entries that share one, the first by ``entry`` if there is such a column, else by spelling."""
    f = functions.where(F.col("cat").isin(*cats)) if cats else functions
    order = F.col("entry") if "entry" in functions.columns else F.col("kz")
    e = f.select("kz", order.alias("o"), F.explode("en").alias("w")).withColumn("word", F.regexp_replace(F.lower("w"), r" \(.*", "")).where(~F.col("word").contains(" "))
    return e.groupBy("word").agg(F.min_by("kz", F.struct("o", "kz")).alias("kz"))


@F.pandas_udf(T.StringType())
def _problems(words: pd.Series) -> pd.Series:
    return words.map(lambda w: "; ".join(root_problems(w)) if w else None)


def paradigm(content: DataFrame) -> DataFrame:
    """(kz, pos, tags, form): every inflected form of every content word, on the JVM."""
    table = F.create_map(*[x for p, forms in PARADIGM.items() for x in (F.lit(p), F.array(*[F.array(*map(F.lit, t)) for t in forms]).cast("array<array<string>>"))])
    s = senses(content).where("not bad").select("kz", "pos").distinct()
    s = s.select("kz", "pos", F.explode(F.try_element_at(table, F.col("pos"))).alias("tags"))
    return s.withColumn("form", inflect_col(F.col("kz"), F.col("tags")))


def _messages(df: DataFrame, severity: str, rule: str, kz: Column, message: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), kz.alias("kz"), message.alias("message"))


def validate(content: DataFrame, functions: DataFrame, english: DataFrame | None = None, profane: Iterable[str] = (), profane_parts: Iterable[str] = ()) -> DataFrame:
    """(severity, rule, kz, message) of everything wrong in the lexicon: ``content`` (kz, en, origin, from_lang, base), ``functions`` (kz, en, cat, origin).

    Rules: spelling used twice, sense owned twice, bad sense, unknown origin, ill-formed or English invented root, borrowed word without source, derived word that its base
    doesn't give, profane word or form, more borrowed words than the budget, roots one edit apart, forms that clash. ``english`` (word) is optional; without it its rules are silent."""
    c, col, s = content.withColumn("origin", F.coalesce("origin", F.lit(""))), F.col, F.concat
    out = []
    spelled = c.select("kz").unionByName(functions.select("kz")).groupBy("kz").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out.append(_messages(spelled, "error", "spelling", col("kz"), F.lit("spelling used more than once")))
    sn = senses(c)
    out.append(_messages(sn.where("bad"), "error", "bad sense", col("kz"), s(col("lemma"), F.lit("/"), col("pos"))))
    owned = sn.where("not bad").groupBy("lemma", "pos").agg(F.count_distinct("kz").alias("n"), F.array_join(F.array_sort(F.collect_set("kz")), ", ").alias("all")).where("n > 1")
    out.append(_messages(owned, "error", "sense", col("all"), s(col("lemma"), F.lit("/"), col("pos"), F.lit(" has several words"))))
    out.append(_messages(c.where(~col("origin").isin(*ORIGINS)), "error", "origin", col("kz"), s(F.lit("unknown origin "), col("origin"))))
    roots = c.where("origin = 'invented'").select("kz").distinct().withColumn("p", _problems("kz")).where("p <> ''")
    out.append(_messages(roots, "error", "root", col("kz"), col("p")))
    out.append(_messages(c.where("origin = 'borrowed' and coalesce(from_lang, '') = ''"), "error", "borrowed", col("kz"), F.lit("no source language")))
    parts = F.split("base", r"\+")
    d = c.where("origin = 'derived'").select("kz", "base", F.coalesce(parts[0], F.lit("")).alias("root"), F.coalesce(F.slice(parts, 2, 99), F.array().cast("array<string>")).alias("tags"))
    known = c.select(col("kz").alias("root")).unionByName(functions.select(col("kz").alias("root"))).distinct().withColumn("known", F.lit(True))
    d = d.join(known, "root", "left").withColumn("gives", inflect_col(col("root"), col("tags")))
    out.append(_messages(d.where("known is null"), "error", "base", col("kz"), s(F.lit("base root is not in the lexicon: "), col("root"))))
    out.append(_messages(d.where("known and gives is null"), "error", "base", col("kz"), s(F.lit("bad derivation "), col("base"))))
    out.append(_messages(d.where("known and gives <> kz"), "error", "base", col("kz"), s(col("base"), F.lit(" gives "), col("gives"))))
    forms = paradigm(c).distinct().withColumn("label", s(col("kz"), F.lit("+"), F.array_join("tags", "+")))
    if profane or profane_parts:
        foul = lambda w: w.isin(*profane) | (w.rlike("|".join(profane_parts)) if profane_parts else F.lit(False))
        out.append(_messages(c.where(foul(col("kz"))), "error", "profane", col("kz"), F.lit("profane word")))
        out.append(_messages(forms.where(foul(col("form"))), "error", "profane", col("kz"), s(col("label"), F.lit(" is profane: "), col("form"))))
    both = c.select("kz", "origin").unionByName(functions.select("kz", "origin"))
    budget = both.agg(F.count_if(col("origin") == "borrowed").alias("n")).where(col("n") > BORROWED_BUDGET)
    out.append(_messages(budget, "warning", "budget", F.lit(None).cast("string"), s(col("n").cast("string"), F.lit(" borrowed words"))))
    own = c.where("origin <> 'derived'").select(col("kz").alias("word"), F.lit(True).alias("content"))
    all_ = own.unionByName(functions.where("origin <> 'derived'").select(col("kz").alias("word"), F.lit(False).alias("content"))).groupBy("word").agg(F.max("content").alias("content"))
    close = within_one_pairs(all_).join(all_.select(col("word").alias("a"), col("content").alias("ca")), "a").join(all_.select(col("word").alias("b"), col("content").alias("cb")), "b").where("ca or cb")
    out.append(_messages(close, "error", "near", col("a"), s(col("a"), F.lit(" / "), col("b"), F.lit(": one letter apart"))))
    taken = both.select(col("kz").alias("form")).distinct()
    out.append(_messages(forms.where("form <> kz").join(taken, "form", "left_semi"), "error", "form", col("kz"), s(col("label"), F.lit(" is a word of the lexicon: "), col("form"))))
    twice = forms.select("form", "label").distinct().groupBy("form").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 1)
    out.append(_messages(twice, "error", "form", col("labels")[0], s(F.array_join("labels", " and "), F.lit(" give "), col("form"))))
    if english is not None:
        e = english.select("word").distinct()
        hit = lambda df, w: df.join(e.withColumnRenamed("word", w), w, "left_semi")
        out.append(_messages(hit(c.where("origin = 'invented'"), "kz"), "error", "english", col("kz"), F.lit("invented root is an English word")))
        out.append(_messages(hit(c.where("origin = 'derived'"), "kz"), "warning", "english", col("kz"), F.lit("derived word is an English word")))
        out.append(_messages(hit(forms, "form"), "warning", "english", col("kz"), s(col("label"), F.lit(" is an English word: "), col("form"))))
    x = out[0]
    for o in out[1:]:
        x = x.unionByName(o)
    return x


def compile_lexicon(content: DataFrame, functions: DataFrame, path: str, errors: DataFrame | None = None) -> Path:
    """Write the compiled lexicon as JSON (function, content with forms, en_index). Refuses a lexicon with errors. The lexicon is some thousand words, so the driver holds it."""
    if errors is not None and not errors.where("severity = 'error'").isEmpty():
        raise ValueError("the lexicon has errors")
    forms: dict[str, dict[str, list[str]]] = {}
    for r in paradigm(content).collect():
        forms.setdefault(r.kz, {})[r.form] = list(r.tags)
    out = {
        "function": [r.asDict(True) for r in functions.collect()],
        "content": [r.asDict(True) | {"forms": forms.get(r.kz, {})} for r in content.collect()],
        "en_index": {f"{r.lemma}/{r.pos}": r.kz for r in sense_index(content).collect()},
    }
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(out, ensure_ascii=False, indent=1, default=str), encoding="utf-8")
    return p


def merge_entries(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Lexicon rows (kz, en, origin, from_lang, base) with accepted ones (kz, sense, origin, from_lang, base) merged in: senses of a word that exists are added to it, other words are new entries.
    Only senses of kind ``shared`` give a word no origin of its own; without any it is ``invented``."""
    first = lambda c: F.max(F.when(F.col("origin") != "shared", F.col(c))).alias(c)
    add = new.groupBy("kz").agg(F.array_sort(F.collect_set("sense")).alias("add"), *[first(c).alias(f"new_{c}") for c in ("origin", "from_lang", "base")])
    x = existing.select("kz", "en", "origin", "from_lang", "base", F.lit(True).alias("old")).join(add, "kz", "full_outer")
    en = F.when(F.col("add").isNull(), F.col("en")).when(F.col("old"), F.concat("en", F.array_except("add", "en"))).otherwise(F.col("add"))
    pick = lambda c, d=None: F.when(F.col("old"), F.col(c)).otherwise(F.coalesce(F.col(f"new_{c}"), F.lit(d))).alias(c)
    return x.select("kz", en.alias("en"), pick("origin", "invented"), pick("from_lang"), pick("base"))


def fingerprint(paths: Iterable[str]) -> str:
    """Twelve digits that change when a file does, but not with the platform's line ends. Missing files count as absent."""
    h = hashlib.sha256()
    for p in map(Path, paths):
        if p.exists():
            h.update(p.name.encode() + b"\0" + b"\n".join(p.read_bytes().split(b"\r\n")) + b"\0")
    return h.hexdigest()[:12]


def load_content_yaml(spark, paths: Iterable[str]) -> DataFrame:
    """Content words from YAML files (entries with kz, en, origin, from, base, notes). A missing file is empty; words that YAML reads as booleans, and bad senses, raise ValueError."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    rows = []
    for p in map(Path, paths):
        for x in (yaml.safe_load(p.read_text(encoding="utf-8")) or {}).get("entries") or [] if p.exists() else []:
            if odd := [v for v in x["en"] if not isinstance(v, str)]:
                raise ValueError(f"{x['kz']}: {odd} in en must be quoted")
            if bad := [v for v in x["en"] if not v.rpartition("/")[0] or v.rpartition("/")[2] not in CONTENT_POS]:
                raise ValueError(f"{x['kz']}: bad sense {bad[0]!r}")
            rows.append((x["kz"], x["en"], x["origin"], x.get("from"), x.get("base"), x.get("notes"), p.stem))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["kz", "en", "origin", "from_lang", "base", "notes", "tier"]) if rows else [], "kz string, en array<string>, origin string, from_lang string, base string, notes string, tier string")


def write_content_yaml(content: DataFrame, folder: str) -> list[Path]:
    """Content words (with ``tier``) back to one YAML file for each tier; files that wouldn't change are left alone. Returns the files written."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("writing YAML needs PyYAML") from e
    tiers: dict[str, list[dict]] = {}
    for r in content.orderBy("tier", "kz").collect():
        entry = {"kz": r.kz, "en": list(r.en), "origin": r.origin, "from": r.from_lang, "base": r.base, "notes": r.notes if "notes" in content.columns else None}
        tiers.setdefault(r.tier, []).append({k: v for k, v in entry.items() if v})
    written = []
    for tier, entries in tiers.items():
        p, text = Path(folder) / f"{tier}.yaml", yaml.safe_dump({"entries": entries}, allow_unicode=True, sort_keys=False)
        if not p.exists() or p.read_text(encoding="utf-8") != text:
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text, encoding="utf-8")
            written.append(p)
    return written
