"""Sampling, forms, copies, terms, containers, leaks and pieces."""

import collections
import itertools
import json
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from runeloom.llm import leaks as leaks_module
from runeloom.llm.format_copies import canonical_object, canonical_record, copies_of_first, copy_counts, json_field
from runeloom.llm.leaks import leaks
from runeloom.llm.pack import MAX_DOCS, best_fit, containers
from runeloom.llm.queries import p8_found, p8_report
from runeloom.llm.sample import block_sample, permuted
from runeloom.llm.shards import load
from runeloom.llm.split_texts import LINE, PARAGRAPH, SENTENCE, boundaries, cut, split_texts
from runeloom.llm.terms import map_terms, term_counts, text_terms, total_records
from runeloom.llm.tokens import TOKENIZER, Tokenizer
from runeloom.llm.visual_form import alike_pairs, visual_form
from runeloom.llm.words import words

# --- sample -------------------------------------------------------------------


def sample_rows(n, delivery=1, start=0):
    return [(start + i, f"id{(start + i) % 1500}", f"text {start + i}", delivery, "x") for i in range(n)]


SAMPLE = "no bigint, id string, en string, delivery int, `__unit` string"


def chosen(df, per_block=100):
    return {tuple(r) for r in block_sample(df, "id", "en", "no", "delivery", per_block).collect()}


def test_sample_is_stable_and_keeps_ids_whole(rows):
    first = rows(sample_rows(2000), SAMPLE)
    a = chosen(first)
    assert a == chosen(first.repartition(7)) and 0.07 < len(a) / 2000 < 0.13
    ids = {r[1] for r in a}
    assert a == {r for r in sample_rows(2000) if r[1] in ids}
    later = sample_rows(2000) + sample_rows(1500, 2, 2000) + [(-5, "id3", "older number, later delivery", 3, None)]
    b = chosen(rows(later, SAMPLE))
    assert a <= b and {r[1] for r in b} >= ids


def test_every_block_has_its_number_of_positions(spark):
    n = spark.range(4 * 1024)
    got = n.select((n.id / 1024).cast("int").alias("block"), permuted(n.id, 1).alias("p"))
    for block, ps in got.groupBy("block").agg({"p": "collect_list"}).collect():
        assert sorted(ps) == list(range(1024)), block


def test_sample_of_rows_without_id(rows):
    data = [(i, None, "same" if i % 2 else None, 1, None) for i in range(400)] + [(None, "a", "b", 1, None)]
    got = chosen(rows(data, SAMPLE), 512)
    assert all(r[0] is not None for r in got)
    with_text = [r for r in got if r[2]]
    assert len(with_text) in (0, 200)
    assert chosen(rows([], SAMPLE)) == set()


# --- forms --------------------------------------------------------------------


def test_forms(rows):
    same = ["Vedilné file, a b", "Vedilné ﬁle, a b", "В".replace("В", "V") + "edilné filе, а b", "Ｖｅｄｉｌｎé file， a　b", "Ved​il­né file, a b﻿"]
    other = ["vedilné file, a b", "Vedilne file, a b", "Vedilné file,  a b", "Vedilné\tfile, a b", "Vedilné file— a b"]
    data = [(i, t) for i, t in enumerate(same + other)] + [(90, None), (91, ""), (92, "  "), (93, " ")]
    got = {(r.a, r.b) for r in alike_pairs(rows(data, "no bigint, en string"), "no", "en").collect()}
    assert got == {(i, j) for i in range(5) for j in range(i + 1, 5)}


def test_marks_are_ordered_and_identical_texts_are_no_pair(rows):
    data = [(1, "ạ́x"), (2, "ạ́x"), (3, "ạ́x"), (1, "ạ́x")]
    got = collections.Counter((r.a, r.b) for r in alike_pairs(rows(data, "no bigint, en string"), "no", "en").collect())
    assert set(got) == {(1, 2), (2, 3)}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aeéоΆ̣​ ﬁＡ x\n", max_size=12), min_size=1, max_size=8))
def test_form_is_normal_and_stable(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "no bigint, en string")
    once = {r.id: r.form for r in visual_form(df, "no", "en").collect()}
    twice = {r.id: r.form for r in visual_form(spark.createDataFrame(list(once.items()), "no bigint, en string"), "no", "en").collect()}
    assert once == twice and all(unicodedata.is_normalized("NFC", t) for t in once.values())


def test_every_ligature_of_letters_is_undone(rows):
    data = [(1, "Ĳsland and ĳs, ﬁre", None), (2, "IJsland and ijs, fire", None), (3, "և", None), (4, "եւ", None), (5, "Ĳ", None), (6, "ij", None)]
    got = alike_pairs(rows(data, "no bigint, en string, x string"), "no", "en").select("a", "b").collect()
    assert {tuple(x) for x in got} == {(1, 2), (3, 4)}


# --- copies -------------------------------------------------------------------


def test_copies(rows):
    data = [(5, "One, two!"), (3, "one TWO"), (9, "o n e t w o"), (4, "one twö"), (7, ""), (8, None), (6, "?!"), (2, "three"), (None, "three"), (2, "three")]
    df = rows(data, "no bigint, en string")
    assert {tuple(r) for r in copies_of_first(df, "no", df.en).collect()} == {(3, 5), (3, 9)}
    got = {r.first_no: (r.copies, r.collided) for r in copy_counts(df, "no", df.en).collect()}
    assert got == {3: (3, False), 4: (1, False), 2: (2, False)}


def test_field_order_and_format_of_whole_records(rows):
    lines = ['{"en": "A b", "kz": "Gor!"}', '{"kz":"gor","en":"a  B","x":""}', '{"en": "gor", "kz": "a b"}', '{"en": "Abgor"}', "no object", None, "{}"]
    df = rows([(i, t) for i, t in enumerate(lines)], "no bigint, line string")
    assert {tuple(r) for r in copies_of_first(df, "no", canonical_object(df.line), True).collect()} == {(0, 1)}
    assert copy_counts(df, "no", canonical_object(df.line), True).count() == 3
    df = rows([(1, "A b", "Gor!"), (2, "a  B", "gor"), (3, "gor", "a b"), (4, "abgor", None), (5, "", " "), (6, None, None)], "no bigint, en string, kz string")
    for fields in ({"en": df.en, "kz": df.kz}, {"kz": df.kz, "en": df.en}):
        assert {tuple(r) for r in copies_of_first(df, "no", canonical_record(fields), True).collect()} == {(1, 2)}
        assert copy_counts(df, "no", canonical_record(fields), True).count() == 3


def test_json_lines(rows):
    lines = ['{"id": 1, "en": "A b"}', '\t{"en":"A b","id":2} ', '{"id": 1, "en": "A b"', '{"en": "A b"} {"en": "c"}', '{"en": "A b"} x', "{'en': 'A b'}", "", None, '{"id": 3}', '{"en": null}', '["en"]', json.dumps({"en": "é\n\"q\""})]
    df = rows([(i, t) for i, t in enumerate(lines)], "no bigint, line string")
    got = {r.no: r.en for r in df.select("no", json_field(df.line, "en").alias("en")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {0: "A b", 1: "A b", 11: 'é\n"q"'}


# --- terms --------------------------------------------------------------------


def test_terms_equal_counting(rows):
    r = random.Random(1)
    texts = [" ".join(r.choices("abcdefghijklmnop", weights=range(16, 0, -1), k=r.randint(0, 9))) for _ in range(60)] + [None, "", "A, a é"]
    df = rows([(t,) for t in texts], "kz string").repartition(3)
    got = {x.term: x for x in term_counts(text_terms(df, "kz", "kz"), total_records(df, "kz", __import__("pyspark").sql.functions.count("kz"))).collect()}
    occurrences = collections.Counter(w for t in texts for w in words(t))
    records = collections.Counter(w for t in texts for w in set(words(t)))
    n = len(texts) - 1
    assert {k: (v.occurrences, v.records) for k, v in got.items()} == {k: (occurrences[k], records[k]) for k in records}
    assert {k: v.mark for k, v in got.items()} == {k: "rare" if c <= 2 else "common" if c * 10 > n else None for k, c in records.items()}


def test_map_terms(rows):
    data = [(1, {"Foo ": 2, "foo": 1, " ": 4}), (1, {"Foo ": 2, "foo": 1, " ": 4}), (2, {"foo": 5}), (3, None), (4, {}), (None, {"foo": 9})]
    blocks = map_terms(rows(data, "no bigint, m map<string,bigint>"), "no", "m", "m")
    assert [tuple(x) for x in blocks.groupBy("field", "term").sum("occurrences", "records").collect()] == [("m", "foo", 8, 2)]


# --- containers ---------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120), st.integers(1, 30))
def test_best_fit_keeps_every_capacity(sizes, docs):
    sizes = np.array(sorted(sizes, reverse=True), dtype=np.int64)
    where = best_fit(sizes, 100, docs, 10_000)
    total = np.bincount(where, weights=sizes, minlength=1) if len(sizes) else np.zeros(1)
    assert total.max() <= 100 and (not len(sizes) or np.bincount(where).max() <= docs)
    assert len(sizes) == 0 or docs < 30 or len(set(where.tolist())) <= 2 * sizes.sum() / 100 + 1


def test_each_capacity_binds():
    sizes = np.array([98] * 3 + [60] * 3 + [30] * 6 + [2] * 80, dtype=np.int64)
    packed = {k: tuple(best_fit(sizes, 100, docs, cost)) for k, docs, cost in (("tokens", 100, 10_000), ("documents", 6, 10_000), ("cost", 100, 3700), ("default", MAX_DOCS, None))}
    assert len(set(packed.values())) == 4
    w = np.array(packed["cost"])
    cost, items = np.bincount(w, weights=sizes * sizes), np.bincount(w)
    assert cost[items > 1].max() <= 3700 and items[w[:3]].tolist() == [1, 1, 1]  # 98 * 98 is more than a container's cost, so these are alone
    assert np.bincount(packed["documents"]).max() == 6 and np.bincount(packed["tokens"], weights=sizes).max() <= 100
    w = np.array(packed["default"])
    assert np.bincount(w)[w[:3]].tolist() == [1, 1, 1] and np.bincount(w).max() <= MAX_DOCS  # 98 + 2 tokens would fit, 0.95 of the cost doesn't


def test_containers(rows):
    r = random.Random(2)
    data = [(i, " ".join(r.choices(["stone", "the hall,", "é"], k=r.choice([1, 5, 60, 700]))), 1) for i in range(300)] + [(900, None, 1), (901, "", 1), (None, "x", 1), (0, "again", 1)]
    got = containers(rows(data, "no bigint, text string, tokens int"), "no", "text", [("s", 64), ("w", 1024)]).toPandas()
    tok = Tokenizer(open(TOKENIZER, "rb").read())
    want = collections.Counter()
    for i, t, _ in data:
        if i is not None:
            want[i] += tok.count(t)
    for (_, cap), part in got.groupby(["limit_name", "capacity"]):
        assert part.groupby("id")["tokens"].sum().to_dict() == want
        assert part.dropna().groupby("container")["tokens"].sum().max() <= cap
        short = part[part["id"].map(want) <= cap]
        assert len(short) == short["id"].nunique() + (1 if want[0] <= cap else 0)  # never cut; id 0 has two rows
        assert set(part[part["container"].isna()]["id"]) == {900, 901}
    again = containers(rows(data, "no bigint, text string, tokens int").repartition(9), "no", "text", [("s", 64), ("w", 1024)]).toPandas()
    key = lambda d: sorted(map(tuple, d.fillna("").astype(str).to_numpy().tolist()))
    assert key(got) == key(again)  # names too
    assert containers(rows([], "no bigint, text string"), "no", "text", [("s", 64)]).count() == 0


# --- leaks --------------------------------------------------------------------


def test_leaks_equal_brute_force(rows, monkeypatch):
    r = random.Random(4)
    text = lambda n: " ".join(r.choices([f"w{i}" for i in range(40)], k=n))
    items = [(i, text(r.choice([1, 3, 8, 11, 12, 13, 30, 60]))) for i in range(40)] + [(90, ""), (91, None), (92, items_text := text(40)), (93, items_text)]
    docs = []
    for i in range(120):
        t = text(r.randint(0, 80)).split()
        if i % 2:
            w = r.choice(items)[1] or ""
            w = w.split()
            k = r.randrange(len(w) + 1)
            t[5:5] = w[k : k + r.choice([5, 11, 12, 20])]
        docs.append((i, ("; " if i % 3 else " ").join(t).upper(), None))
    docs += [(500, None, None), (501, "", None), (502, "filler " * 20_000 + items_text, None)]
    want = set()
    for d, t, _ in docs:
        x = words(t)
        for i, u in items:
            y = words(u)
            n = min(12, len(y))
            if n and {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} & {tuple(y[k : k + n]) for k in range(len(y) - n + 1)}:
                want.add((d, i))
    d, e = rows(docs, "id bigint, text string, item bigint"), rows(items, "item bigint, text string")
    run = lambda: {(x.doc, x.item) for x in leaks(d, "id", "text", e, "item", "text").where("run >= need").collect()}
    assert run() == want and want
    monkeypatch.setattr(leaks_module, "BLOCK_CHARS", 500)
    assert run() == want
    assert leaks(d, "id", "text", e.limit(0), "item", "text").count() == 0


def test_substitutions_are_tolerated(rows):
    t = [f"t{i}" for i in range(24)]
    u = list(t)
    for k in (4, 11, 18):
        u[k] = "other"
    got = leaks(rows([(1, " ".join(u))], "id bigint, text string"), "id", "text", rows([(1, " ".join(t))], "item bigint, text string"), "item", "text").collect()
    assert [(x.run < 12, x.span, x.equal) for x in got] == [(True, 24, 21)]


def test_overlays_of_one_document_are_not_mixed(rows):
    item = [f"t{k}" for k in range(15)]
    good = [w if k not in (5, 9) else "a" for k, w in enumerate(item[:13])]  # 11 of 13 equal
    long = [w if k not in (3, 6, 9, 12) else "b" for k, w in enumerate(item)]  # 11 of 15: not 3 of 4
    for parts in ((good, long), (long, good)):
        text = " ".join([*parts[0], *["z"] * 20, *parts[1]])
        got = leaks(rows([(1, text)], "id bigint, text string"), "id", "text", rows([(1, " ".join(item))], "item bigint, text string"), "item", "text").collect()
        assert [(x.span, x.equal) for x in got] == [(13, 11)]


def test_masks_meet_every_overlap():
    for span in range(12, 24):  # longer ones have a half of at least 12 words with 3 of 4 equal
        for other in itertools.combinations(range(span), span // 4):
            assert any(not {s + m for m in mask} & {*other} for mask in leaks_module.MASKS for s in range(span - mask[-1])), (span, other)


def best_overlap(equal):
    """Longest run, and (span, equal) of the stretch of the best score, the earliest end and the longest of these."""
    run = max((len(list(g)) for k, g in itertools.groupby(equal) if k), default=0)
    stretches = [(3 * sum(equal[i:j]) - 2 * (j - i), -j, j - i, sum(equal[i:j])) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)]
    score, _, span, n = max(stretches, default=(0, 0, 0, 0))
    return run, *((span, n) if score > 0 else (0, 0))


def test_runs_of_many_pairs(monkeypatch):
    r = random.Random(11)
    pairs = [[r.random() < p for _ in range(r.randint(1, 40))] for p in (0, 0.3, 0.6, 0.7, 0.8, 0.9, 1) for _ in range(30)]
    r.shuffle(pairs)
    starts = np.cumsum([0] + [len(x) for x in pairs[:-1]])
    got = leaks_module._runs(np.array(sum(pairs, [])), starts)
    want = [best_overlap(x) for x in pairs]
    assert list(zip(*(x.tolist() for x in got))) == want
    monkeypatch.setattr(leaks_module, "_CELLS", 50)
    x, length = np.array(sum(pairs, [])), np.array([len(x) for x in pairs])
    laid = list(leaks_module._laid(x, starts, np.ones(50, bool), np.zeros(len(pairs), np.int64), length))
    assert len(laid) > 50 and [tuple(v) for v in np.concatenate(laid, axis=1).T.tolist()] == want


def test_report_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    item = [f"i{k}" for k in range(12)]
    items = [(0, " ".join(item)), *[(i, " ".join(f"x{i}_{k}" for k in range(r.choice([5, 11, 12, 16, 20, 40])))) for i in range(1, 30)]]
    docs = [(0, " ".join("other" if k in (2, 5, 8) else w for k, w in enumerate(item)))]
    for d in range(1, 150):
        w = r.choice(items)[1].split()
        share, k = r.choice([0.1, 0.2, 0.25, 0.3]), r.randrange(max(1, len(w) - 11))
        docs.append((d, " ".join(["before"] * r.randint(0, 3) + [f"y{r.random()}" if r.random() < share else v for v in w[k : k + r.choice([12, 16, 40])]])))
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*x, "s", "t") for x in items], "item_id bigint, text string, suite string, split string").write.parquet(f"{tmp_path}/eval_items.parquet")
    want = {}
    for i, u in items:
        y, n = words(u), [0, 0, 0]
        for _, t in docs:
            x = words(t)
            laid = [[x[k] == y[k - s] for k in range(max(0, s), min(len(x), len(y) + s))] for s in range(1 - len(y), len(x))] if {*x} & {*y} else []
            laid = [best_overlap(equal) for equal in laid if any(equal)]
            exact = any(run >= min(12, len(y)) for run, _, _ in laid)
            good = [e for run, span, e in laid if run >= min(12, len(y)) or (span >= 12 and e * 4 >= span * 3)]
            n = [n[0] + exact, n[1] + bool(good), max([n[2], *good])]
        want[i] = tuple(n)
    got = {x.item_id: (x.exact_docs, x.docs, x.most_words) for x in p8_report(spark, str(tmp_path)).collect()}
    assert got == want and any(docs > exact for exact, docs, _ in want.values())


def test_found_comes_through_the_spaced_masks(spark, tmp_path, monkeypatch):
    name = lambda i, n: [f"i{i}x{k}" for k in range(n)]
    items = [(n, " ".join(name(n, n))) for n in range(31)]
    docs = []
    for n in range(1, 31):
        need, w = min(n, 12), ["before", *name(n, n), "after"]
        for at in {1, n - need + 1}:  # the first and the last run
            docs += [(len(docs), " ".join(w[at - 1 : at + need])), (len(docs) + 1, " ".join(w[at : at + need - 1]))]
        docs.append((len(docs), " ".join(v if k % 12 else "other" for k, v in enumerate(w))))  # words 12 and 24 substituted: no run of 12
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    want = set()
    for d, t in docs:
        for i, u in items:
            x, y, n = t.split(), u.split(), min(12, len(u.split()))
            if n and {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} & {tuple(y[k : k + n]) for k in range(len(y) - n + 1)}:
                want.add((d, i))
    paths, write = [], leaks_module.write_shards
    monkeypatch.setattr(leaks_module, "write_shards", lambda *a: paths.append(write(*a)) or paths[-1])
    assert {tuple(r) for r in p8_found(spark, str(tmp_path)).collect()} == want and {i for _, i in want} == {*range(1, 31)}
    tables = {mask: {*ids[item].tolist()} for ids, ts in [(ix.ids, ix.tables) for ix in [load(paths[0], 0, leaks_module.Index)]] for mask, _, _, item, _ in ts}
    # every item is read by every mask that fits into it, and only those under 6 words, into which none fits, are read whole
    assert tables == {m: {*range(m[-1] + 1, 31)} for m in leaks_module.MASKS} | {tuple(range(n)): {n} for n in range(1, 6)}


def test_hits_in_parts(monkeypatch):
    ix = leaks_module.Index(leaks_module.build([(7, "a " * 30), (8, "b a a c"), (9, "a " * 12)]))
    doc, offsets = leaks_module.word_hashes([["a"] * 40, ["b", *"aac"], ["a"] * 3])
    all_hits = lambda: [np.stack(x) for x in ix.hits(doc, offsets)]
    once = all_hits()
    monkeypatch.setattr(leaks_module, "_CELLS", 100)
    parts = all_hits()
    assert len(parts) > 3 * len(once) and max(x.shape[1] for x in parts) <= 100
    assert np.array_equal(np.concatenate(once, axis=1), np.concatenate(parts, axis=1))


# --- pieces -------------------------------------------------------------------

TEXTS = st.lists(st.sampled_from(["stone", "hall", ".", ", ", " ", "\n", "\n\n", "é", "日本語", "🙂", "a" * 40, " The", "!\" "]), min_size=1, max_size=200).map("".join)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer(open(TOKENIZER, "rb").read())


@settings(max_examples=80, deadline=None)
@given(text=TEXTS, sizes=st.sampled_from([(12, 0), (12, 4), (16, 8), (40, 3), (64, 16)]))
def test_pieces_cover_the_text_within_the_limit(tok, text, sizes):
    capacity, overlap = sizes
    ends = tok.ends(text)
    strength, whole = boundaries(text, ends)
    got = cut(strength, whole, capacity, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(ends)
    for (a, b), (c, d) in zip(got, got[1:]):
        assert overlap <= b - c <= overlap + 3 and d > b and c >= a
    assert all(b - a <= capacity for a, b in got)
    at = [0, *ends.tolist()]
    assert [text.encode()[at[a] : at[b]].decode() for a, b in got]


def test_natural_boundaries_come_first(tok):
    paragraph = "One stone fell. The hall was cold, and nobody came. " * 3
    text = "\n\n".join([paragraph.strip()] * 8)
    ends = tok.ends(text)
    strength, whole = boundaries(text, ends)
    per = len(tok.ends(paragraph.strip() + "\n\n"))
    for capacity, least in ((2 * per + 2, PARAGRAPH), (per // 2, SENTENCE)):
        inner = [b for _, b in cut(strength, whole, capacity, 0)[:-1]]
        assert inner and all(strength[b] >= least for b in inner)
    assert LINE > SENTENCE


def test_sentence_ends(tok):
    ends_of = lambda t: [t.encode()[: e].decode() for e, s in zip(tok.ends(t), boundaries(t, tok.ends(t))[0][1:]) if s >= SENTENCE and e < len(t.encode())]
    assert ends_of("Mr. Grim sat. He slept!") == ["Mr. Grim sat."]
    assert [x[-1] for x in ends_of("日本語。日本語！日本語")] == ["。", "！"]
    assert ends_of("3.5 stones (e.g. grey ones) fell") == []


def test_split_texts(rows):
    data = [(1, "a b c. " * 400, "s"), (2, "short", "s"), (3, None, "s"), (4, "", "s"), (5, "x" * 60_000, "s"), (None, "a b " * 500, "s"), (6, "no breaks " * 3000, "s")]
    got = split_texts(rows(data, "no bigint, text string, piece string"), "no", "text", [("s", 64, 8), ("w", 256, 16)]).toPandas()
    assert set(got["id"]) == {1, 5, 6}
    for (i, name), part in got.groupby(["id", "limit_name"]):
        part = part.sort_values("piece")
        assert part["piece"].tolist() == list(range(len(part)))
        assert (part["end_token"] - part["first_token"]).max() <= {"s": 64, "w": 256}[name]
    with pytest.raises(ValueError):
        split_texts(rows(data, "no bigint, text string, piece string"), "no", "text", [("s", 16, 16)])
