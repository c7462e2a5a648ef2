"""Near-duplicates and overlaps between splits, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runeloom.llm import near_duplicates as nd
from runeloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from runeloom.llm.overlap_index import Searcher, build, merged, overlaps
from runeloom.llm.queries import p5_found
from runeloom.llm.words import word_hashes, words
from runeloom.operators.graph import components

SCHEMA = "no bigint, en string, kz string, split string, `group` string"


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 8 else None


def alike(x, y):
    for a, b in ((x[1], y[1]), (x[2], y[2])):
        s, t = shingle_set(a), shingle_set(b)
        if s and t and len(s & t) * 5 >= 3 * len(s | t):
            return True
    return False


@pytest.fixture(scope="module")
def records():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))

    def edited(t, share):
        return " ".join(r.choice(vocabulary) if r.random() < share else w for w in t.split())

    out, base = [], [(text(r.randint(8, 120)), text(r.randint(8, 120))) for _ in range(60)]
    for i in range(400):
        en, kz = r.choice(base)
        kind = r.randrange(6)
        if kind == 0:
            en, kz = text(60), text(60)
        elif kind == 1:
            en, kz = edited(en, r.choice([0.02, 0.05, 0.1])), text(40)
        elif kind == 2:
            en, kz = en.upper().replace(" ", ",  "), edited(kz, 0.05)
        elif kind == 3:
            half = en.split()
            en = " ".join(half[len(half) // 2 :] + half[: len(half) // 2])
            kz = None
        elif kind == 4:
            en, kz = en + " " + text(10), kz
        out.append((i, en, kz, r.choice(["train", "val", "test", None]), "x"))
    return out + [(1000, "", "", "train", None), (1001, None, None, "val", None), (1002, "one two three", "a b", "train", "y"), (1003, "one two three", "a b", "val", "y"), (1004, "w1 " * 5000, None, "train", "z"), (1005, "w1 " * 9000, None, "test", "z")]


def brute_pairs(records):
    return {(a[0], b[0]) for i, a in enumerate(records) for b in records[i + 1 :] if alike(a, b)}


def test_groups_equal_brute_force(rows, records):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(records):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {(find(x), x) for x in parent}
    got = near_duplicate_groups(rows(records, SCHEMA), "no", ["en", "kz"], 3, 8, (3, 5))
    assert {tuple(x) for x in got.collect()} == want
    for keys, per_key in ((80, 5), (120, 7)):  # the latter keys are hashed
        got = near_duplicate_groups(rows(records, SCHEMA), "no", ["en", "kz"], 3, 8, (3, 5), keys, per_key)
        assert len({tuple(x) for x in got.collect()} ^ want) <= (0 if per_key == 5 else 0.1 * len(want))


def test_no_rows_and_no_texts(rows):
    for data in ([], [(1, None, None, None, None)], [(None, "a b c d e f g h i", None, None, None)] * 2):
        links, members = near_duplicate_pairs(rows(data, SCHEMA), "no", ["en", "kz"])
        assert links.count() == members.count() == 0


def test_default_is_five_words_and_four_fifths(rows):
    t = " ".join(f"a{i}" for i in range(60))
    data = [(1, t, None, None, None), (2, t.replace("a30", "b"), None, None, None), (3, t.replace("a30", "b").replace("a10 ", "c ").replace("a45", "d"), None, None, None)]
    links = near_duplicate_pairs(rows(data, SCHEMA), "no", ["en"])[0].collect()
    assert {(x.a, x.b) if x.a < x.b else (x.b, x.a) for x in links} == {(1, 2)}  # 51 of 61 in common; 1 and 3: 41 of 71


def test_long_lists_are_compared_block_by_block(rows, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    t = " ".join(f"a{i}" for i in range(80))
    data = [(i, t.replace(f"a{i + 20} ", "b "), None, None, None) for i in range(30)]
    links = near_duplicate_pairs(rows(data, SCHEMA), "no", ["en"], 3, 8, (3, 5))[0]
    assert {(min(x.a, x.b), max(x.a, x.b)) for x in links.collect()} == {(i, j) for i in range(30) for j in range(i + 1, 30)}


@pytest.mark.parametrize("block", [2, 5, 20])
def test_groups_don_t_depend_on_blocks(rows, records, monkeypatch, block):
    want = {tuple(x) for x in near_duplicate_groups(rows(records, SCHEMA), "no", ["en", "kz"], 3, 8, (3, 5)).collect()}
    monkeypatch.setattr(nd, "BLOCK", block)
    assert {tuple(x) for x in near_duplicate_groups(rows(records, SCHEMA).repartition(5), "no", ["en", "kz"], 3, 8, (3, 5)).collect()} == want


def test_parts_of_long_lists_that_only_far_members_join(rows, monkeypatch):
    # each text is alike with its neighbours only, so the list's first text connects few
    monkeypatch.setattr(nd, "BLOCK", 3)
    data = [(i, " ".join(f"a{k}" for k in range(6 * i, 6 * i + 60)), None, None, None) for i in range(25)]
    got = {(x.group, x.id) for x in near_duplicate_groups(rows(data, SCHEMA), "no", ["en"], 3, 8, (3, 5)).collect()}
    assert got == {(0, i) for i in range(25)}


def test_lists_across_batches(monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 3)
    key = np.array([0, 1, 1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 4, 5, 5, 6, 6], dtype=np.int64)
    cls = np.array([8, 1, 2, 2, 1, 3, 1, 2, 3, 4, 5, 6, 1, 7, 9, 1, 2], dtype=np.int64)
    for size in (1, 2, 3, 17):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(cls[i : i + size])], names=["key", "cls"]) for i in range(0, 17, size))
        out = [r for b in nd._lists(batches) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in out if r["b"] is not None} == {(1, 2), (1, 3), (7, 9)}
        assert {(r["key"], r["a"]) for r in out if r["key"] is not None} == {(0, 8), *((3, c) for c in range(1, 7)), (6, 1), (6, 2)}


def test_likeness_guarantees_the_tally():
    r = np.random.default_rng(1)
    least = nd.least_bytes((3, 5), nd.TALLY)
    seen = []
    for _ in range(300):
        common, a, b = (r.integers(0, 2**63, n, dtype=np.uint64) for n in (60, 20, 20))
        s = nd.signatures(np.concatenate([common, a, common, b]), np.array([0, 80, 160]), nd.TALLY)
        seen.append(int((s[0] == s[1]).sum()))
    assert min(seen) >= least > 0.25 * nd.TALLY and 0.55 * nd.TALLY < np.mean(seen) < 0.65 * nd.TALLY


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_overlaps_equal_brute_force(rows, records):
    split = {r[0]: r[3] for r in records}
    want = {(a, b) if split[a] == "train" else (b, a) for a, b in brute_pairs(records) if None not in (split[a], split[b]) and (split[a] == "train") != (split[b] == "train")}
    df = rows(records, SCHEMA)
    got = overlaps(df, "no", ["en", "kz"], F.col("split").isin("val", "test"), F.col("split") == "train", 3, 8, (3, 5))
    assert {(x.train, x.eval) for x in got.collect()} == want and want
    none = df.where("split = 'train'")
    assert overlaps(none, "no", ["en", "kz"], F.col("split").isin("val", "test"), F.col("split") == "train").count() == 0


def test_shards(rows, records, monkeypatch):
    from runeloom.llm import overlap_index as oi

    df = rows(records, SCHEMA)
    args = (df, "no", ["en", "kz"], F.col("split").isin("val", "test"), F.col("split") == "train", 3, 8, (3, 5))
    one = sorted(map(tuple, overlaps(*args).select("train", "eval", "field").collect()))
    monkeypatch.setattr(oi, "SHARD_WORDS", 1500)
    assert sorted(map(tuple, overlaps(*args).select("train", "eval", "field").collect())) == one


def test_maximal_matches_and_spans():
    r = random.Random(8)
    held = [" ".join(r.choices("abcdef", k=r.randint(1, 60))) for _ in range(20)]
    streamed = [" ".join(held[r.randrange(20)].split()[3:40] + r.choices("abcx", k=5) + held[r.randrange(20)].split()[:30]) for _ in range(20)]
    hashes, offsets = word_hashes([words(t) for t in streamed])
    got = Searcher(build(held)).matches(hashes, offsets)
    want, cover = set(), {}
    for i, t in enumerate(streamed):
        x = words(t)
        for j, u in enumerate(held):
            y = words(u)
            for shift in range(-len(x), len(y)):
                k = max(0, -shift)
                while k < min(len(x), len(y) - shift):
                    e = k
                    while e < min(len(x), len(y) - shift) and x[e] == y[e + shift]:
                        e += 1
                    if e - k >= 8:
                        want.add((i, j, int(offsets[i]) + k, int(offsets[i]) + e))
                    k = e + 1
    found = set(zip(*(a.tolist() for a in got)))
    assert want <= found and want and all(hi - lo >= 6 for _, _, lo, hi in found)
    for i, j, lo, hi in found:
        cover.setdefault((i, j), set()).update(range(lo, hi))
    own, doc, covered, spans = merged(*got)
    assert {(i, j): n for i, j, n in zip(own.tolist(), doc.tolist(), covered.tolist())} == {k: len(v) for k, v in cover.items()}
    assert {(i, j): n for i, j, n in zip(own.tolist(), doc.tolist(), spans.tolist())} == {k: sum(x - 1 not in v for x in v) for k, v in cover.items()}


def test_overlaps_of_texts_that_repeat_themselves(rows, spark, tmp_path):
    story = " ".join(f"a{i}" for i in range(40))
    long = " ".join(f"b{i}" for i in range(30))
    data = [(1, story, None, "val", "x"), (2, story + " hey ho hi" * 60, None, "train", "x"), (3, story + " " + " ".join(f"c{i}" for i in range(180)), None, "train", "x")]
    data += [(4, long, "la " * 500 + long, "test", "x"), (5, "la " * 900 + long, "na " * 900 + long, "train", "x"), (6, "b3 b4 b5 b6 b7 b8 " * 30, None, "train", "x")]
    split = {r[0]: r[3] for r in data}
    want = {(a, b) for a, b in brute_pairs(data) if (split[a] == "train") != (split[b] == "train")}
    assert (1, 2) in want and (4, 5) in want and (1, 3) not in want
    rows(data, SCHEMA).withColumnRenamed("no", "ordinal").write.parquet(f"{tmp_path}/parallel_records.parquet")
    assert {(x.ordinal_a, x.ordinal_b) for x in p5_found(spark, str(tmp_path)).collect()} == want


def test_words_of_indexed_texts():
    r = random.Random(4)
    texts = ["", *(" ".join(r.choices("abc", k=r.randint(1, 40))) for _ in range(30)), ""]
    hashes, offsets = Searcher(build(texts)).words_of(np.array([0, 3, 3, 31, 30]))
    want = word_hashes([words(texts[k]) for k in (0, 3, 3, 31, 30)])
    assert hashes.tolist() == want[0].tolist() and offsets.tolist() == want[1].tolist()


def test_backward_search_finds_all_occurrences():
    r = random.Random(3)
    texts = [" ".join(r.choices("abc", k=r.randint(1, 40))) for _ in range(50)]
    s = Searcher(build(texts))
    queries = [" ".join(r.choices("abcd", k=r.randint(3, 15))) for _ in range(80)] + texts[:5]
    split = [words(t) for t in queries]
    at, doc, diagonal = s.hits(*word_hashes(split))
    got = {(int(p), int(d)) for p, d in zip(at, doc)}
    offset, want = 0, set()
    for q in split:
        for i in range(len(q) - 5):
            if i % 3 == 0 or len(q) < 20 or i + 6 == len(q):
                for d, t in enumerate(texts):
                    w = words(t)
                    if any(w[j : j + 6] == q[i : i + 6] for j in range(len(w))):
                        want.add((offset + i, d))
        offset += len(q)
    assert got == want and want


def test_a_third_of_all_rows_are_copies(rows):
    r = random.Random(9)
    text = lambda: " ".join(r.choices([f"w{i}" for i in range(200)], k=40))
    hot = text()
    data = [(i, hot.upper() if i % 2 else hot, None, "train" if i % 5 else "val", None) for i in range(400)] + [(1000 + i, text(), None, "train", None) for i in range(800)] + [(5000, hot.replace(hot.split()[7], "other"), None, "test", None)]
    df = rows(data, SCHEMA).repartition(6)
    got = {(x.group, x.id) for x in near_duplicate_groups(df, "no", ["en", "kz"], 3, 8, (3, 5)).collect()}
    assert got == {(0, i) for i in range(400)} | {(0, 5000)}
    pairs = overlaps(df, "no", ["en"], F.col("split").isin("val", "test"), F.col("split") == "train", 3, 8, (3, 5))
    assert pairs.count() == 320 * 81
