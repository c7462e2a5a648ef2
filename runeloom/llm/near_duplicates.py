"""Near-duplicate texts by a byte-position inverted index with count filtering.

Every text gets a signature of 192 bytes: position k holds one byte of the smallest value that the k-th
permutation gives to any of its word sequences. Two texts whose sets have the share j in common agree at a
position with probability j (+ 1/256). The inverted index maps positions with their bytes to texts. A list
for one byte would hold 1/256 of all texts, so four neighbouring positions form one key, whose list holds the
texts that agree in all four; pairs that meet in any list are tallied. The tally is the number of the first
TALLY positions at which their bytes are equal. One rule holds for every pair, however long the list it comes
from: it is retained if the tally reaches the minimum that likeness guarantees (``least_bytes``), before any text
is looked at. What remains is compared exactly. Texts with j = 0.6 share a key with probability 0.9987, with 0.65
0.9999, with 0.7 0.999998; the minimum loses one of them in 10**9.

Copies (same words in the same order) are one class and enter the index once per task. Postings are put in order
by range of (key, text), so that a list which holds very many texts lies in several tasks. Pairs are made in one
task of lists that lie inside one partition and have up to ``BLOCK`` members. Of longer lists every member first meets the list's
first text; for groups, members which that and all other links connect already need no further comparison among
each other, and only what lies outside a list's largest part is compared, block by block in separate tasks, with all
members. So a list of a third of all texts that are alike costs one comparison a member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runeloom.llm.verify import asked_only, long_texts, verify
from runeloom.llm.words import shingles, slices, words
from runeloom.operators.graph import components
from runeloom.work import materialize, spread

#: Keys of a text, and positional bytes in each. Unrelated texts with the share j in common meet under a key with probability (j + 1/256)**4, so
#: pairs to tally grow with the square of the texts, by 2 in a million here; beyond some ten million texts, 80 keys of 5 bytes keep them few.
KEYS, PER_KEY = 48, 4
#: Positions whose equal bytes are tallied.
TALLY = 96
#: Members of an index list up to which its pairs are made in one task, and of a block of longer lists.
BLOCK = 512
#: Texts hashed at a time: their values stay in the processor's cache.
_SLICE = 1024


def _multipliers(positions: int) -> np.ndarray:
    """Odd numbers; multiplication by one is a permutation of 32-bit numbers."""
    return (np.random.default_rng(20240229).integers(0, 2**31, positions, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def signatures(hashes: np.ndarray, offsets: np.ndarray, positions: int) -> np.ndarray:
    """One row of bytes, one a position, for each text (none may be empty)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    multipliers = _multipliers(positions)
    out = np.empty((len(offsets) - 1, positions), dtype=np.uint8)
    for lo in range(0, len(out), _SLICE):
        hi = min(lo + _SLICE, len(out))
        part, starts = x[offsets[lo] : offsets[hi]], offsets[lo:hi] - offsets[lo]
        buf = np.empty_like(part)
        for k, a in enumerate(multipliers):
            np.multiply(part, a, out=buf)
            low = np.minimum.reduceat(buf, starts)
            low *= np.uint32(0x9E3779B1)
            out[lo:hi, k] = low >> np.uint32(24)
    return out


def _features(size: int, least_words: int, fields: int, positions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            for f in range(fields):
                split = [words(t) for t in batch.column(1 + f).to_pylist()]
                keep = [i for i, w in enumerate(split) if len(w) >= max(least_words, size)]
                if not keep:
                    continue
                split = [split[i] for i in keep]
                # the class: a hash of the words in order; its lowest bits are the field
                cls = [(xxhash.xxh3_64_intdigest(" ".join(w)) >> 1) // fields * fields + f for w in split]
                new = []
                for i, c in enumerate(cls):
                    if c not in seen:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        seen.add(c)
                        new.append(i)
                sig: list[bytes | None] = [None] * len(keep)
                if new:
                    for i, s in zip(new, signatures(*shingles([split[i] for i in new], size), positions)):
                        sig[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids[keep], pa.int64()), pa.array(cls, pa.int64()), pa.array(sig, pa.binary())], names=["id", "cls", "sig"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _postings(keys: int, per_key: int):
    """A key is the number of its group of positions and their bytes (hashed where they would pass 48 bits)."""
    base = np.arange(keys, dtype=np.int64) << 48
    shift = (np.arange(per_key, dtype=np.int64) * 8) if per_key <= 6 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column("sig")).reshape(b.num_rows, keys, per_key).astype(np.int64)
                value = (m << shift).sum(axis=2) if shift is not None else (m * (np.int64(0x5851F42D4C957F2D) ** np.arange(1, per_key + 1, dtype=np.int64))).sum(axis=2) & np.int64(2**48 - 1)
                cls = np.repeat(b.column("cls").to_numpy(), keys)
                yield pa.RecordBatch.from_arrays([pa.array((value + base).ravel()), pa.array(cls)], names=["key", "cls"])

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From one range of postings in the order of (key, cls): (a, b) for the pairs of every list that lies inside and has up to BLOCK members;
    (a, key) for the members of longer lists and of the first and the last one, which may go on in the neighbouring ranges."""
    key, cls = np.zeros(0, np.int64), np.zeros(0, np.int64)
    open_key: int | None = None  # the list whose members are being passed on

    def pairs(a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    def members(c, k) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c), pa.nulls(len(c), pa.int64()), pa.array(k)], names=["a", "b", "key"])

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal key, cls, open_key
        if not len(key):
            return
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        key, cls = key[fresh], cls[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        open_key = int(key[0]) if open_key is None else open_key
        passed = (sizes > BLOCK) | (key[starts] == open_key)
        passed[-1] |= last
        if passed.any():
            rows = np.repeat(passed, sizes)
            yield members(cls[rows], key[rows])
        inside = np.repeat(~passed, sizes)
        rest = slice(len(key), None)
        if passed[-1]:
            open_key = int(key[-1])
        else:
            rest = slice(starts[-1], None)
            inside[rest] = False
        k, c = key[inside], cls[inside]
        at, d = np.arange(len(k)), 1
        while True:
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if not len(at):
                break
            yield pairs(c[at], c[at + d])
            d += 1
        key, cls = key[rest], cls[rest]

    for b in batches:
        key, cls = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([cls, b.column(1).to_numpy()])
        yield from flush(False)
    yield from flush(True)


def least_bytes(threshold: tuple[int, int], positions: int) -> int:
    """The positional bytes that a pair at the threshold shares at least, but for one in 10**9: six deviations under the mean."""
    j = threshold[0] / threshold[1]
    return max(0, int(positions * j - 6 * (positions * j * (1 - j)) ** 0.5))


def _tally(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of keys whose signatures (key, sig) agree in ``least`` positions. Only signatures that some pair names are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                same = (_matrix(x.column("sa")) == _matrix(x.column("sb"))).sum(axis=1)
                yield x.select(["a", "b"]).filter(pa.array(same >= least))

    s = asked_only(sigs, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    j = pairs.join(s.select(F.col("key").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("key").alias("b"), F.col("sig").alias("sb")), "b")
    return j.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _block_pairs(least: int):
    """Of one block of members against another: the pairs in different parts whose signatures agree in ``least`` positions."""

    def run(pdf):
        import pandas as pd

        sig, node, root = _matrix(pa.array(pdf["sig"])), pdf["node"].to_numpy(), pdf["root"].to_numpy()
        left, right = np.flatnonzero(pdf["outer"].to_numpy()), np.flatnonzero(~pdf["outer"].to_numpy())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in left:
            near = right[((sig[right] == sig[i]).sum(axis=1) >= least) & (root[right] != root[i])]
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
        a, b = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _across(lists: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs within long lists (key, node, root) whose ends are in different parts (roots): whatever is outside a list's largest part
    against all members, block by block; a block is a share of the members by hash."""
    parts = lists.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("root", "n").alias("main")).where("all > most")
    x = lists.join(sizes, "key").join(sigs.withColumnRenamed("key", "node"), "node")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), blocks(n)).cast("int")
    x = x.withColumn("out", F.col("all") - F.col("most"))
    outer = x.where("root <> main").select("key", own("out", 1).alias("lb"), F.explode(F.sequence(F.lit(0), blocks("all") - 1)).alias("rb"), "node", "root", "sig", F.lit(True).alias("outer"))
    every = x.select("key", F.explode(F.sequence(F.lit(0), blocks("out") - 1)).alias("lb"), own("all", 2).alias("rb"), "node", "root", "sig", F.lit(False).alias("outer"))
    return outer.unionByName(every).groupBy("key", "lb", "rb").applyInPandas(_block_pairs(least), "a bigint, b bigint").distinct()


def _search(df: DataFrame, id_col: str, fields: list[str], size: int, least_words: int, threshold: tuple[int, int], keys: int, per_key: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Links and members, see below. Unless ``every`` link is wanted, long lists give only links between what is not connected yet."""
    n = len(fields)
    src = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[F.col(f).alias(f"t{i}") for i, f in enumerate(fields)])
    feats = materialize(spread(src).mapInArrow(_features(size, least_words, n, keys * per_key), "id bigint, cls bigint, sig binary"), "features")
    firsts = feats.where("sig is not null")
    posts = firsts.select("cls", "sig").mapInArrow(_postings(keys, per_key), "key bigint, cls bigint").repartitionByRange("key", "cls").sortWithinPartitions("key", "cls")
    found = materialize(posts.mapInArrow(_lists, "a bigint, b bigint, key bigint"), "candidates")
    # the representative of a class is a text that carries its signature
    classes = feats.groupBy("cls").agg(F.min(F.when(F.col("sig").isNotNull(), F.col("id"))).alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    node = (F.col("rep") * n + F.pmod(F.col("cls"), F.lit(n))).alias("node")
    nodes = classes.select("cls", node)
    positions = min(TALLY, keys * per_key)
    sigs = firsts.select((F.col("id") * n + F.pmod(F.col("cls"), F.lit(n))).alias("key"), F.substring("sig", 1, positions).alias("sig"))
    least = least_bytes(threshold, positions)
    texts = long_texts(src, "id", [f"t{i}" for i in range(n)])

    listed = found.where("key is not null").select("key", F.col("a").alias("cls")).distinct()
    listed = materialize(listed.join(listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key").join(nodes, "cls").select("key", "node", "n"), "lists")
    border, long = listed.where(F.col("n") <= BLOCK).select("key", "node"), listed.where(F.col("n") > BLOCK).select("key", "node")
    pairs = found.where("b is not null").select("a", "b").distinct()
    pairs = pairs.join(nodes.select(F.col("cls").alias("a"), F.col("node").alias("na")), "a").join(nodes.select(F.col("cls").alias("b"), F.col("node").alias("nb")), "b").select("na", "nb")
    pairs = pairs.unionByName(border.withColumnRenamed("node", "na").join(border.withColumnRenamed("node", "nb"), "key").where("na < nb").select("na", "nb"))
    pairs = pairs.unionByName(long.join(long.groupBy("key").agg(F.min("node").alias("first")), "key").where("node <> first").select(F.col("first").alias("na"), F.col("node").alias("nb")))
    pairs = pairs.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct()
    kept = materialize(_tally(materialize(pairs, "pairs"), sigs, least).distinct(), "kept")
    links = verify(kept, texts, size, least_words, threshold)
    if not long.isEmpty():
        links = materialize(links, "links")
        if every:
            parts = long.withColumn("root", F.col("node"))
        else:
            roots = components(links, "a", "b")
            parts = long.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        more = materialize(_across(parts, sigs, least).join(kept, ["a", "b"], "left_anti"), "more")
        links = links.unionByName(verify(more, texts, size, least_words, threshold))
    links = links.select(F.expr(f"a div {n}").alias("a"), F.expr(f"b div {n}").alias("b"), "shared", "either")
    members = feats.select("id", "cls").join(classes.where("copies > 1").select("cls", "rep"), "cls").select("id", "rep")
    return links, members


def near_duplicate_pairs(df: DataFrame, id_col: str, fields: list[str], size: int = 5, least_words: int = 8, threshold: tuple[int, int] = (4, 5), keys: int = KEYS, per_key: int = PER_KEY) -> tuple[DataFrame, DataFrame]:
    """(links, members). Links: pairs (a, b) of record ids with (shared, either) word sequences, one representative for each of two classes of copies, that are alike
    in one of ``fields``. Members: (id, rep) for every text of ``least_words`` words or more that has a copy, rep being the id that stands for its
    class. Nulls, blank and short texts match nothing; rows with a null id are left out; other columns are ignored."""
    return _search(df, id_col, fields, size, least_words, threshold, keys, per_key, every=True)


def near_duplicate_groups(df: DataFrame, id_col: str, fields: list[str], size: int = 5, least_words: int = 8, threshold: tuple[int, int] = (4, 5), keys: int = KEYS, per_key: int = PER_KEY) -> DataFrame:
    """(group, id) for every record connected with another one; group is the smallest id, whose own row is included.
    Rows with a null id and texts that are null, blank or short are in no group for themselves; repeated rows are one record."""
    links, members = _search(df, id_col, fields, size, least_words, threshold, keys, per_key, every=False)
    edges = links.select("a", "b").unionByName(members.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    return components(edges, "a", "b").select(F.col("root").alias("group"), F.col("node").alias("id"))
