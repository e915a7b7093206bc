"""Near-duplicates by Order MinHash.

A document is the sequence of its five-word shingles, each labelled with its occurrence number. Each of
SKETCHES sketches takes the PICKS labelled shingles with the smallest keyed hashes and hashes them in text order, so two
documents agree on a sketch only if they share those shingles in the same order. Documents that agree on two sketches
or more are candidates (a pair of similarity 0.8 is missed once in 75 000: 20 sketches, 0.8^3 each); a candidate pair is a
link if a banded alignment of the two shingle sequences, or else their sets, are similar to SIMILARITY or more.

Only what links connect is asked for, so each document first meets leaders of its buckets, and then every candidate
that the links found so far leave in another component. In large buckets these are compared in blocks that hold their texts, so
a text moves once per block and no pair does; elsewhere pairs are fetched, but not candidates too unlike in length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.llm.support import Rolling, components, mix, release, stage, word_bounds

SHINGLE, SIMILARITY = 5, 0.8
SKETCHES, PICKS, AGREE = 20, 3, 2
#: Buckets up to this size are compared in one row, larger ones in pairs of blocks of BLOCK members; the rule is the same.
SMALL_BUCKET, BLOCK = 16, 2048
#: Shingles a block holds, about, and names that one matrix product counts.
HELD, COLUMNS = 1 << 20, 1024
#: Leaders a document meets first.
LEADERS = 2

_SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words; of the whole text if it has fewer words; none without words."""
    data = np.frombuffer(text, np.uint8)
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    words = Rolling(data).of(start, end)
    width = min(size, len(words))
    out = words[: len(words) - width + 1]
    for i in range(1, width):
        out = mix(out * _STEP + words[i : len(words) - width + 1 + i])
    return out


def labelled(seq: np.ndarray) -> np.ndarray:
    """Each hash combined with how often it has occurred before."""
    order = np.argsort(seq, kind="stable")
    ordered = seq[order]
    place = np.arange(len(seq))
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    since = place - np.maximum.accumulate(np.where(fresh, place, 0))
    out = np.empty_like(seq)
    out[order] = mix(ordered + since.astype(np.uint64) * _STEP)
    return out


def sketch(labels: np.ndarray) -> np.ndarray:
    """One key per sketch; a sequence shorter than PICKS gives keys of all it has."""
    n = len(labels)
    if not n:
        return np.zeros(0, np.int64)
    if n > PICKS:
        keyed = mix(labels[None, :] ^ _SEEDS[:, None])
        picked = np.sort(np.argpartition(keyed, PICKS - 1, axis=1)[:, :PICKS], axis=1)
        chosen = labels[picked]
    else:
        chosen = np.broadcast_to(labels, (SKETCHES, n))
    key = _SEEDS.copy()
    for i in range(chosen.shape[1]):
        key = mix(key * _STEP + chosen[:, i])
    return key.view(np.int64)


def _sketched(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            raw = (text or "").encode()
            seq = shingles(raw)
            same = hashlib.md5(b" ".join(raw.split())).digest()
            rows.append((doc_id, same, len(seq), len(np.unique(seq)), sketch(labelled(seq)) if len(seq) else []))
        yield pd.DataFrame(rows, columns=["doc_id", "same", "n", "u", "keys"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, same (md5 of the words), n (shingles), u (distinct ones), keys. No text leaves the task."""
    return docs.select("doc_id", "text").mapInPandas(_sketched, "doc_id bigint, same binary, n int, u int, keys array<bigint>")


def banded_lcs(a: list[int], b: list[int], band: int) -> int:
    """Length of the longest common subsequence with matches at most `band` places off the diagonal.

    Bit-parallel: one integer holds a row of the alignment, a match outside the band is masked out."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for j, y in enumerate(b):
        hits = where.get(y, 0)
        if hits:
            low = max(0, j - band)
            hits = (hits >> low << low) & ((1 << (j + band + 1)) - 1)
            step = row & hits
            row = ((row + step) | (row - step)) & full
    return first + last + len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared shingles over all shingles: in order by banded alignment, or as sets where that is more.

    The band is as wide as an alignment of similarity `least` can stray from the diagonal; below it 0 may be given."""
    if not len(a) or not len(b):
        return 0.0
    band = int((1 - least) / (1 + least) * (len(a) + len(b))) + 1
    aligned = 0.0
    if abs(len(a) - len(b)) <= band:
        common = banded_lcs(a.tolist(), b.tolist(), band)
        aligned = common / (len(a) + len(b) - common)
    if aligned >= least:
        return aligned
    x, y = np.unique(a), np.unique(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return max(aligned, both / (len(x) + len(y) - both))


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        alike = [
            similarity(shingles((x or "").encode()), shingles((y or "").encode()))
            for x, y in zip(frame["text_a"], frame["text_b"])
        ]
        yield frame[["a", "b"]].assign(similarity=alike)


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) with their similarity. Texts are shuffled once by document, then once by pair."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.select("doc_id", "text").join(sides, "doc_id").groupBy("a", "b").agg(
        F.max(F.when(F.col("doc_id") == F.col("a"), F.col("text"))).alias("text_a"),
        F.max(F.when(F.col("doc_id") == F.col("b"), F.col("text"))).alias("text_b"),
    )
    return texts.mapInPandas(_verified, "a bigint, b bigint, similarity double")


def _fits(x: Column, y: Column) -> Column:
    """Whether lengths alone let two members be a link: similarity is at most the smaller over the larger count."""
    ratio = lambda k: F.least(x[k], y[k]) / F.greatest(x[k], y[k])
    return (ratio("n") >= SIMILARITY) | (ratio("u") >= SIMILARITY)


def _agreement(x: Column, y: Column) -> Column:
    """On how many sketches two members agree."""
    return F.size(F.filter(F.zip_with(x["keys"], y["keys"], lambda a, b: a == b), lambda z: z))


def _agree(x: Column, y: Column) -> Column:
    """Whether two members agree on enough sketches."""
    return _agreement(x, y) >= AGREE


def _named(pairs: DataFrame) -> DataFrame:
    """(a, b), a < b, once each."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _with_leaders(buckets: DataFrame) -> DataFrame:
    """Pairs from buckets (key, m, g): each member with the LEADERS leaders of its buckets that it agrees with most.

    Small buckets have one leader, large ones two. What this leaves apart is compared afterwards, so nothing is lost here."""
    small = buckets.where(F.col("g") <= SMALL_BUCKET).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct(F.xxhash64("m.doc_id").alias("h"), "m.*"))).alias("all")
    ).withColumn("l", F.col("all")[0])
    close = small.select("l", F.explode(F.filter("all", lambda y: _fits(F.col("l"), y))).alias("m"))
    large = buckets.where(F.col("g") > SMALL_BUCKET)
    leaders = large.groupBy("key").agg(
        F.min_by("m", F.struct(F.xxhash64("m.doc_id"), "m.doc_id")).alias("l1"),
        F.min_by("m", F.struct(F.xxhash64("m.doc_id", "key"), "m.doc_id")).alias("l2"),
    ).select("key", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("l"))
    far = large.join(leaders, "key").where(_fits(F.col("m"), F.col("l")))
    both = [df.select(
        F.col("l.doc_id").alias("a"), F.col("m.doc_id").alias("b"), _agreement(F.col("m"), F.col("l")).alias("agree")
    ).where((F.col("a") != F.col("b")) & (F.col("agree") >= AGREE)) for df in (close, far)]
    best = both[0].union(both[1]).groupBy("b").agg(
        F.slice(F.sort_array(F.collect_set(F.struct("agree", "a")), asc=False), 1, LEADERS).alias("best")
    )
    return _named(best.select("b", F.explode("best.a").alias("a")))


def common_counts(name: np.ndarray, member: np.ndarray, n: int) -> np.ndarray:
    """How many names each two of n members share, from rows (name, member) without repeats.

    Frequent names are counted by matrix products, the others along their few members."""
    order = np.argsort(name, kind="stable")
    name, member = name[order], member[order]
    starts = np.flatnonzero(np.r_[True, name[1:] != name[:-1]][: len(name)])
    sizes = np.diff(np.r_[starts, len(name)])
    rank, size = np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
    out = np.zeros((n, n), np.float32)
    often = size > max(2, n // 32)
    cols, rows = np.unique(rank[often], return_inverse=True)[1], member[often]
    for low in range(0, cols.max(initial=-1) + 1, COLUMNS):
        here = (cols >= low) & (cols < low + COLUMNS)
        held = np.zeros((n, COLUMNS), np.float32)
        held[rows[here], cols[here] - low] = 1
        out += held @ held.T
    few = ~often & (size > 1)
    rank, member = rank[few], member[few]
    for step in range(1, max(2, n // 32)):
        same = rank[step:] == rank[:-step]
        if not same.any():
            break
        x, y = member[:-step][same], member[step:][same]
        np.add.at(out, (x, y), 1)
        np.add.at(out, (y, x), 1)
    return out


def block_links(block: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between different components in a pair of blocks of one bucket (key, lo, hi, side, doc_id, c, keys, text).

    A pair is judged in the bucket of its first common key. Only links that join something new are given: the others would
    connect what these connect already. Counts of shared shingles decide most pairs, the alignment the rest."""
    block = block.assign(seq=[shingles(t.encode()) for t in block.pop("text")])
    block = block[block["seq"].map(len) > 0]
    if not len(block):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    key, n = block["key"].iloc[0], len(block)
    ids, side, seqs = block["doc_id"].to_numpy(), block["side"].to_numpy(), block["seq"].to_list()
    across = block["lo"].iloc[0] != block["hi"].iloc[0]
    part = np.unique(block["c"].to_numpy(), return_inverse=True)[1]
    most = part == np.bincount(part).argmax()
    keys = np.stack(block["keys"].to_list())
    alike = [labelled(s) for s in seqs]
    firsts = [mix(np.unique(s)) for s in seqs]
    length, distinct = np.array([len(s) for s in seqs]), np.array([len(s) for s in firsts])
    member = np.arange(n)
    both = common_counts(np.concatenate(firsts), np.repeat(member, distinct), n)
    again = [x[~np.isin(x, y, assume_unique=True)] if len(x) > len(y) else x[:0] for x, y in zip(alike, firsts)]
    common = both + common_counts(np.concatenate(again), np.repeat(member, length - distinct), n) if any(map(len, again)) else both
    parent = list(range(part.max() + 1))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    found = []
    for x in np.flatnonzero(~most):  # of two components one is not the largest
        # The alignment is of shingles in order, so it is no longer than their common number.
        sets = both[x] / (distinct + distinct[x] - both[x])
        bound = common[x] / (length + length[x] - common[x])
        ok = (np.maximum(sets, bound) >= SIMILARITY - 1e-5) & (part != part[x]) & (most | (member > x))
        if across:
            ok &= side != side[x]
        near = np.flatnonzero(ok)
        same = keys[near] == keys[x]
        near = near[(same.sum(1) >= AGREE) & (keys[x][same.argmax(1)] == key)]
        for y in near[np.argsort(-sets[near], kind="stable")]:
            p, q = root(part[x]), root(part[y])
            if p != q and (sets[y] >= SIMILARITY + 1e-5 or similarity(seqs[x], seqs[y]) >= SIMILARITY):
                found.append((ids[x], ids[y]))
                parent[p] = q
    return pd.DataFrame(found, columns=["a", "b"]).astype("int64")


def _still_apart(buckets: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between candidates of different components: by pair in small buckets, in pairs of blocks of large ones.

    A block gets each of its texts once, however many pairs it is in, and gives fewer links than it has members."""
    placed = buckets.join(found.withColumnRenamed("id", "m_id"), F.col("m.doc_id") == F.col("m_id"), "left").select(
        "key", "m", "g", F.coalesce("component", "m.doc_id").alias("c")
    )
    small = placed.where(F.col("g") <= SMALL_BUCKET).groupBy("key").agg(F.collect_list(F.struct("c", "m.*")).alias("all")).where(
        F.array_min(F.col("all.c")) < F.array_max(F.col("all.c"))
    )
    close = small.select("all", F.explode("all").alias("x")).select("x", F.explode(F.filter("all", lambda y: (
        (y["doc_id"] > F.col("x.doc_id")) & (y["c"] != F.col("x.c")) & _fits(F.col("x"), y) & _agree(F.col("x"), y)
    ))).alias("y")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    close = stage(_named(close))
    large = placed.where(F.col("g") > SMALL_BUCKET)
    mixed = large.groupBy("key").agg(
        F.min("c").alias("c1"), F.max("c").alias("c2"), F.greatest(F.ceil(F.max("g") / BLOCK), F.ceil(F.sum("m.n") / HELD)).alias("cut")
    ).where("c1 < c2").select("key", "cut")
    large = stage(large.join(mixed, "key").select("key", "c", "cut", "m.doc_id", "m.keys"))
    texts = docs.select("doc_id", "text").join(large.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(
        F.max("text").alias("text")
    )
    sided = large.withColumn("side", F.pmod(F.xxhash64("doc_id"), "cut")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1))
    )
    far = sided.join(texts, "doc_id").select(
        "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "doc_id", "c", "keys", "text"
    ).groupBy("key", "lo", "hi").applyInPandas(block_links, "a bigint, b bigint")
    if not close.isEmpty():
        far = far.union(verify(close, docs).where(F.col("similarity") >= SIMILARITY).select("a", "b"))
    return _named(far)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, copy_of, kept) for every row of documents (doc_id, text).

    copy_of is the smallest doc_id with the same words, class_id the smallest doc_id reachable by links, kept says
    doc_id = class_id. Null, empty and white-space texts have no words: each is a class of its own, as is a row with null
    doc_id (class null, kept). Rows that share a doc_id are one document. Texts of fewer than five words have one shingle."""
    all_rows = stage(sketches(docs))
    named = all_rows.where("doc_id is not null and n > 0")
    reps = stage(named.groupBy("same").agg(
        F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "u", "keys"))
    ))
    # Key arrays join the few rows that share a bucket, not all rows of all keys.
    keyed = reps.select("doc_id", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("g")).where("g > 1")
    buckets = stage(keyed.join(sizes, "key").join(reps, "doc_id").select("key", "g", F.struct("doc_id", "n", "u", "keys").alias("m")))
    release(docs.sparkSession)
    candidates = stage(_with_leaders(buckets))
    links = stage(verify(candidates, docs).where(F.col("similarity") >= SIMILARITY))
    release(docs.sparkSession)
    found = stage(components(links))
    more = stage(_still_apart(buckets, found, docs))
    if not more.isEmpty():
        found = stage(components(links.select("a", "b").union(more)))
    classes = reps.select("same", F.col("doc_id").alias("copy_of")).join(
        found.withColumnRenamed("id", "copy_of"), "copy_of", "left"
    ).select("same", "copy_of", F.coalesce("component", "copy_of").alias("class_id"))
    out = all_rows.select("doc_id", F.when(F.col("n") > 0, F.col("same")).alias("same")).join(classes, "same", "left")
    out = out.select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_of", "doc_id")).alias("copy_of"),
    )
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the smallest doc_id, with its own columns; of rows that share its doc_id one stays.
    Rows with null doc_id stay."""
    kept = stage(near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id")).distinct())
    release(docs.sparkSession)
    named = docs.join(kept, docs["doc_id"] == kept["_kept_id"]).drop("_kept_id").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
