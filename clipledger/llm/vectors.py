"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one for each half of the vectors, span a grid of cells; each unit vector is filed under its nearest
codeword of either half. A query walks the cells by rising distance (multi-sequence order over the two sorted lists) and
stops when no later cell can hold a partner: a vector of cell (i, j) lies on its side of the planes between codeword i
(or j) and any other, so the query is at least the larger of its distances to those planes away from it, in either
half. Cells with m_i^2 + m_j^2 <= 2 - 2 x threshold are visited, which makes the target recall 1. Each pair is sought from
the smaller cell only. Visitors and members meet in blocks; a block emits counts and a spanning forest of its links, not
the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipledger.llm.support import components, stage

COSINE = 0.98
#: Rows the codebooks are fitted on (in order of a hash), codewords per half up to a million vectors, rounds of k-means.
SAMPLE, CODEWORDS, ROUNDS = 20_000, 16, 12
BLOCK, CHUNK = 512, 1024


def codebooks(sample: np.ndarray, words: int) -> list[np.ndarray]:
    """One codebook per half by k-means; starts from evenly spaced rows, so reruns agree."""
    out, cut = [], sample.shape[1] // 2
    for half in (sample[:, :cut], sample[:, cut:]):
        k = min(words, len(half))
        book = half[np.linspace(0, len(half) - 1, k).astype(int)].copy()
        for _ in range(ROUNDS):
            near = ((half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1)).argmin(1)
            for i in range(k):
                if (near == i).any():
                    book[i] = half[near == i].mean(0)
        out.append(np.unique(book, axis=0))
    return out


def margins(half: np.ndarray, book: np.ndarray) -> np.ndarray:
    """For each row and codeword: how far the row is, at least, from the codeword's cell (0 for the nearest)."""
    d = (half**2).sum(1)[:, None] - 2 * half @ book.T + (book**2).sum(1)
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2))
    np.fill_diagonal(apart, np.inf)
    out = np.zeros_like(d)
    for k in range(len(book)):
        np.maximum(out, (d - d[:, k : k + 1]) / (2 * apart[:, k]), out=out)
    return out


def walk(first: np.ndarray, second: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Cells of the grid by rising first[i]^2 + second[j]^2, up to `most`: multi-sequence traversal of one query."""
    import heapq

    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    x, y = first[a] ** 2, second[b] ** 2
    heap, seen = [(x[0] + y[0], 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > most:
            return
        yield int(a[i]), int(b[j])
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(x) and n[1] < len(y) and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (x[n[0]] + y[n[1]], *n))


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _forest(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[int, int]]:
    """(id, smallest id of its component) for what is linked in a block."""
    low_r = np.where(linked.any(1), rows, np.iinfo(np.int64).max)
    low_c = np.where(linked.any(0), cols, np.iinfo(np.int64).max)
    while True:
        r = np.minimum(low_r, np.where(linked, low_c[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        c = np.minimum(low_c, np.where(linked, r[:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
        if (r == low_r).all() and (c == low_c).all():
            break
        low_r, low_c = r, c
    for ids, low in ((rows, low_r), (cols, low_c)):
        on = (low < np.iinfo(np.int64).max) & (low != ids)
        yield from zip(ids[on].tolist(), low[on].tolist())


def _met(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Blocks in order, members before visitors: (a, b, n): n links of a (b null), or an edge of the forest (n 0)."""
    key, ids, sizes, unit = None, None, None, None
    for frame in frames:
        out: list[tuple] = []
        for k, part in frame.groupby(["dims", "label", "cell", "block"], sort=False):
            members, visitors = part[part["role"] == 0], part[part["role"] == 1]
            if k != key:
                key, ids, sizes, unit = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, int(k[0])))
            for own, inside in ((members, True), (visitors, False)):
                for at in range(0, len(own), CHUNK):
                    piece = own.iloc[at : at + CHUNK]
                    new, n, m = piece["vec_id"].to_numpy(np.int64), piece["copies"].to_numpy(np.int64), _unit(piece["embedding"])
                    pairs = [(m @ unit.T, ids, sizes, False)] if len(ids) else []
                    if inside:
                        pairs.append((m @ m.T, new, n, True))
                    for cos, others, weights, self_pairs in pairs:
                        linked = cos >= COSINE
                        if self_pairs:
                            linked = np.triu(linked, 1)
                        if not linked.any():
                            continue
                        for who, count in ((new, linked @ weights), (others, n @ linked)):
                            out += [(i, None, c) for i, c in zip(who.tolist(), count.tolist()) if c]
                        out += [(i, low, 0) for i, low in _forest(linked, new, others)]
                    if inside:
                        ids, sizes, unit = np.r_[ids, new], np.r_[sizes, n], np.r_[unit, m]
        yield pd.DataFrame({"a": pd.array([x[0] for x in out], "Int64"), "b": pd.array([x[1] for x in out], "Int64"), "n": pd.array([x[2] for x in out], "Int64")})


def near_vectors(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label).

    Rows link only within a label; rows with null label or id, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing and stand alone. Vectors of unlike length don't link. Equal vectors of a label are
    one row with a count until the end. Rows that repeat in all three columns are one vector."""
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = table.select("vec_id", "label", "embedding").where(F.coalesce(usable, F.lit(False))).distinct()
    reps = stage(rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("dims", F.size("embedding")))
    n, dims = reps.agg(F.count("*"), F.max("dims")).first()
    singles = table.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return singles
    books = {}
    for d in [r[0] for r in reps.select("dims").distinct().collect()]:
        sample = reps.where(F.col("dims") == d).orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toPandas()
        books[d] = codebooks(_unit(sample["embedding"]), max(CODEWORDS, int(CODEWORDS * (n / 1e6) ** 0.25)))
    reach = 2 - 2 * cosine + 1e-9

    def filed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each vector with its own cell and the later cells it visits."""
        for frame in frames:
            for d, part in frame.groupby("dims"):
                first, second = books[d]
                unit = _unit(part["embedding"])
                cut = unit.shape[1] // 2
                a, b = margins(unit[:, :cut], first), margins(unit[:, cut:], second)
                own = a.argmin(1) * len(second) + b.argmin(1)
                cells = [[i * len(second) + j for i, j in walk(x, y, reach)] for x, y in zip(a, b)]
                yield part.assign(cell=own.astype(np.int32), visits=[np.array([c for c in seen if c > o], np.int32) for seen, o in zip(cells, own)])

    kept_cols = "label int, embedding array<float>, vec_id bigint, copies bigint, dims int"
    rows_of = reps.select(F.col("label").cast("int"), F.col("embedding").cast("array<float>"), "vec_id", "copies", "dims")
    rows_of = rows_of.mapInPandas(filed, f"{kept_cols}, cell int, visits array<int>")
    rows_of = stage(rows_of)
    sizes = rows_of.groupBy("dims", "label", "cell").agg(F.count("*").alias("g")).select(
        "dims", "label", "cell", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks")
    )
    base = ["label", "embedding", "vec_id", "copies", "dims", "cell"]
    home = rows_of.join(sizes, ["dims", "label", "cell"]).withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    members = home.select(*base, F.col("own").alias("block"), F.lit(0).alias("role"))
    across = home.where("own + 1 < blocks").select(*base, F.explode(F.sequence(F.col("own") + 1, F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"))
    calls = rows_of.select("label", "embedding", "vec_id", "copies", "dims", F.explode("visits").alias("cell")).join(sizes, ["dims", "label", "cell"])
    visitors = calls.select(*base, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"))
    block = ["dims", "label", "cell", "block"]
    met = members.unionByName(across).unionByName(visitors).repartition(*block).sortWithinPartitions(*block, "role")
    found = stage(met.mapInPandas(_met, "a bigint, b bigint, n bigint"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("found"))
    groups = components(found.where("b is not null"))
    by_rep = reps.join(counts, reps["vec_id"] == counts["a"], "left").join(groups, reps["vec_id"] == groups["id"], "left").select(
        "label", "embedding", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    linked = rows.join(by_rep, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(singles.join(rows.select("vec_id").distinct(), "vec_id", "left_anti"))
