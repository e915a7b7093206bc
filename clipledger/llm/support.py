"""Shared pieces: reading tables, cutting lineage, connected components, vectorised text hashes."""

from __future__ import annotations

import gc
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.session import checkpoint_dir, cut_lineage

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_B = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def written(df: DataFrame) -> DataFrame:
    """The frame as a compressed table in the shared folder: a checkpoint for wide rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose frames are gone; else they stay until the driver happens to collect
    its garbage, and add up over the steps of a long job."""
    for _ in range(3):  # the first pass drops the frames, the others what only they held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a narrow, already materialised frame for broadcast when its row count is within the bound."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id on a link; component is the smallest id reachable.

    Large-star / small-star rounds: each id is hung on the smallest id it sees until the links are
    stars. Minima are combined before they move, so a hub costs a row per task; the joins back on the hub can
    be split by AQE. A round's only row on the driver is a fingerprint of the links.
    """
    edge = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edge, mark = stage(edge), None
    while True:
        seen = edge.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return edge.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edge.select(F.col("v").alias("id"), F.col("v").alias("component"))
            ).groupBy("id").agg(F.min("component").alias("component"))
        mark = seen
        both = edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edge = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct())


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any slice of a byte array from prefix sums of a polynomial modulo 2^64."""

    _powers = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    @classmethod
    def _grow(cls, n: int) -> None:
        if len(cls._powers) < n:
            n = max(n, 2 * len(cls._powers))
            for name, base in (("_powers", _B), ("_inverse", _B_INV)):
                steps = np.full(n, base)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))

    def __init__(self, data: np.ndarray) -> None:
        self._grow(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each slice data[start:end]; equal slices of equal length have equal hashes."""
        return mix((self.sums[end] - self.sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Hash of the k bytes at each position."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self._inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


#: Byte values that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
