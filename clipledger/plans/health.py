"""Data checks over a corpus, its keys and its watcher state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.operators import flatten, keys, rollup
from clipledger.session import cut_lineage


def in_use(artifacts: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct hash algorithms, distinct signing keys) the corpus refers to."""
    algs = artifacts.select("alg").where("alg is not null").distinct()
    kids = events.select(F.col("sig.kid").alias("kid")).where("kid is not null").distinct()
    return algs, kids


def unregistered(algs: DataFrame) -> DataFrame:
    """Algorithms outside the registry."""
    return algs.where(~F.col("alg").isin(schemas.REGISTRY_ORDER))


def expired_in_use(keyring: DataFrame, kids: DataFrame, now: Column) -> DataFrame:
    return keyring.join(kids.select("kid").distinct(), "kid", "left_semi").where(F.col("valid_until") < now)


def check(title: str, df: DataFrame, detail: str, status: str = "fail", remedy: str = "") -> DataFrame:
    """One row: pass when df is empty, else status with the count and the first example."""
    n = F.count(F.lit(1))
    return df.agg(
        F.lit(title).alias("title"),
        F.when(n == 0, "pass").otherwise(status).alias("status"),
        n.alias("rows"),
        F.min(F.col(detail).cast("string")).alias("example"),
    ).select("title", "status", "rows", "example", F.lit(remedy).alias("remedy"))


@dataclass
class Corpus:
    documents: DataFrame
    keyring: DataFrame
    now: Column
    backends: DataFrame | None = None
    states: DataFrame | None = None
    local_snapshot: DataFrame | None = None
    published_snapshot: DataFrame | None = None


def bad_states(states: DataFrame) -> DataFrame:
    """Watcher states without the list of processed manifests."""
    return states.where(F.col("processed_mhl_sha256").isNull()).select("state_path")


def health(c: Corpus) -> DataFrame:
    """One row per check."""
    parsed = cut_lineage(flatten.parse(c.documents))
    groups = flatten.groups(parsed)
    algs, kids = in_use(flatten.artifacts(groups), flatten.events(groups))
    outlook = keys.expiring(c.keyring, c.now)
    checks = [
        check("hash algorithms", unregistered(algs), "alg", remedy="register the algorithm"),
        check("keyring validity", expired_in_use(c.keyring, kids, c.now), "kid", remedy="rotate to a fresh key"),
        check("documents parse", flatten.corrupt(parsed, groups), "sidecar_path", remedy="repair the documents"),
        check("keys expired", outlook.where("state = 'expired'"), "kid", remedy="rotate"),
        check("keys expiring", outlook.where("state = 'expiring'"), "kid", "warn", "plan a rotation"),
        c.keyring.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit("keyring present").alias("title"),
            F.when(F.col("rows") > 0, "pass").otherwise("fail").alias("status"), "rows",
            F.lit(None).cast("string").alias("example"), F.lit("add a key").alias("remedy"),
        ),
    ]
    if c.backends is not None:
        checks.append(check("signing backends", keys.without_backend(c.keyring, c.backends), "kid", remedy="map the key"))
    if c.states is not None:
        checks.append(check("watcher state", bad_states(c.states), "state_path", remedy="reset the state"))
    if c.local_snapshot is not None and c.published_snapshot is not None:
        drift = rollup.snapshot_drift(c.local_snapshot, c.published_snapshot).where("state <> 'ok'")
        checks.append(check("schema snapshots", drift, "name", remedy="publish again"))
    first, *rest = checks
    for df in rest:
        first = first.unionByName(df)
    return first


def overall(checks: DataFrame) -> DataFrame:
    return rollup.top_status(checks.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
