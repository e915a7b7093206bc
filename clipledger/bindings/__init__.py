"""Operators bound to the driver tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL where a query has one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times are read and shown in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry() -> Registry:
    from clipledger.bindings import keys, ledger, manifests, media, names, paths, shelves, stream

    out = Registry()
    for module in (ledger, keys, paths, manifests, media, names, shelves, stream):
        out.queries.update(module.R.queries)
        out.sql.update(module.R.sql)
    return out
