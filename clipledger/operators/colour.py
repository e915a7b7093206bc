"""Colour decisions: equality within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger.operators.ledger import finding

TOLERANCE = 1e-5  # fixed value
CELL = 1e-3


def vector(slope: Column, offset: Column, power: Column, saturation: Column) -> Column:
    """Ten numbers in one array."""
    return F.concat(slope, offset, power, F.array(saturation))


def near(a: Column, b: Column, tol: float = TOLERANCE) -> Column:
    """Every component within the tolerance."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(tol)), lambda ok: F.coalesce(ok, F.lit(False)))


def _cells(v: Column, dims: int, reach: float) -> Column:
    """Grid cells of the first dims components that lie within reach."""

    def span(i: int) -> Column:
        x = F.element_at(v, i + 1)
        return F.array_distinct(
            F.array(F.floor((x - F.lit(reach)) / F.lit(CELL)), F.floor((x + F.lit(reach)) / F.lit(CELL)))
        )

    out = F.transform(span(0), lambda c: F.array(c))
    for i in range(1, dims):
        nxt = span(i)
        out = F.flatten(
            F.transform(out, lambda head: F.transform(nxt, lambda c: F.array_append(head, c)))
        )
    return out


def near_classes(left: DataFrame, right: DataFrame, keys: list[str], tol: float = TOLERANCE, dims: int = 3) -> DataFrame:
    """Pairs of distinct vectors (lv, rv) within tol under the same keys.

    Copies collapse to one class before the join and candidates meet only in a shared grid cell,
    so a group where a third of all rows are equal gives one pair, not a square of rows.
    """
    l = left.select(*keys, F.col("v").alias("lv")).distinct()
    r = right.select(*keys, F.col("v").alias("rv")).distinct()
    lc = l.withColumn("_cell", F.explode_outer(_cells(F.col("lv"), dims, 2 * tol)))
    rc = r.withColumn("_cell", _cells(F.col("rv"), dims, 0.0)[0])
    return lc.join(rc, [*keys, "_cell"]).where(near(F.col("lv"), F.col("rv"), tol)).select(*keys, "lv", "rv").distinct()


def agreement(cdls: DataFrame, looks: DataFrame, keys: list[str], tol: float = TOLERANCE) -> DataFrame:
    """Per CDL: how many of its document's AMF files with looks agree (any look equal), and how many do not.

    cdls: keys, path, v; looks: keys, path, v (one row per look).
    """
    pairs = near_classes(cdls, looks, keys, tol)
    members = looks.select(*keys, F.col("v").alias("rv"), F.col("path").alias("amf")).distinct()
    agreed = (
        pairs.join(members, [*keys, "rv"])
        .select(*keys, "lv", "amf")
        .distinct()
        .groupBy(*keys, "lv")
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    amfs = looks.select(*keys, "path").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"))
    each = cdls.join(amfs, keys).join(agreed.withColumnRenamed("lv", "v"), [*keys, "v"], "left")
    matches = F.coalesce("matches", F.lit(0)).cast("bigint")
    return each.select(*keys, "path", "pairs", matches.alias("matches"), (F.col("pairs") - matches).alias("warnings"))


def pair_statistics(agreements: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs, matches and warnings per document."""
    return agreements.groupBy(*keys).agg(
        F.sum("pairs").alias("pairs"), F.sum("matches").alias("matches"), F.sum("warnings").alias("warnings")
    )


def colour_findings(agreements: DataFrame, parse_errors: DataFrame) -> DataFrame:
    """Stage 9, warnings only: one row per CDL, n = AMF files that disagree with it."""
    detail = F.concat_ws(
        " ", F.col("path"), F.lit("agrees with"), F.col("matches").cast("string"), F.lit("of"),
        F.col("pairs").cast("string"),
    )
    off = agreements.where("warnings > 0").select(
        *finding("9", F.lit("colour_mismatch"), F.col("path"), detail, "warning", F.col("warnings"))
    )
    bad = parse_errors.select(
        *finding("9", F.lit("colour_unparseable"), F.col("path"), F.col("path"), "warning", F.col("n"))
    )
    return off.unionByName(bad)
