"""Ordered operators that hold up when one key owns a large share of the rows.

A plain window sends a whole key to one task. Here a key's rows are first cut into segments that
follow the order (an hour of event time, a block of positions). Rows are windowed per
(key, segment); one summary row per segment then carries the state across segment borders.
The only rows a single task sees for one key are those summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEG = "_segment"


def time_segment(ts: Column, seconds: int = 3600) -> Column:
    """Order-preserving segment of a timestamp."""
    return F.coalesce(F.floor(F.unix_seconds(ts) / F.lit(seconds)), F.lit(-1).cast("bigint"))


def block_segment(position: Column, size: int = 100_000) -> Column:
    """Order-preserving segment of an integer position."""
    return F.floor(position / F.lit(size))


def _order_key(order: list[str]) -> Column:
    return F.struct(*order)


def _cut(df: DataFrame, segment: Column) -> DataFrame:
    return df.withColumn(SEG, segment)


def _before(keys: list[str]):
    """All earlier segments of the same key."""
    return Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(df: DataFrame, keys: list[str], segment: Column, order: list[str], out: str = "seq") -> DataFrame:
    """row_number() per key in the given order, 1-based."""
    cut = _cut(df, segment)
    local = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, SEG).orderBy(*order)))
    sizes = cut.groupBy(*keys, SEG).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*keys, SEG, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_start"))
    joined = local.join(starts, [*keys, SEG])
    return joined.withColumn(out, (F.col("_rn") + F.col("_start")).cast("bigint")).drop(SEG, "_rn", "_start")


def previous_row(
    df: DataFrame, keys: list[str], segment: Column, order: list[str], cols: list[str], out: str = "prev"
) -> DataFrame:
    """lag(struct(cols)) per key in the given order; null on the first row of a key."""
    cut = _cut(df, segment)
    w = Window.partitionBy(*keys, SEG).orderBy(*order)
    local = cut.withColumn("_rn", F.row_number().over(w)).withColumn(out, F.lag(F.struct(*cols)).over(w))
    tails = cut.groupBy(*keys, SEG).agg(F.max_by(F.struct(*cols), _order_key(order)).alias("_tail"))
    carry = tails.select(
        *keys, SEG, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(SEG)).alias("_carry")
    )
    joined = local.join(carry, [*keys, SEG])
    return joined.withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col(out))).drop(
        SEG, "_rn", "_carry"
    )


def running_last(
    df: DataFrame, keys: list[str], segment: Column, order: list[str], value: Column, out: str
) -> DataFrame:
    """last(value, ignoreNulls) from the start of a key up to each row."""
    cut = _cut(df, segment).withColumn("_v", value)
    w = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn(out, F.last("_v", ignorenulls=True).over(w))
    tails = cut.groupBy(*keys, SEG).agg(
        F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), _order_key(order))).alias("_tail")
    )
    carry = tails.select(*keys, SEG, F.last("_tail", ignorenulls=True).over(_before(keys)).alias("_carry"))
    joined = local.join(carry, [*keys, SEG])
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_carry"))).drop(SEG, "_v", "_carry")
