"""Lock records against the lock events that should stand behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.operators.ledger import event_where, finding


def pair_locks(locks: DataFrame, events: DataFrame, keys: list[str], event_order) -> DataFrame:
    """Each lock with its first lock event on (target, by = actor.id, at = ts), times as text.

    Events are first reduced to one row per match key, so a target locked over and over never
    multiplies rows. Adds code: null, no_match or kid_mismatch.
    """
    first = (
        events.where("action = 'lock'")
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("target").alias("_t"),
                 F.col("actor.id").alias("_by"), F.col("ts").alias("_at"))
        .agg(F.min_by(F.struct(F.col("sig.kid").alias("kid")), event_order).alias("_event"))
    )
    cond = (
        F.col("target").eqNullSafe(F.col("_t"))
        & F.col("by").eqNullSafe(F.col("_by"))
        & F.col("at").eqNullSafe(F.col("_at"))
    )
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    code = F.when(F.col("_event").isNull(), "no_match").when(
        ~F.col("sig.kid").eqNullSafe(F.col("_event.kid")), "kid_mismatch"
    )
    return locks.join(first, cond, "left").withColumn("code", code).withColumn(
        "event_kid", F.col("_event.kid")
    ).drop("_event", "_t", "_by", "_at", *[f"_{k}" for k in keys])


def lock_findings(locks: DataFrame, events: DataFrame, event_order) -> DataFrame:
    """Stage 5."""
    paired = pair_locks(locks, events, ["sidecar_path"], event_order)
    detail = F.concat_ws(
        " ", F.lit("target"), F.col("target"), F.lit("by"), F.col("by"), F.lit("at"), F.col("at"),
        F.lit("kid"), F.col("sig.kid"), F.lit("event kid"), F.coalesce("event_kid", F.lit("none")),
    )
    return paired.where(F.col("code").isNotNull()).select(*finding("5", F.col("code"), event_where("lock_ix"), detail))
