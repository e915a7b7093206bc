"""Signing keys: keyring, revocations, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes
from clipledger.operators.ledger import event_where, finding


def apply_revocations(keyring: DataFrame, revocations: DataFrame) -> DataFrame:
    """Later list entries override earlier ones and the keyring, nulls included; unknown keys drop out."""
    last = revocations.groupBy("kid").agg(
        F.max_by(F.struct("revoked_at", "reason"), F.col("ix")).alias("_r"), F.lit(True).alias("_listed")
    )
    joined = keyring.join(last, "kid", "left")
    listed = F.col("_listed").isNotNull()
    return joined.select(
        "kid", "public_key", "valid_from", "valid_until",
        F.when(listed, F.col("_r.revoked_at")).otherwise(F.col("revoked_at")).alias("revoked_at"),
        F.when(listed, F.col("_r.reason")).otherwise(F.col("reason")).alias("reason"),
    )


def with_keys(events: DataFrame, keyring: DataFrame) -> DataFrame:
    """Left join on kid. Keyrings are looked up by the planner's own size estimate: small ones
    broadcast, large ones shuffle and AQE splits a kid that signs a third of all events."""
    keys = keyring.select(
        F.col("kid").alias("_kid"), "valid_from", "valid_until", "revoked_at", "reason", "public_key"
    )
    return events.join(keys, events["sig.kid"] == keys["_kid"], "left").withColumn(
        "key_known", F.col("_kid").isNotNull()
    ).drop("_kid")


def window_code(ts: Column) -> Column:
    """First failing rule wins; a time equal to a bound passes; no bound, no rule."""
    return (
        F.when(ts < F.col("valid_from"), "before_valid_from")
        .when(ts > F.col("valid_until"), "after_valid_until")
        .when(ts > F.col("revoked_at"), "after_revocation")
    )


def key_state(events: DataFrame, keyring: DataFrame, recompute: bool = True) -> DataFrame:
    """One code per event: unknown key, then hash, then signature kind, then validity; null is good.

    The curve check is left to the verifier of key_findings.
    """
    joined = with_keys(events, keyring)
    code = F.when(~F.col("key_known"), "unknown_kid")
    if recompute:
        code = code.when(~F.col("hash").eqNullSafe(hashes.event_hash(F.col("raw"))), "hash_mismatch")
        code = code.when(
            ~F.col("sig.alg").eqNullSafe(F.lit(schemas.VERIFIABLE_SIGNATURE_ALG)), "unsupported_sig_alg"
        )
    return joined.withColumn("code", F.coalesce(code, window_code(F.col("ts_utc"))))


def key_findings(events: DataFrame, keyring: DataFrame, verifier=None) -> DataFrame:
    """Stage 4. verifier: optional pandas UDF (canonical text, signature, public key) -> boolean.

    Without one, events that are otherwise good are 'unverified', a warning each: the stage cannot pass.
    """
    state = key_state(events, keyring)
    if verifier is None:
        state = state.withColumn("code", F.coalesce("code", F.lit("unverified")))
    if verifier is not None:
        good = verifier(hashes.canonical_json(F.col("raw"), ("hash", "sig")), F.col("sig.value"), F.col("public_key"))
        unsigned = ~F.coalesce(good, F.lit(False))
        early = F.col("code").isin("unknown_kid", "hash_mismatch", "unsupported_sig_alg")
        state = state.withColumn(
            "code", F.when(F.coalesce(early, F.lit(False)), F.col("code"))
            .when(unsigned, "bad_signature").otherwise(F.col("code"))
        )
    detail = F.concat_ws(" ", F.lit("kid"), F.coalesce("sig.kid", F.lit("null")), F.lit("ts"), F.col("ts"))
    return state.where(F.col("code").isNotNull()).select(
        *finding("4", F.col("code"), event_where(), detail, F.when(F.col("code") == "unverified", "warning").otherwise("error"))
    )


def expiring(keyring: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Keys that end within the horizon or have ended, revoked ones left out."""
    horizon = now + F.make_interval(days=F.lit(days))
    return keyring.where(F.col("revoked_at").isNull() & F.col("valid_until").isNotNull()).where(
        F.col("valid_until") < horizon
    ).select("kid", "valid_until", F.when(F.col("valid_until") < now, "expired").otherwise("expiring").alias("state"))


def without_backend(keyring: DataFrame, backends: DataFrame) -> DataFrame:
    """Keys that no signing backend maps."""
    return keyring.join(backends.select("kid").distinct(), "kid", "left_anti")
