"""Artifacts and manifests against computed digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes, paths
from clipledger.operators.ledger import event_where, finding


def char_suffixes(text: Column) -> Column:
    """Every non-empty tail of a string."""
    n = F.length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i)))


def first_entries(manifest: DataFrame) -> DataFrame:
    """First entry per (manifest, file): entry_ix and hashes. Two aggregates, so that a caller who leaves one out does not move it."""
    return manifest.groupBy("manifest_path", "file").agg(
        F.min("entry_ix").alias("entry_ix"), F.min_by("hashes", "entry_ix").alias("hashes")
    )


def declared_by_manifest(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(sidecar_path, json_path, group_ix, artifact_ix) -> hash a listed manifest declares for it.

    An artifact is covered when its path ends with the manifestEntry of a manifest artifact in the
    same document. The ends-with test is an equi-join: tails of the file name meet the file name
    of the entry, then the whole entry is checked. First manifest, first entry, registry order.
    """
    lists = artifacts.where("kind = 'asc-mhl' and mhl_entry <> ''").select(
        "sidecar_path",
        F.col("resolved").alias("manifest_path"),
        F.col("mhl_entry").alias("file"),
        F.struct("json_path", "group_ix", "artifact_ix").alias("_list_order"),
    )
    alg, value = hashes.pick(F.col("hashes"), schemas.REGISTRY_ORDER, skip_empty=True)
    claims = (
        manifest.where(alg.isNotNull())
        .groupBy("manifest_path", "file")
        .agg(F.min_by(F.struct(alg.alias("alg"), value.alias("value")), "entry_ix").alias("_claim"))
    )
    known = lists.join(claims, ["manifest_path", "file"]).withColumn("_tail", paths.basename(F.col("file")))
    tails = artifacts.where("path <> ''").select(
        "sidecar_path", "json_path", "group_ix", "artifact_ix", "path",
        F.explode_outer(char_suffixes(paths.basename(F.col("path")))).alias("_tail"),
    )
    hits = tails.join(known, ["sidecar_path", "_tail"]).where(F.endswith("path", "file"))
    first = hits.groupBy("sidecar_path", "json_path", "group_ix", "artifact_ix").agg(
        F.min_by("_claim", "_list_order").alias("_claim")
    )
    return first.select(
        "sidecar_path", "json_path", "group_ix", "artifact_ix", F.col("_claim.alg").alias("d_alg"), F.col("_claim.value").alias("d_value")
    )


KEY = ["sidecar_path", "json_path", "group_ix", "artifact_ix"]


def trusted(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Keys of artifacts whose own (alg, value) is what a manifest already declares."""
    declared = declared_by_manifest(artifacts, manifest)
    same = (F.col("alg") == F.col("d_alg")) & (F.col("value") == F.col("d_value"))
    return artifacts.join(declared, KEY).where(same).select(*KEY)


def artifact_outcomes(
    artifacts: DataFrame,
    inventory: DataFrame,
    digests: DataFrame,
    trusted_keys: DataFrame | None = None,
    missing_is_skip: bool = False,
) -> DataFrame:
    """Adds outcome to each artifact: missing / skip_missing, malformed, unsupported, trusted,
    unreadable, mismatch or ok, in that order of precedence. Digest text compares case-sensitively."""
    here = inventory.select(F.col("path").alias("resolved")).distinct().withColumn("_here", F.lit(True))
    got = digests.select(
        F.col("path").alias("resolved"), "alg", F.col("value").alias("actual"), F.col("status").alias("_status")
    )
    base = artifacts.join(here, "resolved", "left").join(got, ["resolved", "alg"], "left")
    if trusted_keys is not None:
        base = base.join(trusted_keys.withColumn("_trusted", F.lit(True)), KEY, "left")
    else:
        base = base.withColumn("_trusted", F.lit(None).cast("boolean"))
    known = hashes.rank_of(F.col("alg"), schemas.REGISTRY_ORDER).isNotNull()
    outcome = (
        F.when(F.col("_here").isNull(), "skip_missing" if missing_is_skip else "missing")
        .when(F.col("alg").isNull() | F.col("value").isNull(), "malformed")
        .when(~known, "unsupported")
        .when(F.col("_trusted"), "trusted")
        .when(F.col("_status").isin("unsupported", "missing", "unreadable"), F.col("_status"))
        .when(F.col("actual") == F.col("value"), "ok")
        .otherwise("mismatch")
    )
    return base.withColumn("outcome", outcome).drop("_here", "_status", "_trusted")


def artifact_findings(outcomes: DataFrame) -> DataFrame:
    """Stage 6."""
    detail = F.concat_ws(
        " ", F.lit("kind"), F.col("kind"), F.lit("path"), F.col("path"), F.col("alg"), F.lit("declared"),
        F.substring("value", 1, 16), F.lit("actual"), F.coalesce(F.substring("actual", 1, 16), F.lit("none")),
    )
    return outcomes.where(F.col("outcome").isin("missing", "malformed", "unreadable", "mismatch")).select(
        *finding("6", F.col("outcome"), event_where("artifact_ix"), detail)
    )


def digest_requests(artifacts: DataFrame, inventory: DataFrame, trusted_keys: DataFrame | None = None) -> DataFrame:
    """Distinct (path, alg) whose bytes must be read: present, well formed, not already trusted.

    A file that every document lists is read once.
    """
    wanted = artifacts if trusted_keys is None else artifacts.join(trusted_keys, KEY, "left_anti")
    return (
        wanted.where(F.col("value").isNotNull() & hashes.rank_of(F.col("alg"), schemas.REGISTRY_ORDER).isNotNull())
        .select(F.col("resolved").alias("path"), "alg")
        .distinct()
        .join(inventory.select("path").distinct(), "path", "left_semi")
    )


def manifest_claims(artifacts: DataFrame, manifest: DataFrame, rejects: DataFrame, inventory: DataFrame) -> DataFrame:
    """Manifest artifacts with the entry they name, the hash it declares and the file it means.

    state: skip_no_manifest, unparseable, no_entry, no_algorithm, skip_no_camera_file or check.
    """
    lists = artifacts.where("kind = 'asc-mhl'").withColumn("manifest_path", F.col("resolved"))
    present = inventory.select(F.col("path").alias("manifest_path")).distinct().withColumn("_present", F.lit(True))
    bad = rejects.select("manifest_path").distinct().withColumn("_bad", F.lit(True))
    alg, value = hashes.pick(F.col("hashes"), schemas.REGISTRY_ORDER, skip_empty=False)
    firsts = first_entries(manifest).select(
        "manifest_path", F.col("file").alias("mhl_entry"), F.lit(True).alias("_entry"), alg.alias("m_alg"), value.alias("m_value")
    )
    joined = (
        lists.join(present, "manifest_path", "left")
        .join(bad, "manifest_path", "left")
        .join(firsts, ["manifest_path", "mhl_entry"], "left")
        .withColumn("_near", F.concat(paths.dirname(F.col("manifest_path")), F.lit("/"), F.col("mhl_entry")))
        .withColumn("_far", F.concat(F.col("base_dir"), F.lit("/"), F.col("mhl_entry")))
    )
    near = inventory.select(F.col("path").alias("_near"), F.col("path").alias("_near_hit")).distinct()
    far = inventory.select(F.col("path").alias("_far"), F.col("path").alias("_far_hit")).distinct()
    located = joined.join(near, "_near", "left").join(far, "_far", "left").withColumn(
        "camera_path", F.coalesce("_near_hit", "_far_hit")
    )
    state = (
        F.when(F.col("_present").isNull(), "skip_no_manifest")
        .when(F.col("_bad"), "unparseable")
        .when(F.col("_entry").isNull(), "no_entry")
        .when(F.col("m_alg").isNull(), "no_algorithm")
        .when(F.col("camera_path").isNull(), "skip_no_camera_file")
        .otherwise("check")
    )
    return located.withColumn("state", state).select(
        *KEY, "path", "mhl_entry", "manifest_path", "camera_path", "state",
        "m_alg", "m_value",
    )


def manifest_outcomes(claims: DataFrame, digests: DataFrame) -> DataFrame:
    """Compare each claim with the camera file's digest."""
    got = digests.select(
        F.col("path").alias("camera_path"), F.col("alg").alias("m_alg"), F.col("value").alias("actual"),
        F.col("status").alias("_status"),
    )
    outcome = (
        F.when(F.col("state") != "check", F.col("state"))
        .when(F.col("_status").eqNullSafe(F.lit("unsupported")), "skip_unsupported")
        .when(F.col("_status").isin("missing", "unreadable"), F.col("_status"))
        .when(F.col("actual") == F.col("m_value"), "ok")
        .otherwise("mismatch")
    )
    return claims.join(got, ["camera_path", "m_alg"], "left").withColumn("outcome", outcome).drop("_status", "state")


def manifest_findings(outcomes: DataFrame) -> DataFrame:
    """Stage 8."""
    detail = F.concat_ws(
        " ", F.lit("manifest"), F.col("path"), F.lit("entry"), F.coalesce("mhl_entry", F.lit("null")), F.col("m_alg"),
        F.lit("says"), F.substring("m_value", 1, 16), F.lit("actual"),
        F.coalesce(F.substring("actual", 1, 16), F.lit("none")),
    )
    return outcomes.where(F.col("outcome").isin("unparseable", "no_entry", "no_algorithm", "missing", "unreadable", "mismatch")).select(
        *finding("8", F.col("outcome"), event_where("artifact_ix"), detail)
    )
