"""New documents from manifests (no clip bytes read) or from re-hashed media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes, paths
from clipledger.operators import ingest as ops


def _side_files(clips: DataFrame, aux: DataFrame | None) -> DataFrame:
    """AMF and CDL by stem, the framing file by show (column show where both sides have one)."""
    if aux is None:
        return clips
    shaped = clips.withColumn("stem", paths.stem(F.col("clip_path")))
    for ext in ("amf", "cdl"):
        shaped = ops.attach_by_stem(shaped, aux, ext, f"{ext}_path")
    framing = aux.where(paths.extension(F.col("path")) == "fdl")
    if "show" in clips.columns and "show" in aux.columns:
        return ops.attach_show_file(shaped, framing, "show", "fdl_path").drop("stem")
    return ops.attach_only_file(shaped, framing, "fdl_path").drop("stem")


def _with_sha(clips: DataFrame, digests: DataFrame, name: str) -> DataFrame:
    sha = digests.where("alg = 'sha256'").select(F.col("path").alias(f"{name}_path"), F.col("value").alias(f"{name}_sha256"))
    return clips.join(sha, f"{name}_path", "left")


def _describe_side_files(clips: DataFrame, names: list[str]) -> DataFrame:
    """Hash each distinct side file once; a framing file of a whole show is one read."""
    asked = None
    for name in names:
        one = clips.where(F.col(f"{name}_path").isNotNull()).select(
            F.col(f"{name}_path").alias("path"), F.lit("sha256").alias("alg")
        )
        asked = one if asked is None else asked.unionByName(one)
    digests = hashes.file_digests(asked)
    for name in names:
        clips = _with_sha(clips, digests, name)
    return clips


def from_manifests(
    manifest: DataFrame, inventory: DataFrame, ts: Column, aux: DataFrame | None = None,
    who: ops.Identity = ops.Identity(), kid: str | None = None, signer=None, base_dir: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, entry outcomes). Hashes come from the manifest."""
    outcomes = ops.entry_outcomes(manifest, inventory)
    clips = ops.usable(outcomes)
    if aux is not None:
        clips = _describe_side_files(_side_files(clips, aux), ["amf", "cdl", "fdl"])
    return ops.build_documents(clips, ts, who, kid, signer, base_dir), outcomes


def from_media(
    inventory: DataFrame, manifest_files: DataFrame, alg: str, ts: Column, aux: DataFrame | None = None,
    who: ops.Identity = ops.Identity(reason="clip bytes re-hashed"), kid: str | None = None, signer=None, base_dir: str | None = None,
) -> DataFrame:
    """Documents for clips below a manifest folder, clip bytes hashed with alg."""
    media = inventory.where(paths.is_clip(F.col("path"), schemas.REHASH_CLIP_EXTS))
    placed = ops.nearest_manifest(media, manifest_files.select("manifest_path", "manifest_sha256"))
    placed = placed.join(manifest_files.select("manifest_path", "manifest_sha256"), "manifest_path", "left")
    digests = hashes.file_digests(placed.select("path", F.lit(alg).alias("alg")))
    entry = F.substr("path", F.length("roll_dir") + 2)
    clips = placed.withColumn("file", entry).join(digests.where("status = 'ok'"), "path").withColumnRenamed("path", "clip_path")
    if aux is not None:
        clips = _describe_side_files(_side_files(clips, aux), ["amf", "cdl", "fdl"])
    return ops.build_documents(clips, ts, who, kid, signer, base_dir)


def one_clip(
    inventory: DataFrame, clip: str, alg: str, ts: Column, who: ops.Identity, kid: str | None = None, signer=None, base_dir: str | None = None,
    side_files: dict[str, str] | None = None, manifest_entry: str | None = None,
) -> DataFrame:
    """A document for one clip under the caller's own actor and role.

    side_files names the files that go with it: manifest (with manifest_entry, the clip's path in it), amf, cdl, fdl, ale.
    Those that the inventory does not hold are left out.
    """
    side_files = side_files or {}
    unknown = set(side_files) - {"manifest", "amf", "cdl", "fdl", "ale"}
    if unknown:
        raise ValueError(f"unknown side files: {', '.join(sorted(unknown))}")
    if "manifest" in side_files and not manifest_entry:
        raise ValueError("a manifest needs manifest_entry")
    digests = hashes.file_digests(inventory.where(F.col("path") == clip).select("path", F.lit(alg).alias("alg")))
    clips = digests.where("status = 'ok'").withColumnRenamed("path", "clip_path").withColumn("file", F.lit(manifest_entry))
    for name, path in side_files.items():
        held = inventory.where(F.col("path") == path).select(F.col("path").alias(f"{name}_path")).distinct()
        clips = clips.join(held, F.lit(path) == F.col(f"{name}_path"), "left")
    if side_files:
        clips = _describe_side_files(clips, list(side_files))
    return ops.build_documents(clips, ts, who, kid, signer, base_dir, codec=True)
