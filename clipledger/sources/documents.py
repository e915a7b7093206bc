"""Sidecar documents and the files around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import paths
from clipledger.sources import listing


def plain_path(uri: Column) -> Column:
    """'file:///a/b c' and 'file:/a/b' to '/a/b c'; other schemes stay."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def documents(spark: SparkSession, *roots: str, glob: str = "*.omc.json") -> DataFrame:
    """Every sidecar below the roots, one row each; body is null when the text is not JSON."""
    raw = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("sidecar_path"), F.col("value").alias("text")).withColumn(
        "body", F.try_parse_json("text")
    )


def document_rows(df: DataFrame, path: str = "sidecar_path", text: str = "body") -> DataFrame:
    """Documents already held as rows of JSON text."""
    return df.select(F.col(path).alias("sidecar_path"), F.col(text).alias("text")).withColumn(
        "body", F.try_parse_json("text")
    )


def inventory(spark: SparkSession, *roots: str, exts: list[str] | None = None) -> DataFrame:
    """(path, length, mtime) of files below the roots; content is never read, and the driver holds no listing."""
    found = listing.tree(spark, *roots)
    return found.where(paths.extension(F.col("path")).isin(exts)) if exts else found


def by_basename(files: DataFrame) -> DataFrame:
    """How many files share each basename, and the first path. Joins use the flat rows instead."""
    return files.groupBy(paths.basename(F.col("path")).alias("basename")).agg(
        F.count(F.lit(1)).alias("files"), F.min("path").alias("first_path")
    )


def shallowest(files: DataFrame, bundle: str) -> DataFrame:
    """One sidecar per bundle: fewest path components, then lowest path."""
    depth = F.size(F.split("path", "/"))
    return files.groupBy(bundle).agg(F.min_by("path", F.struct(depth, "path")).alias("path"))


def keyring(spark: SparkSession, *files: str) -> DataFrame:
    """Keyring files in either form, a bare key text or an object with validity."""
    doc = spark.read.text(list(files), wholetext=True).select(F.parse_json("value").alias("v"))
    keys = F.try_variant_get("v", "$.keys", "map<string,variant>")
    entries = doc.select(F.explode(keys).alias("kid", "k")).select("kid", F.to_json("k").alias("entry"))
    return expand_keys(entries)


def expand_keys(entries: DataFrame) -> DataFrame:
    """Rows (kid, entry JSON text) to keyring rows; a JSON string is a bare key."""
    rows = entries.select("kid", F.parse_json("entry").alias("k"))
    bare = F.schema_of_variant("k") == "STRING"
    get = lambda name: F.try_variant_get("k", f"$.{name}", "string")
    return rows.select(
        "kid",
        F.when(bare, F.try_variant_get("k", "$", "string")).otherwise(get("publicKey")).alias("public_key"),
        F.try_to_timestamp(get("validFrom")).alias("valid_from"),
        F.try_to_timestamp(get("validUntil")).alias("valid_until"),
        F.try_to_timestamp(get("revokedAt")).alias("revoked_at"),
        get("revocationReason").alias("reason"),
    )


def revocations(spark: SparkSession, *files: str) -> DataFrame:
    """(ix, kid, revoked_at, reason), ix the place in the list."""
    layout = "revocations ARRAY<STRUCT<kid: STRING, revokedAt: STRING, reason: STRING>>"
    return revocation_rows(spark.read.schema(layout).option("multiLine", True).json(list(files)))


def revocation_rows(lists: DataFrame) -> DataFrame:
    flat = lists.select(F.posexplode("revocations").alias("ix", "r"))
    return flat.select("ix", "r.kid", F.try_to_timestamp("r.revokedAt").alias("revoked_at"), "r.reason")


def watch_state(spark: SparkSession, *files: str) -> DataFrame:
    """Saved watcher states; 'emitted' may be absent and counts as empty, newest 100 kept."""
    raw = spark.read.schema(schemas.WATCH_STATE).option("multiLine", True).json(list(files))
    return state_rows(raw.withColumn("state_path", plain_path(F.col("_metadata.file_path"))))


def state_rows(raw: DataFrame) -> DataFrame:
    emitted = F.coalesce("emitted", F.array().cast("array<struct<clipName:string,omcPath:string,signedAt:string,status:string>>"))
    start = F.greatest(F.size(emitted) - 99, F.lit(1))
    return raw.withColumn("emitted", F.slice(emitted, start, F.lit(100)))


def state_emissions(states: DataFrame, key: str = "state_path") -> DataFrame:
    """One row per remembered emission, in order."""
    return states.select(key, F.posexplode("emitted").alias("ix", "e")).select(
        key, "ix", F.col("e.clipName").alias("clip"), F.col("e.omcPath").alias("sidecar_path"),
        F.col("e.signedAt").alias("at"), F.col("e.status").alias("status"),
    )
