"""Manifest entries and media files to new documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes, paths, text


@dataclass(frozen=True)
class Identity:
    """Who a builder writes as. ts is passed in, so a rerun gives the same bytes."""

    actor: str = "urn:service:ingest"
    role: str = "IngestService"
    tool: str = "clipledger"
    version: str = "0.1"
    namespace: str = "urn:clipledger:sidecar:v0.1"
    schema_version: str = "v2.8"
    reason: str = "ingested from manifest, clip bytes not read"


def gather_tags(entries: DataFrame, tags: list[str]) -> DataFrame:
    """Wide entries, one column per tag, to one hashes map per entry."""
    rest = [c for c in entries.columns if c not in tags]
    return entries.select(*rest, hashes.gather({t: F.col(t) for t in tags}).alias("hashes"))


def entry_outcomes(manifest: DataFrame, inventory: DataFrame, root_join: bool = True) -> DataFrame:
    """Each manifest entry with its outcome and, for usable ones, the clip path and strongest hash.

    outcome, in the builder's order: no_file, not_clip, missing_clip, no_hash, ok. The only
    shuffle is the join to the inventory; AQE splits a path that many manifests list. Hex digits
    cross it as bytes, and a file that is its own clip path once.
    """
    clip = paths.resolve(F.col("file"), paths.dirname(F.col("manifest_path"))) if root_join else F.col("file")
    here = inventory.groupBy(F.col("path").alias("clip_path")).agg(F.max("length").alias("length"))
    alg, value = hashes.pick(F.col("hashes"), schemas.STRONG_FIRST, skip_empty=True)
    keep = ["manifest_path", "entry_ix", "file", "manifest_sha256"]
    digests = {"manifest_sha256": F.col("manifest_sha256"), "value": value}
    picked = manifest.select(
        "manifest_path", "entry_ix", *(["file"] if root_join else []), clip.alias("clip_path"), alg.alias("alg"),
        *[c for name, text_ in digests.items() for c in _packed(text_, name)],
    )
    joined = picked.join(here.withColumn("_here", F.lit(True)), "clip_path", "left")
    joined = joined.withColumns({name: _unpacked(name) for name in digests})
    if not root_join:
        joined = joined.withColumn("file", F.col("clip_path"))
    outcome = (
        F.when(F.coalesce("file", F.lit("")) == "", "no_file")
        .when(~paths.is_clip(F.col("file")), "not_clip")
        .when(F.col("_here").isNull(), "missing_clip")
        .when(F.col("alg").isNull(), "no_hash")
        .otherwise("ok")
    )
    return joined.select(
        *keep, "clip_path", "length", "alg", "value", outcome.alias("outcome")
    )


def _packed(text_: Column, name: str) -> list[Column]:
    """Lower-case hex digits as the bytes they stand for, any other text as it is."""
    is_hex = text_.rlike(r"^[0-9a-f]+\z") & (F.length(text_) % 2 == 0)
    return [F.when(is_hex, F.unhex(text_)).alias(f"_{name}_bytes"), F.when(~is_hex, text_).alias(f"_{name}_text")]


def _unpacked(name: str) -> Column:
    return F.coalesce(F.lower(F.hex(f"_{name}_bytes")), F.col(f"_{name}_text"))


def usable(outcomes: DataFrame) -> DataFrame:
    """The entries documents are built from. What can be told before the inventory is asked apart, so that other entries are not moved to it."""
    return outcomes.where((F.col("outcome") == "ok") & paths.is_clip(F.col("file")) & F.col("alg").isNotNull())


def coverage(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Documents, skipped entries and bytes covered."""
    ok = F.col("outcome") == "ok"
    return outcomes.groupBy(*(by or [])).agg(
        F.count_if(ok).alias("documents"),
        F.count_if(~ok).alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("length"))), F.lit(0)).cast("bigint").alias("bytes"),
    )


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Files with the manifest of the nearest folder at or above them; files with none drop out.

    The climb runs once per distinct folder, not per file, and meets one row per manifest folder.
    """
    roots = manifests.groupBy(paths.dirname(F.col("manifest_path")).alias("dir")).agg(
        F.min("manifest_path").alias("manifest_path")
    )
    located = files.withColumn("_dir", paths.dirname(F.col("path")))
    climb = located.select("_dir").distinct().select("_dir", F.explode_outer(paths.ancestors(F.col("_dir"))).alias("a"))
    best = (
        climb.select("_dir", "a.depth", "a.dir")
        .join(roots, "dir")
        .groupBy("_dir")
        .agg(F.max_by(F.struct(F.col("dir").alias("roll_dir"), "manifest_path"), "depth").alias("m"))
    )
    return located.join(best.select("_dir", "m.roll_dir", "m.manifest_path"), "_dir").drop("_dir")


def attach_by_stem(clips: DataFrame, files: DataFrame, ext: str, out: str) -> DataFrame:
    """Left join of per-clip side files (one per stem, lowest path) on the clip's stem."""
    side = (
        files.where(paths.extension(F.col("path")) == ext)
        .groupBy(paths.stem(F.col("path")).alias("stem"))
        .agg(F.min("path").alias(out))
    )
    return clips.join(side, "stem", "left")


def attach_show_file(clips: DataFrame, files: DataFrame, show: str, out: str) -> DataFrame:
    """The show's framing file on each of its clips: lowest path per show, joined on the show key."""
    first = files.groupBy(show).agg(F.min("path").alias(out))
    return clips.join(first, show, "left")


def attach_only_file(clips: DataFrame, files: DataFrame, out: str) -> DataFrame:
    """One framing file for every clip: a single aggregated row, so broadcasting it is always safe."""
    first = files.agg(F.min("path").alias(out)).withColumn("_all", F.lit(True))
    return clips.withColumn("_all", F.lit(True)).join(F.broadcast(first), "_all", "left").drop("_all")


def _artifact(clip_key: Column, role: str, kind: str, path: Column, alg: Column, value: Column, entry: Column | None = None, subtype: str | None = None):
    """Artifact as a struct with absent optional fields left null (to_json then drops them)."""
    manifest = entry is not None
    return F.struct(
        text.derived_id(clip_key, F.lit(kind), path).alias("id"),
        F.lit(role).alias("role"),
        F.lit(kind).alias("kind"),
        F.lit(subtype).cast("string").alias("subtype"),
        path.alias("path"),
        (entry if manifest else F.lit(None).cast("string")).alias("mhlEntry"),
        F.struct(alg.alias("alg"), value.alias("value")).alias("hash"),
        F.lit(True if manifest else None).cast("boolean").alias("immutable"),
    )


def json_text(value: Column) -> Column:
    """A string as a JSON string literal, quotes included."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, 2, F.length(wrapped) - 2)


def create_event(target: Column, ts: Column, who: Identity) -> Column:
    """Canonical text of the first event of a document, without hash and signature."""
    tool = f'"tool":{{"name":"{who.tool}","version":"{who.version}"}}'
    head = f'{{"action":"create","actor":{{"id":"{who.actor}","role":"{who.role}"}},"prevHash":null,"seq":1,"target":'
    return F.concat(F.lit(head), json_text(target), F.lit("," + tool + ',"ts":'), json_text(ts), F.lit("}"))


def build_documents(
    clips: DataFrame, ts: Column, who: Identity = Identity(), kid: str | None = None, signer=None, base_dir: str | None = None,
    codec: bool = False,
) -> DataFrame:
    """Clip rows to documents: (sidecar_path, clip_path, body JSON text).

    With base_dir the artifacts below it are named relative to it, so a document moves with its folder.

    clips: clip_path, alg, value, and optionally manifest_path, manifest_sha256, file, amf_path,
    amf_sha256, cdl_path, cdl_sha256, fdl_path, fdl_sha256, ale_path, ale_sha256. codec adds the one its extension stands for. signer is an optional pandas UDF from
    canonical text to a base64 signature made with kid; without one the event has a hash only.
    """
    cols = set(clips.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in cols else F.lit(None).cast("string")

    key = F.concat_ws("|", F.coalesce(col("manifest_sha256"), F.lit("")), F.col("clip_path"))
    sha = F.lit("sha256")

    def shown(path: Column) -> Column:
        return paths.relative_to(path, F.lit(base_dir)) if base_dir else path

    def side(name: str, role: str, kind: str, entry: Column | None = None, subtype: str | None = None) -> Column:
        path = col(f"{name}_path")
        return F.when(path.isNotNull(), F.to_json(_artifact(F.col("_key"), role, kind, shown(path), sha, col(f"{name}_sha256"), entry, subtype)))

    # concat_ws passes over the side files a clip does not have.
    arts = F.concat_ws(
        ",",
        F.to_json(_artifact(F.col("_key"), "clip-integrity", "source-file", shown(F.col("clip_path")), F.col("alg"), F.col("value"))),
        side("manifest", "integrity", "asc-mhl", col("file")),
        side("amf", "color-pipeline", "amf"),
        side("cdl", "color-pipeline", "cdl"),
        side("fdl", "framing", "asc-fdl"),
        side("ale", "edit-metadata", "resolve-export", subtype="ale"),
    )
    stamp = text.iso_z(ts)
    base = clips.withColumn("_key", key).withColumn("_name", paths.stem(F.col("clip_path"))).withColumn(
        "_ext", paths.extension(F.col("clip_path"))
    ).withColumn("_id", text.derived_id(F.col("_key"))).withColumn(
        "_event", create_event(F.col("_id"), stamp, who)
    ).withColumn("_hash", F.concat(F.lit("sha256:"), F.sha2("_event", 256)))
    signature = F.lit("")
    if signer is not None:
        head = f',"sig":{{"alg":"{schemas.VERIFIABLE_SIGNATURE_ALG}","kid":"{kid}","value":'
        signature = F.concat(F.lit(head), json_text(signer(F.col("_event"))), F.lit("}"))
    event_json = F.concat(
        F.regexp_replace("_event", r"\}$", ""), F.lit(',"hash":"'), F.col("_hash"), F.lit('"'), signature, F.lit("}")
    )

    def group(domain: str, items: Column) -> Column:
        schema = f"{who.namespace}:{domain.rsplit('.', 1)[-1]}.schema.json"
        return F.concat(
            F.lit(f'{{"domain":"{domain}","namespace":"{who.namespace}","schema":"{schema}","value":['), items, F.lit("]}")
        )

    groups = F.concat(
        F.lit("["), group(schemas.ARTIFACT_DOMAIN, arts), F.lit(","), group(schemas.EVENT_DOMAIN, event_json), F.lit(","),
        group(schemas.LOCK_DOMAIN, F.lit("")), F.lit("]"),
    )
    def one_id(scope: str, value: Column) -> Column:
        return F.struct(F.array(
            F.struct(F.lit(scope).alias("identifierScope"), value.alias("identifierValue"))
        ).alias("identifier"))

    asset_head = F.struct(
        F.lit(who.schema_version).alias("schemaVersion"), F.lit("Asset").alias("entityType"),
        F.array(
            F.struct(F.lit("clip-uuid").alias("identifierScope"), F.col("_id").alias("identifierValue")),
            F.struct(F.lit("source-filename").alias("identifierScope"), F.col("_name").alias("identifierValue")),
        ).alias("identifier"),
        F.col("_name").alias("name"),
        F.when(
            col("manifest_path").isNotNull(), F.concat(F.lit("Ingested from "), paths.basename(col("manifest_path")))
        ).otherwise(F.concat(F.lit("Document of "), paths.basename(F.col("clip_path")))).alias("description"),
        F.struct(
            one_id("actor", F.lit(who.actor)).alias("CreatedBy"), one_id("crew-role", F.lit(who.role)).alias("Role"),
            stamp.alias("createdOn"), F.lit(who.reason).alias("reason"),
        ).alias("provenance"),
        F.struct(
            F.lit(who.schema_version).alias("schemaVersion"), F.lit("AssetSC").alias("entityType"),
            one_id("clip-sc-uuid", F.concat(F.lit("astsc-"), F.col("_id")))["identifier"].alias("identifier"),
            paths.structural_type(F.col("_ext")).alias("structuralType"),
            F.struct(
                *([paths.codec(F.col("_ext")).alias("codec")] if codec else []),
                F.struct(F.lit("item").alias("recordType"), paths.media_type(F.col("_ext")).alias("mediaType")).alias("linkset"),
                F.struct(
                    F.col("_name").alias("fileName"),
                    F.concat(paths.dirname(F.col("clip_path")), F.lit("/")).alias("filePath"),
                    F.col("_ext").alias("fileExtension"), paths.media_type(F.col("_ext")).alias("mediaType"),
                ).alias("fileDetails"),
                F.lit("general").alias("purpose"),
            ).alias("structuralProperties"),
        ).alias("AssetSC"),
    )
    head = F.to_json(asset_head)
    body = F.concat(
        F.lit('{"Asset":['), F.substring(head, 1, F.length(head) - 1),
        F.lit(',"assetFC":{"functionalType":"capture.ocf","functionalProperties":{"customData":'), groups, F.lit("}}}]}"),
    )
    return base.select(
        F.concat("_name", F.lit(".omc.json")).alias("sidecar_path"), "clip_path", "alg", "value",
        F.col("_hash").alias("chain_head"), body.alias("body"),
    )


def published_name(stem: Column, value: Column, versions: Column) -> Column:
    """A document's file name: the stem, with the first eight characters of the hash where the stem has several."""
    return F.concat(
        F.when(versions > 1, F.concat(stem, F.lit("."), F.substring(value, 1, 8))).otherwise(stem), F.lit(".omc.json")
    )


def resolve_collisions(documents: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Documents of one stem: write the first, refresh an equal hash, keep every differing hash.

    documents / current: stem, alg, value, arrival. One row per distinct (stem, alg, value) stays,
    the earliest; copies are 'refresh'. With more than one hash all published names carry the
    first eight characters of their hash, whatever the order of arrival. Returns stem, alg,
    value, arrival, copies, outcome, name.
    """
    fresh = documents.select("stem", "alg", "value", "arrival", F.lit(False).alias("known"))
    every = fresh if current is None else fresh.unionByName(
        current.select("stem", "alg", "value", "arrival", F.lit(True).alias("known"))
    )
    kept = every.groupBy("stem", "alg", "value").agg(
        F.min("arrival").alias("arrival"), F.count_if(~F.col("known")).alias("copies"), F.max("known").alias("known")
    )
    # One row per distinct hash is left, so the count of hashes per stem combines map-side.
    versions = kept.groupBy("stem").agg(F.count(F.lit(1)).alias("versions"))
    outcome = (
        F.when(F.col("known"), "refresh").when(F.col("versions") > 1, "conflict").otherwise("write")
    )
    return kept.join(versions, "stem").select(
        "stem", "alg", "value", "arrival", "copies", outcome.alias("outcome"),
        published_name(F.col("stem"), F.col("value"), F.col("versions")).alias("name"),
    )
