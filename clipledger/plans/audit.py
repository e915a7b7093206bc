"""The nine-stage audit over a corpus."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import hashes, paths
from clipledger.operators import colour, conform, flatten, integrity, keys, ledger, locks, matching, rollup
from clipledger.session import cut_lineage


@dataclass
class Inputs:
    """What an audit may look at; what is absent is not checked.

    inventory: path, length; digests: path, alg, value, status (computed from the files when
    absent); cdls / looks: path and numbers; base_dir: fixed folder document paths start from,
    else each document's own folder; moved_to: path, ix of files that artifact paths are repaired to first.
    """

    documents: DataFrame
    inventory: DataFrame | None = None
    digests: DataFrame | None = None
    keyring: DataFrame | None = None
    revocations: DataFrame | None = None
    manifest: DataFrame | None = None
    manifest_rejects: DataFrame | None = None
    cdls: DataFrame | None = None
    cdl_errors: DataFrame | None = None
    looks: DataFrame | None = None
    vocabulary: DataFrame | None = None
    vocabulary_paths: list[str] = field(default_factory=list)
    base_dir: str | None = None
    trust_manifest: bool = False
    missing_is_skip: bool = False
    moved_to: DataFrame | None = None
    verifier: object = None
    only: set[str] | None = None  # stages to run; all when absent


#: Cells that name a document.
NAME_PATH = "$.Asset[0].name"
FILE_PATH = "$.Asset[0].AssetSC.structuralProperties.fileDetails.fileName"


@dataclass
class Audit:
    """What an audit found, and the tables it read, so that an export needs no second pass over the documents."""

    parsed: DataFrame
    findings: DataFrame
    stages: DataFrame
    reports: DataFrame
    artifacts: DataFrame
    events: DataFrame
    locks: DataFrame


def flat_tables(parsed: DataFrame, base_dir: str | None = None, moved_to: DataFrame | None = None):
    """groups, artifacts (with resolved path and base_dir), events, locks of parsed documents."""
    groups = flatten.groups(parsed)
    base = F.lit(base_dir) if base_dir else paths.dirname(F.col("sidecar_path"))
    arts = flatten.artifacts(groups)
    if moved_to is not None:
        arts = matching.remap_artifacts(arts, moved_to)
    arts = arts.withColumn("base_dir", base).withColumn(
        "resolved", paths.resolve(F.coalesce("path", F.lit("")), F.col("base_dir"))
    )
    return groups, arts, flatten.events(groups), flatten.locks(groups)


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


def audit(inputs: Inputs) -> Audit:
    """Findings, one row per document and stage, one report per document."""
    asked = [NAME_PATH, FILE_PATH, *[r[0] for r in conform.ENVELOPE_RULES]]
    asked += [p for p in inputs.vocabulary_paths if p not in asked]
    stages = [s for s in schemas.STAGE_TITLES if inputs.only is None or s in inputs.only]
    # The only pass over document text; all stages start from what it leaves.
    parsed = cut_lineage(flatten.parse(inputs.documents, asked))
    groups, arts, events, lock_rows = flat_tables(parsed, inputs.base_dir, inputs.moved_to)
    found = []
    if {"1", "7"} & set(stages):
        cells = flatten.cells(parsed, asked)
        if "1" in stages:
            found.append(conform.envelope_findings(parsed, cells))
        if "7" in stages and inputs.vocabulary is not None and inputs.vocabulary_paths:
            found.append(conform.vocabulary_findings(cells.where(F.col("rule").isin(inputs.vocabulary_paths)), inputs.vocabulary))
    if "2" in stages:
        found.append(conform.payload_findings(groups, arts, events, lock_rows))
    if "3" in stages:
        found.append(ledger.chain_findings(events))
    if "5" in stages:
        found.append(locks.lock_findings(lock_rows, events, flatten.document_order("event_ix")))
    if "4" in stages and inputs.keyring is not None:
        ring = inputs.keyring
        if inputs.revocations is not None:
            ring = keys.apply_revocations(ring, inputs.revocations)
        found.append(keys.key_findings(events, ring, inputs.verifier))
    if inputs.inventory is not None and {"6", "8", "9"} & set(stages):
        found.extend(_file_findings(inputs, arts))
    if not found:
        found.append(ledger.chain_findings(events).limit(0))
    findings = cut_lineage(_union(found).where(F.col("stage").isin(stages)))
    results = rollup.stage_results(findings, parsed, stages, skipped=_not_checked(inputs))
    base = F.lit(inputs.base_dir) if inputs.base_dir else paths.dirname(F.col("sidecar_path"))
    reports = rollup.reports(results).withColumn("base_dir", base)
    return Audit(parsed, findings, results.drop("lines"), reports, arts, events, lock_rows)


def _not_checked(inputs: Inputs) -> dict[str, str]:
    """Stages that lack an input, and which."""
    needs = {
        "4": [("keyring", inputs.keyring)],
        "6": [("inventory", inputs.inventory)],
        "7": [("vocabulary", inputs.vocabulary), ("vocabulary paths", inputs.vocabulary_paths or None)],
        "8": [("inventory", inputs.inventory), ("manifest", inputs.manifest)],
        "9": [("inventory", inputs.inventory), ("colour decisions", inputs.cdls), ("looks", inputs.looks)],
    }
    lacking = {stage: [name for name, given in asked if given is None] for stage, asked in needs.items()}
    return {stage: " and no ".join(names) for stage, names in lacking.items() if names}


def _file_findings(inputs: Inputs, arts: DataFrame) -> list[DataFrame]:
    """Stages 6, 8 and 9: the ones that look at files."""
    inventory, manifest = inputs.inventory, inputs.manifest
    trusted = integrity.trusted(arts, manifest) if inputs.trust_manifest and manifest is not None else None
    claims = None
    if manifest is not None:
        rejects = inputs.manifest_rejects
        if rejects is None:
            rejects = manifest.select("manifest_path").limit(0)
        claims = integrity.manifest_claims(arts, manifest, rejects, inventory)
    digests = inputs.digests
    if digests is None:
        asked = integrity.digest_requests(arts, inventory, trusted)
        if claims is not None:
            asked = asked.unionByName(
                claims.where("state = 'check'").select(F.col("camera_path").alias("path"), F.col("m_alg").alias("alg"))
            )
        digests = cut_lineage(hashes.file_digests(asked))
    outcomes = integrity.artifact_outcomes(arts, inventory, digests, trusted, inputs.missing_is_skip)
    found = [integrity.artifact_findings(outcomes)]
    if claims is not None:
        found.append(integrity.manifest_findings(integrity.manifest_outcomes(claims, digests)))
    if inputs.cdls is not None and inputs.looks is not None:
        found.append(_colour_findings(inputs, arts))
    return found


def _colour_findings(inputs: Inputs, arts: DataFrame) -> DataFrame:
    def listed(kind: str) -> DataFrame:
        return arts.where(F.col("kind") == kind).select("sidecar_path", "resolved").distinct()

    def numbers(df: DataFrame, kind: str) -> DataFrame:
        v = colour.vector(F.col("slope"), F.col("offset"), F.col("power"), F.col("saturation"))
        return listed(kind).join(df.select(F.col("path").alias("resolved"), v.alias("v")), "resolved").select(
            "sidecar_path", F.col("resolved").alias("path"), "v"
        )

    agreed = colour.agreement(numbers(inputs.cdls, "cdl"), numbers(inputs.looks, "amf"), ["sidecar_path"])
    errors = inputs.cdl_errors if inputs.cdl_errors is not None else inputs.cdls.select("path").limit(0)
    with_amf = listed("amf").select("sidecar_path").distinct()
    bad = (
        listed("cdl")
        .join(errors.select(F.col("path").alias("resolved")), "resolved")
        .join(with_amf, "sidecar_path", "left_semi")
        .select("sidecar_path", F.col("resolved").alias("path"), F.lit(1).alias("n"))
    )
    return colour.colour_findings(agreed, bad)
