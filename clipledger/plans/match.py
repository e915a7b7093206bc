"""Documents to clips by name, and path repair before an audit."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import paths
from clipledger.operators import matching
from clipledger.plans import audit as audit_plan
from clipledger.plans import export as export_plan


def match(documents: DataFrame, clips: DataFrame, now: Column, threshold: int = 65) -> DataFrame:
    """One-to-one match in sidecar_ix order with the eight fields of each matched document.

    documents: sidecar_ix and the document columns; clips: clip_ix, clip_name.
    """
    parsed = export_plan.parse_named(documents)
    named = export_plan.names(parsed).join(documents.select("sidecar_path", "sidecar_ix"), "sidecar_path")
    sides = named.select("sidecar_ix", "name", paths.strip_double_extension(F.col("sidecar_path")).alias("base"))
    pairs = matching.assign(sides, clips, threshold)
    rows = export_plan.export(documents, now)
    keyed = pairs.join(named.select("sidecar_ix", "sidecar_path"), "sidecar_ix").join(clips, "clip_ix")
    return keyed.join(export_plan.fields(rows), "sidecar_path")


def remap_and_audit(inputs: audit_plan.Inputs, inventory: DataFrame) -> audit_plan.Audit:
    """Audit with artifact paths repaired and missing files as skips. inventory: path relative to base_dir, ix.

    The repair lives in the artifact table; the documents, their events and their hashes stay as they are.
    """
    return audit_plan.audit(dataclasses.replace(inputs, moved_to=inventory, missing_is_skip=True))


def by_adjacency(clips: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Clips with the document beside them and its six fields; clips without one are left out."""
    placed = matching.adjacent(clips, documents).where(F.col("sidecar_path").isNotNull())
    rows = export_plan.export(documents, now)
    return placed.join(rows.select("sidecar_path", *schemas.SIX_FIELDS), "sidecar_path")
