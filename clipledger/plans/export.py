"""Flat provenance rows and the log table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import paths, text
from clipledger.operators import flatten, ledger
from clipledger.plans.audit import FILE_PATH, NAME_PATH, Audit, flat_tables
from clipledger.session import cut_lineage


def names(parsed: DataFrame) -> DataFrame:
    """Asset name, else file name, else the stem of the document path."""
    at = lambda p: F.filter("cells", lambda c: c["where_"] == p)[0]["value"]
    return parsed.where("parsed").select(
        "sidecar_path", text.first_name(at(NAME_PATH), at(FILE_PATH), paths.stem(F.col("sidecar_path"))).alias("name")
    )


def parse_named(documents: DataFrame) -> DataFrame:
    """Parsed documents with the cells names() needs."""
    return cut_lineage(flatten.parse(documents, [NAME_PATH, FILE_PATH]))


def flat_rows(summary: DataFrame, now: Column, signed: Column, tape: str | None = None, base_dir: str | None = None) -> DataFrame:
    """Twelve columns per document from name, kid, events, locks, last_lock_kid and chain_head."""
    shown = (
        F.when(
            F.startswith("sidecar_path", F.lit(base_dir.rstrip("/") + "/")),
            F.substr("sidecar_path", F.lit(len(base_dir.rstrip("/")) + 2)),
        ).otherwise(F.col("sidecar_path"))
        if base_dir
        else paths.basename(F.col("sidecar_path"))
    )
    locked_by = F.when(F.col("locks") > 0, F.col("last_lock_kid")).otherwise("")
    values = [
        F.col("name"), F.lit(tape) if tape else text.tape_id(F.col("name")),
        F.lit(schemas.ALE_START), F.lit(schemas.ALE_END),
        F.when(signed, "true").otherwise("false"), F.col("kid"),
        F.col("events").cast("string"), F.col("locks").cast("string"), locked_by,
        text.iso_z(now), shown, F.col("chain_head"),
    ]
    return summary.select(
        "sidecar_path", text.utc_day(now).alias("day"), *[v.alias(c) for v, c in zip(values, schemas.ALE_COLUMNS)]
    )


def summaries(documents: DataFrame) -> DataFrame:
    """Per document: name, counts, tip and latest lock signer; documents without events included."""
    parsed = parse_named(documents)
    _, _, events, locks = flat_tables(parsed)
    return _summaries(parsed, events, locks)


def _summaries(parsed: DataFrame, events: DataFrame, locks: DataFrame) -> DataFrame:
    placed = events.withColumn("_at", flatten.document_order("event_ix"))
    tips = ledger.tips(placed, ["sidecar_path"], ["seq", "_at"])
    lock_counts = locks.groupBy("sidecar_path").agg(F.count(F.lit(1)).alias("locks"))
    blank = {"events": 0, "locks": 0, "kid": "", "chain_head": "", "last_lock_kid": ""}
    return names(parsed).join(tips, "sidecar_path", "left").join(lock_counts, "sidecar_path", "left").fillna(blank)


def export(
    documents: DataFrame, now: Column, stages: DataFrame | None = None, tape: str | None = None, base_dir: str | None = None
) -> DataFrame:
    """Flat rows; signed is the verdict of stage 4 of the audit stages given, and false where there are none."""
    return _judged(summaries(documents), now, stages, tape, base_dir)


def export_audited(result: Audit, now: Column, tape: str | None = None, base_dir: str | None = None) -> DataFrame:
    """Flat rows of the documents of an audit, from the tables it read; stage 4 must be among its stages for a document to be signed."""
    return _judged(_summaries(result.parsed, result.events, result.locks), now, result.stages, tape, base_dir)


def _judged(rows: DataFrame, now: Column, stages: DataFrame | None, tape: str | None, base_dir: str | None) -> DataFrame:
    if stages is None:
        return flat_rows(rows, now, F.lit(False), tape, base_dir)
    verdict = stages.where("stage = '4'").select("sidecar_path", (F.col("status") == "pass").alias("_signed"))
    judged = rows.join(verdict, "sidecar_path", "left")
    return flat_rows(judged, now, F.coalesce("_signed", F.lit(False)), tape, base_dir)


def fields(rows: DataFrame, six: bool = False) -> DataFrame:
    """The eight provenance fields, or the six of the short form."""
    return rows.select("sidecar_path", *(schemas.SIX_FIELDS if six else schemas.EIGHT_FIELDS))
