"""Colour decisions from CDL and AMF files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.sources.documents import plain_path

_SOP = "STRUCT<Slope: STRING, Offset: STRING, Power: STRING>"
_SAT = "STRUCT<Saturation: STRING>"


def triple(value: Column) -> Column:
    """Three numbers from text, null unless there are exactly three."""
    parts = F.transform(F.split(F.trim(value), r"\s+"), lambda x: x.try_cast("double"))
    return F.when((F.size(parts) == 3) & F.forall(parts, lambda x: x.isNotNull()), parts)


def _shape(rows: DataFrame, source: str) -> DataFrame:
    sat_text = F.col("SATNode.Saturation")
    sat = F.when(sat_text.isNull(), F.lit(1.0)).otherwise(F.trim(sat_text).try_cast("double"))
    return rows.select(
        "path", "_pos", F.lit(source).alias("source"), "applied", "description",
        triple(F.col("SOPNode.Slope")).alias("slope"),
        triple(F.col("SOPNode.Offset")).alias("offset"),
        triple(F.col("SOPNode.Power")).alias("power"),
        sat.alias("saturation"), F.col("SOPNode").isNotNull().alias("has_sop"),
    )


def _read(spark: SparkSession, tag: str, glob: str, layout: str, *roots: str) -> DataFrame:
    raw = (
        spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", glob).schema(layout).load(list(roots))
    )
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.withColumn("path", plain_path(F.col("_metadata.file_path"))).withColumn("_pos", pos)


_GOOD = "slope is not null and offset is not null and power is not null and saturation is not null"


def cdls(spark: SparkSession, *roots: str) -> tuple[DataFrame, DataFrame]:
    """(colour corrections, unparseable CDL files); a file counts by its first ColorCorrection."""
    rows = _read(
        spark, "ColorCorrection", "*.cdl",
        f"_id STRING, Description STRING, SOPNode {_SOP}, SATNode {_SAT}", *roots,
    )
    shaped = _shape(rows.withColumn("applied", F.lit(None).cast("boolean")).withColumnRenamed("Description", "description"), "cdl")
    cols = [c for c in shaped.columns if c not in ("path", "_pos")]
    first = shaped.groupBy("path").agg(F.min_by(F.struct(*cols), "_pos").alias("c")).select("path", "c.*")
    ok = first.where(f"has_sop and {_GOOD}")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.cdl")
        .load(list(roots)).select(plain_path(F.col("path")).alias("path"))
    )
    return ok.drop("has_sop"), files.join(ok.select("path").distinct(), "path", "left_anti")


def amf_looks(spark: SparkSession, *roots: str) -> DataFrame:
    """Looks with numbers in them; 'applied' defaults to true, malformed looks drop out."""
    rows = _read(
        spark, "lookTransform", "*.amf",
        f"_applied STRING, description STRING, SOPNode {_SOP}, SATNode {_SAT}", *roots,
    )
    applied = F.lower(F.coalesce("_applied", F.lit("true"))) == "true"
    return _shape(rows.withColumn("applied", applied), "amf").where(f"has_sop and {_GOOD}").drop("has_sop")
