"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.functions import text


def write_documents(documents: DataFrame, out: str, by: str | None = None) -> None:
    """JSON lines, one document per line; a file per clip would be millions of tiny objects.

    The lines of one call go to a folder named by their content, so writing the same documents again replaces them, and other
    documents stay. A call that holds some of an earlier call's documents writes them once more; read_documents gives each once."""
    rows = documents.select(*([by] if by else []), F.col("body").alias("value"))
    told = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)"))).first()
    named = rows.withColumn("content", F.lit(f"c{told[0]}_{told[1] or 0}".replace("-", "m")))
    (
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("content", *([by] if by else [])).text(out)
    )


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """Every document of write_documents once, as body."""
    return spark.read.text(out, recursiveFileLookup=True).select(F.col("value").alias("body")).distinct()


def ale_line(cols: list[str] = schemas.ALE_COLUMNS) -> Column:
    return F.concat_ws("\t", *[text.clean_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])


def ale_lines(rows: DataFrame, day: str = "day", order: str = "arrival", parts: int = 1) -> DataFrame:
    """(day, part, pos, line): the text of the log files, header lines first in every part.

    A day is one file, as its readers expect. Where a day is more than one task should write, parts deals every day to so
    many whole files by document."""
    part = F.pmod(F.xxhash64(schemas.ALE_KEY), F.lit(parts)).cast("bigint")
    data = rows.select(
        day, part.alias("part"), F.lit(len(schemas.ALE_HEADER)).cast("bigint").alias("pos"),
        F.col(order).alias("_order"), ale_line().alias("line"),
    )
    header = F.array(*[F.lit(h) for h in schemas.ALE_HEADER])
    each = rows.select(day).distinct().select(day, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"))
    heads = each.select(day, "part", F.posexplode(header).alias("pos", "line"))
    heads = heads.select(day, "part", F.col("pos").cast("bigint").alias("pos"), "line")
    order_type = dict(data.dtypes)["_order"]
    return heads.withColumn("_order", F.lit(None).cast(order_type)).unionByName(data, allowMissingColumns=True)


def write_ale(rows: DataFrame, out: str, day: str = "day", order: str = "arrival", parts: int = 1) -> None:
    """One folder per day and part, one whole log file in each, CRLF line ends.

    A file is sorted and streamed by one task, which spills and holds no day in memory. Only the days present in rows are replaced.
    """
    lines = ale_lines(rows, day, order, parts)
    (
        lines.repartition(day, "part")
        .sortWithinPartitions(day, "part", "pos", "_order")
        .select(day, "part", "line")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("lineSep", "\r\n")
        .partitionBy(day, "part")
        .text(out)
    )


def upsert_log(current: DataFrame, changed: DataFrame, key: list[str], order: str = "arrival") -> DataFrame:
    """Rows of the days that changed, last row per key, moved to the end by its arrival."""
    from clipledger.operators.rollup import keep_last

    days = changed.select("day").distinct()
    touched = current.join(days, "day", "left_semi")
    return keep_last(touched.unionByName(changed), ["day", *key], [order])


def write_log_table(rows: DataFrame, out: str) -> None:
    """Replace the days present in rows, leave the others."""
    (
        rows.repartition("day", *[schemas.ALE_KEY] if schemas.ALE_KEY in rows.columns else [])
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(out)
    )


def split_quarantine(documents: DataFrame, reports: DataFrame, key: str = "sidecar_path") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with the failing stages as reason)."""
    failing = F.filter("stages", lambda s: s["status"] == "fail")
    reason = F.array_join(
        F.transform(failing, lambda s: F.concat(F.lit("stage "), s["stage"], F.lit(": "), s["errors"].cast("string"))), "; "
    )
    joined = documents.join(reports.select(key, "errors", reason.alias("reason")), key)
    return joined.where("errors = 0").drop("errors", "reason"), joined.where("errors > 0")
