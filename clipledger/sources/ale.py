"""Sectioned tab tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.sources.documents import plain_path


def ale_rows(spark: SparkSession, *roots: str, glob: str = "*.ale") -> DataFrame:
    """(path, row_ix, cells MAP) of every data row below the roots."""
    raw = spark.read.text(list(roots), wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return parse_ale(raw.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text")))


def parse_ale(files: DataFrame, key: str = "path") -> DataFrame:
    """Rows of one file per text: LF or CRLF, blank lines and extra header fields are fine, short rows
    fill up with ''. One file is one row, so the array work below is bounded by a file."""
    lines = F.split("text", "\r?\n")
    at = lambda name: F.array_position(F.transform("_lines", lambda x: F.trim(x)), F.lit(name))
    cut = files.select(key, lines.alias("_lines")).withColumn("_col", at("Column")).withColumn("_data", at("Data"))
    tail = F.slice("_lines", F.greatest(F.col("_col") + 1, F.lit(1)), F.size("_lines"))
    header = F.filter(tail, lambda x: F.trim(x) != "")[0]
    body = F.filter(F.slice("_lines", F.col("_data") + 1, F.size("_lines")), lambda x: F.trim(x) != "")
    rows = (
        cut.where("_col > 0 and _data > _col")
        .select(key, F.split(header, "\t").alias("_names"), F.posexplode(body).alias("row_ix", "_line"))
        .where(~F.trim("_line").isin("Heading", "Column", "Data"))
    )
    values = F.split("_line", "\t")
    cells = F.transform(
        F.sequence(F.lit(1), F.size("_names")), lambda i: F.coalesce(F.try_element_at(values, i), F.lit(""))
    )
    return rows.select(key, "row_ix", F.map_from_arrays("_names", cells).alias("cells"))
