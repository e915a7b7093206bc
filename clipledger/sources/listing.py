"""Files below roots, listed level by level on the executors: no listing is ever held by the driver."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.functions import files
from clipledger.session import cut_lineage

_LEVEL = pa.schema([("path", pa.string()), ("is_folder", pa.bool_()), ("length", pa.int64()), ("mtime", pa.timestamp("us", "UTC"))])
_LEVEL_DDL = "path string, is_folder boolean, length bigint, mtime timestamp"


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folders to what is in them, one level down; a folder that cannot be listed is an error."""
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            found = [e for e in files.entries(folder) if not _hidden(e[0].rsplit("/", 1)[-1])]
            for i in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[i : i + 10_000]), _LEVEL)], schema=_LEVEL)


def tree(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length, mtime) of every file below the roots, which are paths or URIs of any store pyarrow knows.

    A round lists all folders of one level, each by a task that holds one folder's entries, so there are as many rounds as the
    deepest tree has levels. Hidden names are passed over as Spark's readers do."""
    level = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string")
    found = []
    while True:
        # A fixed number of tasks: by the bytes of the path strings all folders would go to one.
        n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        seen = cut_lineage(level.repartition(n, "path").mapInArrow(_entries, _LEVEL_DDL))
        found.append(seen.where("not is_folder").drop("is_folder"))
        level = seen.where("is_folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)
