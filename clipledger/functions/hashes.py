"""Hash picks, canonical event hashes and content digests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger import schemas

# Control characters Spark escapes with upper-case hex; canonical JSON wants lower case.
_UPPER_ESCAPES = ["000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"]


def rank_of(alg: Column, order: list[str]) -> Column:
    """Position of alg in a preference list, null when it is not listed."""
    return F.nullif(F.array_position(F.array(*[F.lit(a) for a in order]), alg), F.lit(0).cast("bigint"))


def gather(tags: dict[str, Column]) -> Column:
    """Tag columns of one entry as MAP algorithm -> value; unknown tags drop out, absent ones stay null.

    Keys are fixed, so the optimizer turns a later lookup into the column itself. When two tags
    name the same algorithm the later one wins.
    """
    by_alg: dict[str, list[Column]] = {}
    for tag, value in tags.items():
        alg = schemas.ALGORITHM_ALIASES.get(tag.lower())
        if alg:
            by_alg.setdefault(alg, []).insert(0, value.cast("string"))
    return F.create_map(*[x for alg, cols in by_alg.items() for x in (F.lit(alg), F.coalesce(*cols))])


def pick(entry_hashes: Column, order: list[str], skip_empty: bool) -> tuple[Column, Column]:
    """(alg, value) of an entry's hash map by preference order, nulls when none is listed.

    skip_empty=True passes over empty values (builders); False goes by presence alone (audits).
    The hashes of an entry sit on its row, so these are plain generated expressions and move no data.
    """
    found = [(alg, F.try_element_at(entry_hashes, F.lit(alg))) for alg in order]
    if skip_empty:
        found = [(alg, F.nullif(value, F.lit(""))) for alg, value in found]
    alg_ = F.coalesce(*[F.when(value.isNotNull(), alg) for alg, value in found])
    return alg_, F.coalesce(*[value for _, value in found])


def canonical_json(raw: Column, drop: tuple[str, ...] = ("hash", "sig")) -> Column:
    """Canonical JSON of a VARIANT object without the named keys.

    VARIANT keeps keys sorted, nulls present and integers bare, so any extra key is covered too.
    """
    kept = F.map_filter(F.try_variant_get(raw, "$", "map<string,variant>"), lambda k, v: ~k.isin(list(drop)))
    text = F.to_json(kept)
    fixed = text
    for code in _UPPER_ESCAPES:
        fixed = F.regexp_replace(fixed, r"((?<!\\)(?:\\\\)*)\\u" + code, r"$1\\u" + code.lower())
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def event_hash(raw: Column) -> Column:
    """'sha256:' and the digest of the event without its hash and signature."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(raw), 256))


def native_digest(content: Column, alg: Column) -> Column:
    """Digest of a string or binary column for the algorithms Spark has built in, else null."""
    return (
        F.when(alg == "md5", F.md5(content))
        .when(alg == "sha1", F.sha1(content))
        .when(alg == "sha256", F.sha2(content, 256))
        .when(alg == "sha512", F.sha2(content, 512))
    )


def _xx_digest():
    """Arrow UDF for xxh64 / xxh3 with seed 0 over whole values; Spark's own has seed 42 only."""

    def run(content: pd.Series, alg: pd.Series) -> pd.Series:
        import xxhash

        out = []
        for data, name in zip(content, alg):
            if data is None:
                out.append(None)
                continue
            h = xxhash.xxh64(seed=0) if name == "xxh64" else xxhash.xxh3_64(seed=0)
            h.update(bytes(data) if isinstance(data, (bytes, bytearray)) else data.encode())
            out.append(h.hexdigest())
        return pd.Series(out, dtype="object")

    return F.pandas_udf(run, T.StringType())


def content_digests(contents: DataFrame) -> DataFrame:
    """(path, alg, content) -> (path, alg, value, status). Asked once per distinct (path, alg).

    The native branch stays in generated code; only xx rows go through Python.
    """
    xx = F.col("alg").isin("xxh64", "xxh3")
    native = contents.where(~xx).withColumn("value", native_digest(F.col("content"), F.col("alg")))
    arrow = contents.where(xx).withColumn("value", _xx_digest()(F.col("content"), F.col("alg")))
    status = (
        F.when(F.col("content").isNull(), "missing").when(F.col("value").isNull(), "unsupported").otherwise("ok")
    )
    return native.unionByName(arrow).select("path", "alg", "value", status.alias("status"))


def _digest_paths(chunk: int):
    """Stream files from the executor in fixed chunks: no cell ever holds a whole file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        from clipledger.functions import files

        def hasher(alg):
            if alg in ("md5", "sha1", "sha256", "sha512"):
                return hashlib.new(alg)
            if alg in ("xxh64", "xxh3"):
                import xxhash

                return xxhash.xxh64(seed=0) if alg == "xxh64" else xxhash.xxh3_64(seed=0)
            return None

        for pdf in batches:
            values, states = [], []
            for path, alg in zip(pdf["path"], pdf["alg"]):
                h, value, state = hasher(alg), None, "unsupported"
                if h is not None:
                    try:
                        with files.opened(path) as f:
                            while block := f.read(chunk):
                                h.update(block)
                        value, state = h.hexdigest(), "ok"
                    except files.NoSuchFile:
                        state = "missing"
                    except OSError:
                        state = "unreadable"
                values.append(value)
                states.append(state)
            yield pdf[["path", "alg"]].assign(value=values, status=states)

    return run


def file_digests(requests: DataFrame, partitions: int | None = None, chunk: int = 1 << 20) -> DataFrame:
    """Digest files for each distinct (path, alg) asked for; a path may be a URI of any store pyarrow knows.

    Files reach tens of gigabytes, beyond what one cell can hold, so tasks get paths and read
    in chunks. The number of tasks is fixed: left to itself AQE would merge them by the bytes of
    the path strings, and thousands of file reads would share one task.
    """
    spark = requests.sparkSession
    n = partitions or max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = requests.select("path", "alg").distinct().repartition(n, "path", "alg")
    return spread.mapInPandas(_digest_paths(chunk), schemas.DIGEST)
