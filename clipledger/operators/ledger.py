"""Hash-chained event logs: build, audit, tips and counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipledger.functions import hashes, text

GROUP = ["sidecar_path", "json_path", "group_ix"]


def finding(stage: str, code: Column, where: Column, detail: Column, severity: str = "error", n: Column | None = None):
    """Columns of one finding row."""
    return [
        F.col("sidecar_path"),
        F.lit(stage).alias("stage"),
        F.lit(severity).alias("severity"),
        where.alias("where_"),
        code.alias("code"),
        text.clip_detail(detail).alias("detail"),
        (n if n is not None else F.lit(1)).cast("bigint").alias("n"),
    ]


def event_where(ix: str = "event_ix") -> Column:
    return F.concat(
        F.col("json_path"), F.lit("["), F.col("group_ix").cast("string"), F.lit("].value["),
        F.col(ix).cast("string"), F.lit("]"),
    )


def chain_state(events: DataFrame) -> DataFrame:
    """Adds prev_seq, prev_stored, seq_bad and link_bad.

    Rows flattened from documents bring the event before them along and need no shuffle. Other
    event tables use a window over one chain, which is one array of one document: a busy document
    splits over its arrays. Links compare with the stored hash, not a recomputed one.
    """
    if "prev_raw" in events.columns:
        prev_seq = F.try_variant_get("prev_raw", "$.seq", "bigint")
        prev_hash = F.try_variant_get("prev_raw", "$.hash", "string")
    else:
        w = Window.partitionBy(*GROUP).orderBy("event_ix")
        prev_seq, prev_hash = F.lag("seq").over(w), F.lag("hash").over(w)
    lagged = events.withColumn("prev_seq", F.coalesce(prev_seq, F.lit(0))).withColumn("prev_stored", prev_hash)
    return lagged.withColumn(
        "seq_bad", ~F.coalesce(F.col("seq") == F.col("prev_seq") + 1, F.lit(False))
    ).withColumn("link_bad", ~F.col("prev_hash").eqNullSafe(F.col("prev_stored")))


def chain_findings(events: DataFrame) -> DataFrame:
    """Stage 3: sequence numbers and links."""
    checks = F.filter(
        F.array(
            F.when(
                F.col("seq_bad"),
                F.struct(
                    F.when(F.col("seq").isNull(), "seq_not_integer").otherwise("seq_gap").alias("code"),
                    F.concat_ws(" ", F.lit("seq"), F.col("seq").cast("string"), F.lit("after"),
                                F.col("prev_seq").cast("string")).alias("detail"),
                ),
            ),
            F.when(
                F.col("link_bad"),
                F.struct(
                    F.lit("link_broken").alias("code"),
                    F.concat_ws(" ", F.lit("prevHash"), F.coalesce("prev_hash", F.lit("null")), F.lit("expected"),
                                F.coalesce("prev_stored", F.lit("null"))).alias("detail"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    return (
        chain_state(events)
        .where("seq_bad or link_bad")
        .withColumn("_f", F.explode_outer(checks))
        .select(*finding("3", F.col("_f.code"), event_where(), F.col("_f.detail")))
    )


def chain_breaks(events: DataFrame) -> DataFrame:
    """Per chain: events, breaks and the first bad position."""
    bad = F.col("seq_bad") | F.col("link_bad") | F.col("hash_bad")
    state = chain_state(events).withColumn(
        "hash_bad", ~F.col("hash").eqNullSafe(hashes.event_hash(F.col("raw")))
    )
    return state.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(bad).alias("breaks"),
        F.count_if("hash_bad").alias("hash_breaks"),
        F.min(F.when(bad, F.col("event_ix"))).cast("bigint").alias("first_bad_ix"),
    )


def build_chain(events: DataFrame, keys: list[str], ix: str, head: Column, tail: Column) -> DataFrame:
    """Hash every event over the one before it: adds prev_hash and hash.

    head and tail are the canonical text before and after the prevHash value. Hashing is sequential inside a chain by
    definition, so a task streams a chain in order and holds one batch of rows and the last hash, however long the chain is.
    Different chains run side by side.
    """
    layout = T.StructType([*events.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    lined = events.select("*", head.alias("_h"), tail.alias("_t")).repartition(*keys).sortWithinPartitions(*keys, ix)
    return lined.mapInArrow(_linker(keys), layout)


def _linker(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = None, None
        for batch in batches:
            before, after = [], []
            for key, h, t in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("_h").to_pylist(), batch.column("_t").to_pylist()):
                if key != chain:
                    chain, last = key, None
                before.append(last)
                quoted = "null" if last is None else f'"{last}"'
                last = "sha256:" + hashlib.sha256(f"{h}{quoted}{t}".encode()).hexdigest()
                after.append(last)
            kept = [c for c in batch.schema.names if c not in ("_h", "_t")]
            columns = [*[batch.column(c) for c in kept], pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "prev_hash", "hash"])

    return run


def tips(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Counts, latest event and latest lock event per document; order ends in document position.

    max_by is combined map-side: a document with a third of all events is no hot task.
    """
    latest = F.struct(F.col("sig.kid").alias("kid"), F.col("hash").alias("hash"))
    at = F.struct(F.coalesce("ts", F.lit("")), *[F.col(c) for c in order])
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("action") == "lock").alias("lock_events"),
        F.max_by(latest, at).alias("_tip"),
        F.max_by(F.col("sig.kid"), F.when(F.col("action") == "lock", at)).alias("last_lock_kid"),
    ).select(
        *keys, "events", "lock_events",
        F.coalesce("_tip.kid", F.lit("")).alias("kid"),
        F.coalesce(text.short_hash(F.col("_tip.hash")), F.lit("")).alias("chain_head"),
        F.coalesce("last_lock_kid", F.lit("")).alias("last_lock_kid"),
    )


def current_locks(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Targets whose last lock / unlock event is a lock."""
    at = F.struct(*order)
    return (
        events.where(F.col("action").isin("lock", "unlock"))
        .groupBy(*keys)
        .agg(F.max_by("action", at).alias("last_action"), F.max_by("ts", at).alias("since"))
        .where("last_action = 'lock'")
        .drop("last_action")
    )
