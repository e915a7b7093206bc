"""Watched tree as a stream of listings: settle, skip known content, build, audit, publish.

A file stream reports a file once and never again, so the input is an append-only table of
listings (path, length, mtime, observed_at), one row per file and poll. The checkpoint is the
resume point.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from clipledger import schemas, sinks
from clipledger.functions import files, paths
from clipledger.operators import ingest, rollup
from clipledger.plans import audit as audit_plan
from clipledger.plans import export as export_plan
from clipledger.session import STATE_STORE, cut_lineage
from clipledger.sources import documents as doc_source
from clipledger.sources import manifests as manifest_source

SETTLED = "path STRING, length BIGINT, mtime TIMESTAMP, changed_at TIMESTAMP, settled_at TIMESTAMP"
_STATE = "length BIGINT, mtime BIGINT, changed BIGINT, last BIGINT, fired BOOLEAN"


def observations(
    spark: SparkSession, folder: str, glob: str = "*.parquet", schema: str = schemas.FILE_OBS, max_files: int = 1000
) -> DataFrame:
    """Listings as a stream; max_files bounds a batch, and with it the polls one path can bring at once."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).parquet(folder)
    )


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, int]]:
    """(observed_at, length, mtime) of one path's listings in a batch, times in microseconds, oldest first.

    The chunks come in no order. What is held of a listing is 24 bytes, and a poll lists a path once."""

    def micros(col: pd.Series) -> np.ndarray:
        return col.to_numpy("datetime64[us]").astype("int64")

    held = [
        np.stack([micros(c["observed_at"]), c["length"].fillna(-1).to_numpy("int64"), micros(c["mtime"])]) for c in rows if len(c)
    ]
    if held:
        every = np.concatenate(held, axis=1)
        for i in np.argsort(every[0], kind="stable"):
            yield tuple(map(int, every[:, i]))


class Gate(StatefulProcessor):
    """Settle gate of one path: its version, when that was first and last seen, and whether it has passed.

    With an expiry a timer of the path runs out that long after its last listing, in event time, and drops its state."""

    def __init__(self, seconds: float, expire_seconds: float | None) -> None:
        self._need = int(seconds * 1_000_000)
        self._expire = None if expire_seconds is None else int(expire_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("version", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        length, mtime, changed, last, fired = self._state.get() if self._state.exists() else (None, None, None, None, False)
        out = []
        for seen, size, stamp in _in_order(rows):
            if last is not None and seen < last:
                continue  # an older listing that comes late says nothing of the file now
            last = seen
            if changed is None or (length, mtime) != (size, stamp):
                length, mtime, changed, fired = size, stamp, seen, False
            elif not fired and seen - changed >= self._need:
                fired = True
                out.append((key[0], length, *(pd.Timestamp(t, unit="us") for t in (mtime, changed, seen))))
        if last is not None:
            self._state.update((length, mtime, changed, last, fired))
            if self._expire is not None:
                for timer in list(self._handle.listTimers()):
                    self._handle.deleteTimer(timer)
                self._handle.registerTimer(last // 1000 + self._expire)
        if out:
            yield pd.DataFrame(out, columns=["path", "length", "mtime", "changed_at", "settled_at"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._state.clear()
        return iter(())

    def close(self) -> None:
        pass


def settle(obs: DataFrame, seconds: float, expire_seconds: float | None = None) -> DataFrame:
    """First sighting of each version that stood unchanged for the given seconds, as a stream.

    State is one small row per path, kept over batches and restarts. expire_seconds drops the state of paths not listed for that
    long (event time); a path that comes back then counts as new, and content dedup catches it. Listings more than that
    late are dropped. Sets the session's state store to RocksDB, which stateful processors need."""
    obs.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if expire_seconds is not None:
        obs = obs.withWatermark("observed_at", f"{math.ceil(expire_seconds)} seconds")
    return obs.groupBy("path").transformWithStateInPandas(
        Gate(seconds, expire_seconds), SETTLED, "Append", "None" if expire_seconds is None else "EventTime"
    )


def gate_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the settle gate remembers after the last batch of a checkpoint: path, length, changed_at, last_seen, fired; read with Spark's
    own state reader while no query runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = spark.read.format("statestore").option("stateVarName", "version").load(checkpoint)
    return rows.select(
        "key.path", "value.length", F.timestamp_micros("value.changed").alias("changed_at"), F.timestamp_micros("value.last").alias("last_seen"),
        "value.fired",
    )


def first_by_content(stream: DataFrame, sha: str = "manifest_sha256", keep_seconds: float | None = None, at: str = "observed_at") -> DataFrame:
    """Pass each content hash once, across batches and restarts; with keep_seconds it is forgotten that long (event time of the
    column at) after it was seen, so that state does not grow for ever."""
    if keep_seconds is None:
        return stream.dropDuplicates([sha])
    return stream.withWatermark(at, f"{math.ceil(keep_seconds)} seconds").dropDuplicatesWithinWatermark([sha])


def _read_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                with files.opened(path) as f:
                    data = f.read()
                rows.append((path, hashlib.sha256(data).hexdigest(), data.decode(), None))
            except (OSError, UnicodeDecodeError) as e:
                rows.append((path, None, None, type(e).__name__))
        yield pd.DataFrame(rows, columns=["manifest_path", "manifest_sha256", "text", "error"])


def manifest_texts(settled: DataFrame) -> DataFrame:
    """Settled manifest paths to their text and content hash, read where the task runs."""
    n = settled.sparkSession.sparkContext.defaultParallelism
    return settled.select("path").distinct().repartition(n, "path").mapInPandas(
        _read_texts, "manifest_path STRING, manifest_sha256 STRING, text STRING, error STRING"
    )


def bucket_of(buckets: int) -> Column:
    """Folder of a stem."""
    return F.pmod(F.xxhash64("stem"), F.lit(buckets)).cast("int").alias("bucket")


def known_versions(rows: DataFrame, published: DataFrame | None, buckets: int) -> DataFrame | None:
    """Published versions of the stems of rows. published is partitioned by bucket; only folders of these stems are read."""
    if published is None:
        return None
    held = [r[0] for r in rows.select(bucket_of(buckets)).distinct().collect()]  # at most as many as there are folders
    mine = published.where(F.col("bucket").isin(held)).join(rows.select("stem").distinct(), "stem", "left_semi")
    return mine.select("stem", "alg", "value", "arrival")


def with_names(published: DataFrame) -> DataFrame:
    """Adds name: a stem with more than one hash suffixes every version, the older ones too. Names are a view, so a version that
    comes later renames the earlier one without a rewrite. published has one row per stem and hash."""
    versions = published.groupBy("stem").agg(F.count(F.lit(1)).alias("_versions"))
    name = ingest.published_name(F.col("stem"), F.col("value"), F.col("_versions"))
    return published.join(versions, "stem").withColumn("name", name).drop("_versions")


@dataclass
class Watch:
    """Continuous ingest into tables below out.

    Every write of a batch goes to a folder of its attempt; the commit row, written last, makes the attempt count. A batch that
    dies and is done again leaves one set of rows, its rejects included, and one that was committed is not done again.
    Tables: processed, rejects, arrivals, judged (documents and quarantine), stats, log, commits, logged."""

    out: str
    inventory: object  # () -> DataFrame of path, length; called per batch, so new media are seen
    stable_seconds: float = 3.0
    who: ingest.Identity = field(default_factory=ingest.Identity)
    kid: str | None = None
    signer: object = None
    keyring: DataFrame | None = None
    audit_each: bool = True
    audit_files: bool = False  # the audit looks at the inventory and trusts the batch's manifests
    base_dir: str | None = None
    log_rows: bool = True
    expire_seconds: float | None = None
    buckets: int = 16  # folders the documents are dealt to by stem, so that a batch reads those of its own stems

    def _read(self, spark: SparkSession, name: str) -> DataFrame | None:
        """Rows of a table, those of attempts that never finished included; None before the first write."""
        try:
            return spark.read.parquet(f"{self.out}/{name}")
        except AnalysisException:
            return None

    def table(self, spark: SparkSession, name: str) -> DataFrame | None:
        """Rows of finished batches, or None before the first. documents and quarantine are the two parts of judged,
        emissions what both say of time and status."""
        commits = self._read(spark, "commits")
        rows = self._read(spark, "judged" if name in ("documents", "quarantine", "emissions") else name)
        if rows is None or commits is None:
            return None
        rows = rows.join(commits.select("attempt"), "attempt", "left_semi")
        if name in ("documents", "quarantine"):
            return rows.where(F.col("status") == ("signed" if name == "documents" else "quarantined"))
        if name == "emissions":
            return rows.select(F.col("stem").alias("clip"), "sidecar_path", "at", "status", "batch_id")
        return rows

    def documents(self, spark: SparkSession) -> DataFrame | None:
        """Documents under the names they have now: of a stem with more than one hash every document, the older ones too, carries
        the first characters of its hash."""
        rows = self.table(spark, "documents")
        if rows is None:
            return None
        named = with_names(rows)
        return named.withColumn("sidecar_path", F.concat(F.lit(self.out + "/"), F.col("name"))).drop("name")

    def _write(self, df: DataFrame, name: str, batch: int, attempt: str, by: tuple[str, ...] = ()) -> None:
        (
            df.withColumns({"batch_id": F.lit(batch), "attempt": F.lit(attempt)}).write.mode("append")
            .partitionBy(*by, "attempt").parquet(f"{self.out}/{name}")
        )

    def process(self, settled: DataFrame, batch: int) -> None:
        """One micro-batch. A bad manifest is a reject row, never a failed batch."""
        spark = settled.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        commits = self._read(spark, "commits")
        if commits is not None and not commits.where((F.col("run") == run) & (F.col("batch_id") == batch)).isEmpty():
            return
        attempt = f"a{uuid.uuid4().hex}"
        counts = {name: Observation() for name in ("processed", "arrivals", "judged", "rejects")}
        texts = cut_lineage(manifest_texts(settled.where(paths.extension(F.col("path")).isin("mhl", "ascmhl"))))
        fresh = texts.where("error is null").groupBy("manifest_sha256").agg(
            F.min_by(F.struct("manifest_path", "text"), "manifest_path").alias("m")
        ).select("manifest_sha256", "m.*")
        done = self.table(spark, "processed")
        if done is not None:
            fresh = fresh.join(done.select("manifest_sha256"), "manifest_sha256", "left_anti")
        fresh = cut_lineage(fresh)
        rows, rejects = manifest_source.rows_from_texts(fresh)
        unread = texts.where("error is not null").select("manifest_path", F.col("error").alias("code"))

        now = F.current_timestamp()
        inventory = self.inventory()
        outcomes = ingest.entry_outcomes(rows, inventory)
        built = ingest.build_documents(
            outcomes.where("outcome = 'ok'"), now, self.who, self.kid, self.signer, self.base_dir
        ).withColumn("stem", paths.stem(F.col("clip_path"))).withColumn(
            "arrival", F.struct(F.lit(batch).cast("bigint").alias("batch"), F.col("clip_path").alias("path"))
        )
        built = cut_lineage(built)
        resolved = cut_lineage(ingest.resolve_collisions(built, known_versions(built, self.table(spark, "documents"), self.buckets)))
        bodies = built.groupBy("stem", "alg", "value").agg(
            F.min_by(F.struct("clip_path", "body", "chain_head"), "arrival").alias("b")
        ).select("stem", "alg", "value", "b.*")
        docs = cut_lineage(
            resolved.where("outcome <> 'refresh'").join(bodies, ["stem", "alg", "value"]).select(
                F.concat(F.lit(self.out + "/"), F.col("name")).alias("sidecar_path"), "stem", "clip_path", "alg", "value", "body",
                "outcome", "arrival",
            )
        )
        judged = docs.join(self._verdicts(docs, rows, rejects, inventory), "sidecar_path").select(
            *docs.columns, "errors", "reason", now.alias("at"), bucket_of(self.buckets),
            F.when(F.col("errors") > 0, "quarantined").otherwise("signed").alias("status"),
        )
        n = F.count(F.lit(1))
        again = F.when(F.col("outcome") == "refresh", F.col("copies")).otherwise(F.col("copies") - 1)
        self._write(
            judged.observe(counts["judged"], n.alias("documents"), F.count_if(F.col("errors") == 0).alias("ok"),
                           F.count_if(F.col("errors") > 0).alias("quarantined")),
            "judged", batch, attempt, ("status", "bucket"),
        )
        arrivals = resolved.where("copies > 0")
        self._write(
            arrivals.observe(counts["arrivals"], F.sum(again).alias("refreshed"), F.count_if(F.col("outcome") == "conflict").alias("conflicts")),
            "arrivals", batch, attempt,
        )
        self._write(rejects.unionByName(unread).observe(counts["rejects"], n.alias("errors")), "rejects", batch, attempt)
        self._write(
            fresh.select("manifest_sha256", "manifest_path").observe(counts["processed"], n.alias("manifests")), "processed", batch, attempt
        )
        self._write(run_counts(spark, counts.values()), "stats", batch, attempt)
        # Last: what was written before counts from here on.
        spark.createDataFrame([(run, batch, attempt)], "run string, batch_id int, attempt string").coalesce(1).write.mode("append").parquet(
            f"{self.out}/commits"
        )
        if self.log_rows:
            self._log(spark)

    def _verdicts(self, docs: DataFrame, rows: DataFrame, rejects: DataFrame, inventory: DataFrame) -> DataFrame:
        """sidecar_path, errors and reason of every document."""
        good = docs.select("sidecar_path", F.lit(0).cast("bigint").alias("errors"), F.lit("").alias("reason"))
        if not self.audit_each:
            return good
        inputs = audit_plan.Inputs(doc_source.document_rows(docs), keyring=self.keyring, base_dir=self.base_dir)
        if self.audit_files:
            inputs = dataclasses.replace(inputs, inventory=inventory, manifest=rows, manifest_rejects=rejects, trust_manifest=True)
        passed, bad = sinks.split_quarantine(docs.select("sidecar_path"), audit_plan.audit(inputs).reports)
        return good.join(passed, "sidecar_path", "left_semi").unionByName(bad.select("sidecar_path", "errors", "reason"))

    def _log(self, spark: SparkSession) -> None:
        """The flat log is a derived view: its failure does not stop the batch, and the next one makes up for it."""
        try:
            self.catch_up_log(spark)
        except Exception as e:  # noqa: BLE001
            print(f"clipledger: log rows not written yet: {type(e).__name__}: {e}")

    def catch_up_log(self, spark: SparkSession) -> None:
        """Log rows of every finished batch that has none."""
        todo, done = self._read(spark, "commits").select("attempt", "batch_id"), self._read(spark, "logged")
        if done is not None:
            todo = todo.join(done.select("attempt"), "attempt", "left_anti")
        todo = cut_lineage(todo)
        if todo.isEmpty():
            return
        docs = self._read(spark, "judged")
        attempt = f"l{uuid.uuid4().hex}"
        if docs is not None:
            mine = cut_lineage(docs.where("status = 'signed'").drop("batch_id").join(todo, "attempt"))
            rows = export_plan.export(doc_source.document_rows(mine), F.current_timestamp(), base_dir=self.out)
            placed = rows.join(mine.select("sidecar_path", F.col("batch_id").alias("arrival")), "sidecar_path")
            placed.withColumn("attempt", F.lit(attempt)).write.mode("append").partitionBy("attempt").parquet(f"{self.out}/log")
        todo.withColumn("log_attempt", F.lit(attempt)).coalesce(1).write.mode("append").parquet(f"{self.out}/logged")

    def log_table(self, spark: SparkSession) -> DataFrame:
        """Flat log, last row per day and document."""
        good = self._read(spark, "logged").select(F.col("log_attempt").alias("attempt")).distinct()
        rows = self._read(spark, "log").join(good, "attempt", "left_semi").drop("attempt")
        return rollup.keep_last(rows, ["day", schemas.ALE_KEY], ["arrival"])

    def start(self, obs: DataFrame, checkpoint: str, **trigger):
        """Start the stream; trigger as in DataStreamWriter.trigger, default availableNow."""
        return (
            settle(obs, self.stable_seconds, self.expire_seconds).writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


#: What a batch counts, in the order it is shown.
OUTCOMES = ["manifests", "documents", "refreshed", "conflicts", "ok", "quarantined", "errors"]


def run_counts(spark: SparkSession, observed: Iterable[Observation]) -> DataFrame:
    """(outcome, n) rows of what was observed in the writes themselves; no table is read again."""
    found = {name: value for o in observed for name, value in o.get.items()}
    return spark.createDataFrame([(name, int(found[name] or 0)) for name in OUTCOMES if name in found], "outcome string, n bigint")


def recent_emissions(emissions: DataFrame, n: int = 100) -> DataFrame:
    """Newest emissions first."""
    return rollup.recent(emissions, [F.col("at").desc(), F.col("sidecar_path").desc()], n)


def run_to_table(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Drain a stream into a parquet table and return it."""
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
