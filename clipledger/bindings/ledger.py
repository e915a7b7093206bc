"""Event log queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas, sinks
from clipledger.bindings import Registry, load
from clipledger.bindings.tables import (
    CHAIN_SQL, EV_SQL, KEYS_SQL, LOCK_SQL, STORED_SQL, chained, event_log, key_entries, lock_rows, numbered,
    revocation_lists, stored,
)
from clipledger.functions import hashes, paths, text
from clipledger.operators import conform, ingest, keys, ledger, locks, ordered, rollup
from clipledger.plans import audit as audit_plan
from clipledger.plans import export as export_plan
from clipledger.session import cut_lineage
from clipledger.sources import documents as doc_source

R = Registry()


def now() -> Column:
    """The fixed moment documents and log rows are dated."""
    return F.to_timestamp(F.lit("2024-02-01T00:00:00Z"))


@R.add("w02_chain_build", f"""
WITH RECURSIVE {CHAIN_SQL}
SELECT event_id, user_id, CAST(group_ix AS BIGINT) AS group_ix, CAST(seq AS BIGINT) AS seq, prev_hash, hash FROM chain""")
def chain_build(spark: SparkSession, sf: str) -> DataFrame:
    return chained(spark, sf).select(
        "event_id", "user_id", F.col("group_ix").cast("bigint").alias("group_ix"), "seq", "prev_hash", "hash"
    )


@R.add("w01_chain_continuity", f"""
WITH RECURSIVE {STORED_SQL}
SELECT event_id, seq_bad, link_bad FROM st WHERE seq_bad OR link_bad""")
def chain_continuity(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.chain_state(stored(spark, sf)).where("seq_bad or link_bad").select("event_id", "seq_bad", "link_bad")


@R.add("w03_chain_breaks", f"""
WITH RECURSIVE {STORED_SQL}
SELECT sidecar_path, CAST(group_ix AS BIGINT) AS group_ix, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (seq_bad OR link_bad OR s_hash <> r_hash) AS BIGINT) AS breaks,
  CAST(count(*) FILTER (s_hash <> r_hash) AS BIGINT) AS hash_breaks,
  CAST(min(event_ix) FILTER (seq_bad OR link_bad OR s_hash <> r_hash) AS BIGINT) AS first_bad_ix
FROM st GROUP BY sidecar_path, group_ix""")
def chain_breaks(spark: SparkSession, sf: str) -> DataFrame:
    out = ledger.chain_breaks(stored(spark, sf))
    return out.select(
        "sidecar_path", F.col("group_ix").cast("bigint").alias("group_ix"), "events", "breaks", "hash_breaks", "first_bad_ix"
    )


@R.add("p16_event_hash", f"""
WITH RECURSIVE {STORED_SQL}
SELECT event_id, r_hash AS recomputed, s_hash = r_hash AS matches FROM st""")
def event_hash(spark: SparkSession, sf: str) -> DataFrame:
    got = hashes.event_hash(F.col("raw"))
    return stored(spark, sf).select("event_id", got.alias("recomputed"), (F.col("hash") == got).alias("matches"))


@R.add("p06_short_hash", f"""
WITH RECURSIVE {CHAIN_SQL}
SELECT event_id, substr(regexp_replace(hash, '^[^:]*:', ''), 1, 12) AS short FROM chain""")
def short_hash(spark: SparkSession, sf: str) -> DataFrame:
    return chained(spark, sf).select("event_id", text.short_hash(F.col("hash")).alias("short"))


@R.add("p07_iso_times", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM events""")
def iso_times(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return log.select("event_id", F.col("ts").alias("iso"), F.unix_seconds(text.parse_iso(F.col("ts"))).alias("seconds"))


@R.add("p08_utc_day", f"""
SELECT strftime(ts, '%Y-%m-%d') AS day, '{schemas.ALE_FILE_PREFIX}' || strftime(ts, '%Y-%m-%d') || '.ale' AS file, CAST(count(*) AS BIGINT) AS events
FROM events GROUP BY 1, 2""")
def utc_day(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts_utc")
    return (
        event_log(spark, sf).groupBy(text.utc_day(at).cast("string").alias("day"), text.log_file_name(at).alias("file"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


@R.add("a01_event_counts", """
SELECT 'shows/u' || user_id || '.omc.json' AS sidecar_path, CAST(count(*) AS BIGINT) AS events,
  CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS locks
FROM events GROUP BY user_id""")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).groupBy("sidecar_path").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("action") == "lock").alias("locks")
    )


def _tips(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.tips(stored(spark, sf), ["sidecar_path"], ["seq", "group_ix", "event_ix"])


TIPS_SQL = (
    STORED_SQL
    + """,
tp AS (
  SELECT sidecar_path, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (action = 'lock') AS BIGINT) AS lock_events,
    arg_max({'kid': kid, 'hash': s_hash}, (ts, s_seq, group_ix, event_ix)) AS tip,
    arg_max(kid, (ts, s_seq, group_ix, event_ix)) FILTER (action = 'lock') AS last_lock_kid
  FROM st GROUP BY sidecar_path),
tips AS (
  SELECT sidecar_path, events, lock_events, tip.kid AS kid,
    substr(regexp_replace(tip.hash, '^[^:]*:', ''), 1, 12) AS chain_head, coalesce(last_lock_kid, '') AS last_lock_kid
  FROM tp)"""
)


@R.add("a02_tip_event", f"WITH RECURSIVE {TIPS_SQL} SELECT sidecar_path, kid, chain_head FROM tips")
def tip_event(spark: SparkSession, sf: str) -> DataFrame:
    return _tips(spark, sf).select("sidecar_path", "kid", "chain_head")


@R.add("a03_locked_by", f"""
WITH RECURSIVE {TIPS_SQL}, {LOCK_SQL},
n AS (SELECT sidecar_path, count(*) AS locks FROM lk GROUP BY sidecar_path)
SELECT tips.sidecar_path, CASE WHEN coalesce(n.locks, 0) > 0 THEN last_lock_kid ELSE '' END AS locked_by
FROM tips LEFT JOIN n USING (sidecar_path)""")
def locked_by(spark: SparkSession, sf: str) -> DataFrame:
    n = lock_rows(event_log(spark, sf)).groupBy("sidecar_path").agg(F.count(F.lit(1)).alias("locks"))
    joined = _tips(spark, sf).join(n, "sidecar_path", "left")
    return joined.select(
        "sidecar_path", F.when(F.coalesce("locks", F.lit(0)) > 0, F.col("last_lock_kid")).otherwise("").alias("locked_by")
    )


FLAT_SQL = (
    TIPS_SQL
    + ","
    + LOCK_SQL
    + """,
nl AS (SELECT sidecar_path, count(*) AS locks FROM lk GROUP BY sidecar_path),
flat AS (
  SELECT tips.sidecar_path, regexp_extract(tips.sidecar_path, '([^/]*)$', 1) AS shown, events, coalesce(nl.locks, 0) AS locks,
    kid, chain_head, CASE WHEN coalesce(nl.locks, 0) > 0 THEN last_lock_kid ELSE '' END AS locked_by,
    'U' || lpad(regexp_extract(tips.sidecar_path, '[0-9]+'), 6, '0') AS name
  FROM tips LEFT JOIN nl USING (sidecar_path))"""
)


def _flat(spark: SparkSession, sf: str, tape: str | None = None) -> DataFrame:
    n = lock_rows(event_log(spark, sf)).groupBy("sidecar_path").agg(F.count(F.lit(1)).alias("locks"))
    name = F.concat(F.lit("U"), F.lpad(F.regexp_extract("sidecar_path", "([0-9]+)", 1), 6, "0"))
    rows = _tips(spark, sf).join(n, "sidecar_path", "left").fillna({"locks": 0}).withColumn("name", name)
    return export_plan.flat_rows(rows, now(), F.lit(True), tape)


def _lower(df: DataFrame) -> DataFrame:
    """Column names in the short lower-case form of the result tables."""
    short = {c: c.split("_", 1)[1].lower() for c in schemas.EIGHT_FIELDS}
    return df.select(*[F.col(c).alias(short.get(c, c.lower())) for c in df.columns])


@R.add("p21_provenance_fields", f"""
WITH RECURSIVE {FLAT_SQL}
SELECT sidecar_path, 'true' AS signed, kid, CAST(events AS VARCHAR) AS events, CAST(locks AS VARCHAR) AS locks, locked_by AS lockedby,
  '2024-02-01T00:00:00Z' AS lastverified, shown AS sidecarpath, chain_head AS chainhead FROM flat""")
def provenance_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _lower(export_plan.fields(_flat(spark, sf)))


@R.add("p21_provenance_fields_short", f"""
WITH RECURSIVE {FLAT_SQL}
SELECT sidecar_path, 'true' AS signed, kid, CAST(events AS VARCHAR) AS events, locked_by AS lockedby,
  '2024-02-01T00:00:00Z' AS lastverified, chain_head AS chainhead FROM flat""")
def provenance_fields_short(spark: SparkSession, sf: str) -> DataFrame:
    return _lower(export_plan.fields(_flat(spark, sf), six=True))


ROW12_SQL = """
row12 AS (
  SELECT sidecar_path, name, regexp_extract(name, '^([A-Z][0-9]{3})', 1) AS tape, '01:00:00:00' AS start, '01:00:00:01' AS "end",
    'true' AS signed, kid, CAST(events AS VARCHAR) AS events, CAST(locks AS VARCHAR) AS locks, locked_by AS lockedby,
    '2024-02-01T00:00:00Z' AS lastverified, shown AS sidecarpath, chain_head AS chainhead
  FROM flat)"""


@R.add("p22_log_rows", f"WITH RECURSIVE {FLAT_SQL}, {ROW12_SQL} SELECT * FROM row12")
def log_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _lower(_flat(spark, sf).drop("day"))


@R.add("p22_log_rows_tape", f"WITH RECURSIVE {FLAT_SQL}, {ROW12_SQL} SELECT * REPLACE ('B002' AS tape) FROM row12")
def log_rows_tape(spark: SparkSession, sf: str) -> DataFrame:
    return _lower(_flat(spark, sf, tape="B002").drop("day"))


HEADER_SQL = ", ".join("'" + h.replace("\t", "' || chr(9) || '") + "'" for h in schemas.ALE_HEADER)
LINE_SQL = " || chr(9) || ".join(
    ["name", "tape", "start", '"end"', "signed", "kid", "events", "locks", "lockedby", "lastverified", "sidecarpath", "chainhead"]
)


@R.add("k02_log_lines", f"""
WITH RECURSIVE {FLAT_SQL}, {ROW12_SQL},
dy AS (SELECT sidecar_path, strftime(max(ts_utc), '%Y-%m-%d') AS day FROM ev GROUP BY 1)
SELECT day, CAST(i - 1 AS BIGINT) AS pos, ([{HEADER_SQL}])[i] AS line FROM (SELECT DISTINCT day FROM dy), range(1, {len(schemas.ALE_HEADER) + 1}) r(i)
UNION ALL SELECT day, CAST({len(schemas.ALE_HEADER)} AS BIGINT), {LINE_SQL} FROM row12 JOIN dy USING (sidecar_path)""")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    days = event_log(spark, sf).groupBy("sidecar_path").agg(text.utc_day(F.max("ts_utc")).cast("string").alias("day"))
    rows = _flat(spark, sf).drop("day").join(days, "sidecar_path").withColumn("arrival", F.col("sidecar_path"))
    return sinks.ale_lines(rows).select("day", "pos", "line")


def _changes(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return event_log(spark, sf).select(
        text.utc_day(F.col("ts_utc")).cast("string").alias("day"), "sidecar_path", "target", "value",
        F.struct("ts_utc", "event_id").alias("arrival"), "event_id", *more,
    )


@R.add("w05_keep_last", """
SELECT 'shows/u' || user_id || '.omc.json' AS sidecar_path, max(event_id) FILTER (rn = 1) AS event_id,
  max('urn:clip:k' || json_extract_string(props, '$.k')) FILTER (rn = 1) AS target
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) GROUP BY user_id""")
def keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.keep_last(_changes(spark, sf), ["sidecar_path"], ["arrival"]).select("sidecar_path", "event_id", "target")


@R.add("k05_upsert_log", """
WITH r AS (
  SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events),
hit AS (SELECT DISTINCT day FROM r WHERE event_type = 'error'),
k AS (SELECT *, row_number() OVER (PARTITION BY day, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM r WHERE day IN (SELECT day FROM hit))
SELECT day, 'shows/u' || user_id || '.omc.json' AS sidecar_path, event_id FROM k WHERE rn = 1""")
def upsert_log(spark: SparkSession, sf: str) -> DataFrame:
    kind = _changes(spark, sf, "action").withColumn("changed", F.lit(False))
    current, changed = kind.where("action <> 'unlock'").drop("action"), kind.where("action = 'unlock'").drop("action")
    return sinks.upsert_log(current, changed, ["sidecar_path"]).select("day", "sidecar_path", "event_id")


@R.add("w07_recent", """
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def recent(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.recent(event_log(spark, sf), [F.col("ts_utc").desc(), F.col("event_id").desc()], 100).select("event_id", "ts")


@R.add("w08_current_locks", """
WITH e AS (
  SELECT *, 'urn:clip:k' || json_extract_string(props, '$.k') AS target FROM events WHERE event_type IN ('purchase', 'error'))
SELECT 'shows/u' || user_id || '.omc.json' AS sidecar_path, target, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS since
FROM e GROUP BY user_id, target HAVING arg_max(event_type, (ts, event_id)) = 'purchase'""")
def current_locks(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.current_locks(event_log(spark, sf), ["sidecar_path", "target"], ["ts_utc", "event_id"])


def sightings(log: DataFrame) -> DataFrame:
    """Events as listings of one file per user, whose size changes with whole tens of value."""
    return log.select(
        F.col("sidecar_path").alias("path"), F.floor(F.col("value") / 10).cast("bigint").alias("length"),
        F.lit("2024-01-01T00:00:00Z").cast("timestamp").alias("mtime"), F.col("ts_utc").alias("observed_at"),
    )


SETTLED_SQL = """
o AS (SELECT 'shows/u' || user_id || '.omc.json' AS path, CAST(floor(value / 10) AS BIGINT) AS length, ts AS seen FROM events),
c AS (SELECT *, CASE WHEN lag(length) OVER w IS NULL OR lag(length) OVER w <> length THEN seen END AS started FROM o
  WINDOW w AS (PARTITION BY path ORDER BY seen)),
r AS (SELECT *, last_value(started IGNORE NULLS) OVER (PARTITION BY path ORDER BY seen) AS changed_at FROM c)
SELECT path, length, strftime(changed_at, '%Y-%m-%dT%H:%M:%S.%f') AS changed_at, strftime(min(seen), '%Y-%m-%dT%H:%M:%S.%f') AS settled_at
FROM r WHERE epoch_us(seen) - epoch_us(changed_at) >= 21600000000 GROUP BY path, length, changed_at"""


def micros(df: DataFrame) -> DataFrame:
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return df.select(
        "path", "length", F.date_format("changed_at", fmt).alias("changed_at"), F.date_format("settled_at", fmt).alias("settled_at")
    )


@R.add("w06_settle_gate", f"WITH {SETTLED_SQL}")
def settle_gate(spark: SparkSession, sf: str) -> DataFrame:
    return micros(rollup.settled(sightings(event_log(spark, sf)), 21_600, segment=86_400))


@R.add("a04_in_use", """
SELECT DISTINCT 'kid' AS kind, 'kid-' || user_id AS name FROM events
UNION ALL SELECT DISTINCT 'action', CASE event_type WHEN 'view' THEN 'update' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'lock'
  WHEN 'error' THEN 'unlock' WHEN 'click' THEN 'verify' END FROM events""")
def in_use(spark: SparkSession, sf: str) -> DataFrame:
    from clipledger.plans import health

    log = event_log(spark, sf)
    algs, kids = health.in_use(log.select(F.col("action").alias("alg")), log.withColumn("sig", F.struct("kid")))
    return kids.select(F.lit("kid").alias("kind"), F.col("kid").alias("name")).unionByName(
        algs.select(F.lit("action").alias("kind"), F.col("alg").alias("name"))
    )


@R.add("o06_unregistered", """
SELECT event_type AS alg, CAST(count(*) AS BIGINT) AS events FROM (
  SELECT CASE event_type WHEN 'view' THEN 'sha256' WHEN 'click' THEN 'md5' ELSE event_type END AS event_type FROM events)
WHERE event_type NOT IN ('md5', 'sha1', 'sha256', 'sha512', 'blake3', 'xxh64', 'xxh3', 'c4') GROUP BY 1""")
def unregistered(spark: SparkSession, sf: str) -> DataFrame:
    from clipledger.plans import health

    alg = F.when(F.col("role") == "view", "sha256").when(F.col("role") == "click", "md5").otherwise(F.col("role"))
    return health.unregistered(event_log(spark, sf).select(alg.alias("alg"))).groupBy("alg").agg(F.count(F.lit(1)).alias("events"))


def _stage34(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of the chain and key stages over the stored log."""
    # Two stages read the log; the chains behind it are built once.
    events = cut_lineage(stored(spark, sf))
    ring = keys.apply_revocations(
        doc_source.expand_keys(key_entries(spark, sf)), doc_source.revocation_rows(revocation_lists(spark, sf))
    )
    return ledger.chain_findings(events).unionByName(keys.key_findings(events, ring))


F34_SQL = (
    STORED_SQL
    + ","
    + KEYS_SQL
    + """,
k4 AS (
  SELECT st.*, CASE WHEN rk.kid IS NULL THEN 'unknown_kid' WHEN s_hash <> r_hash THEN 'hash_mismatch'
    WHEN strptime(ts, '%Y-%m-%dT%H:%M:%SZ') < valid_from THEN 'before_valid_from'
    WHEN strptime(ts, '%Y-%m-%dT%H:%M:%SZ') > valid_until THEN 'after_valid_until'
    WHEN strptime(ts, '%Y-%m-%dT%H:%M:%SZ') > revoked_at THEN 'after_revocation' ELSE 'unverified' END AS code
  FROM st LEFT JOIN rk ON rk.kid = st.kid),
f34 AS (
  SELECT sidecar_path, '3' AS stage, 'seq_gap' AS code FROM st WHERE seq_bad
  UNION ALL SELECT sidecar_path, '3', 'link_broken' FROM st WHERE link_bad
  UNION ALL SELECT sidecar_path, '4', code FROM k4 WHERE code IS NOT NULL)"""
)

STAGE_SQL = (
    F34_SQL
    + """,
sr AS (
  SELECT d.sidecar_path, s.stage, CASE WHEN count(f.code) FILTER (f.code <> 'unverified') > 0 THEN 'fail'
      WHEN count(f.code) > 0 THEN 'warn' ELSE 'pass' END AS status,
    CAST(count(f.code) FILTER (f.code <> 'unverified') AS BIGINT) AS errors,
    CAST(count(f.code) FILTER (f.code = 'unverified') AS BIGINT) AS warnings
  FROM (SELECT DISTINCT sidecar_path FROM lg) d CROSS JOIN (VALUES ('3'), ('4')) s(stage)
  LEFT JOIN f34 f ON f.sidecar_path = d.sidecar_path AND f.stage = s.stage GROUP BY 1, 2)"""
)


@R.add("a05_stage_results", f"WITH RECURSIVE {STAGE_SQL} SELECT * FROM sr")
def stage_results(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.stage_results(_stage34(spark, sf), event_log(spark, sf), ["3", "4"])


@R.add("a06_reports", f"""
WITH RECURSIVE {STAGE_SQL}
SELECT sidecar_path, CAST(sum(errors) AS BIGINT) AS errors,
  CASE WHEN sum(errors) = 0 THEN 'OK' ELSE 'FAIL (' || CAST(sum(errors) AS BIGINT) || ' error(s))' END AS summary
FROM sr GROUP BY sidecar_path""")
def reports(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.reports(stage_results(spark, sf)).select("sidecar_path", "errors", "summary")


@R.add("k04_report_json", f"""
WITH RECURSIVE {STAGE_SQL},
a AS (SELECT sidecar_path, max(CASE WHEN stage = '3' THEN errors END) AS e3, max(CASE WHEN stage = '4' THEN errors END) AS e4,
  max(CASE WHEN stage = '4' THEN warnings END) AS u4 FROM sr GROUP BY 1)
SELECT sidecar_path, '{{"target":"' || sidecar_path || '","stages":[{{"stage":"3","title":"event chain continuity","status":"'
  || CASE WHEN e3 > 0 THEN 'fail' ELSE 'pass' END || '","errors":' || e3
  || ',"warnings":0}},{{"stage":"4","title":"event hashes and key validity","status":"' || CASE WHEN e4 > 0 THEN 'fail' WHEN u4 > 0 THEN 'warn' ELSE 'pass' END
  || '","errors":' || e4 || ',"warnings":' || u4 || '}}],"errors":' || (e3 + e4) || ',"summary":"'
  || CASE WHEN e3 + e4 = 0 THEN 'OK' ELSE 'FAIL (' || (e3 + e4) || ' error(s))' END || '"}}' AS report FROM a""")
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.report_json(rollup.reports(stage_results(spark, sf)))


@R.add("k04_report_lines", f"""
WITH RECURSIVE {STAGE_SQL},
n AS (SELECT sidecar_path, stage, greatest(errors + warnings, 1) AS n_lines, errors + warnings = 0 AS ok FROM sr
  UNION ALL SELECT DISTINCT sidecar_path, '6', 1, false FROM sr)
SELECT sidecar_path, CASE WHEN strpos(sidecar_path, '/') = 0 THEN '' ELSE regexp_replace(sidecar_path, '/[^/]*$', '') END AS base_dir,
  stage, CAST(n_lines AS BIGINT) AS n_lines,
  CASE WHEN ok THEN 'OK' WHEN stage = '6' THEN 'not checked: no inventory' END AS said FROM n""")
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Read back from the JSON text of the reports."""
    told = rollup.stage_results(_stage34(spark, sf), event_log(spark, sf), ["3", "4", "6"], skipped={"6": "inventory"})
    made = rollup.report_json(rollup.reports(told).withColumn("base_dir", paths.dirname(F.col("sidecar_path"))))
    report = F.from_json("report", "base_dir string, stages array<struct<stage string, lines array<string>>>")
    one = made.select("sidecar_path", report.alias("r")).select("sidecar_path", "r.base_dir", F.explode("r.stages").alias("s"))
    first = F.col("s.lines")[0]
    return one.select(
        "sidecar_path", "base_dir", "s.stage", F.size("s.lines").cast("bigint").alias("n_lines"),
        F.when((first == "OK") | first.startswith("not checked"), first).alias("said"),
    )


QUARANTINE_SQL = (
    STAGE_SQL
    + """,
dq AS (
  SELECT sidecar_path, CAST(sum(errors) AS BIGINT) AS errors,
    coalesce(string_agg(CASE WHEN errors > 0 THEN 'stage ' || stage || ': ' || errors END, '; ' ORDER BY stage), '') AS reason
  FROM sr GROUP BY 1)"""
)


@R.add("k03_quarantine_split", f"""
WITH RECURSIVE {QUARANTINE_SQL}
SELECT sidecar_path, CASE WHEN errors > 0 THEN 'quarantined' ELSE 'signed' END AS status, reason FROM dq""")
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = event_log(spark, sf).select("sidecar_path").distinct()
    good, bad = sinks.split_quarantine(docs, cut_lineage(rollup.reports(stage_results(spark, sf))))
    return good.select("sidecar_path", F.lit("signed").alias("status"), F.lit("").alias("reason")).unionByName(
        bad.select("sidecar_path", F.lit("quarantined").alias("status"), "reason")
    )


@R.add("a07_fleet_tint", """
WITH w AS (
  SELECT user_id, max(CASE WHEN event_type = 'error' AND value > 50 THEN 2 WHEN event_type = 'error' THEN 1 ELSE 0 END) AS r,
    count(*) FILTER (event_type = 'purchase' AND value > 40) AS q FROM events GROUP BY user_id)
SELECT 'shows/u' || user_id || '.omc.json' AS sidecar_path, CASE r WHEN 2 THEN 'fail' WHEN 1 THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN r = 2 THEN 'red' WHEN r = 1 OR q > 0 THEN 'amber' ELSE 'green' END AS tint FROM w""")
def fleet_tint(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.col("role") == "error"
    log = event_log(spark, sf).withColumn(
        "status", F.when(bad & (F.col("value") > 50), "fail").when(bad, "warn").otherwise("pass")
    )
    held = log.groupBy("sidecar_path").agg(F.count_if((F.col("action") == "lock") & (F.col("value") > 40)).alias("_q"))
    top = rollup.top_status(log, ["sidecar_path"]).join(held, "sidecar_path")
    return top.select("sidecar_path", "status", rollup.tint(F.col("status"), F.col("_q")).alias("tint"))


@R.add("a08_run_counts", """
SELECT strftime(ts, '%Y-%m-%d') AS batch, event_type AS outcome, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2""")
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    return log.groupBy(text.utc_day(F.col("ts_utc")).cast("string").alias("batch"), F.col("role").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


@R.add("a11_quarantined", f"""
WITH RECURSIVE {QUARANTINE_SQL}
SELECT CAST(count(*) FILTER (errors > 0) AS BIGINT) AS quarantined, CAST(count(*) AS BIGINT) AS documents FROM dq""")
def quarantined(spark: SparkSession, sf: str) -> DataFrame:
    return quarantine_split(spark, sf).agg(
        F.count_if(F.col("status") == "quarantined").alias("quarantined"), F.count(F.lit(1)).alias("documents")
    )


@R.add("j05_lock_crosscheck", f"""
WITH {EV_SQL}, {LOCK_SQL},
fe AS (
  SELECT sidecar_path, target, actor_id, ts, arg_min(kid, seq_all) AS kid FROM lg WHERE action = 'lock' GROUP BY 1, 2, 3, 4)
SELECT lk.event_id, CASE WHEN fe.kid IS NULL THEN 'no_match' WHEN fe.kid <> lk.kid THEN 'kid_mismatch' END AS code
FROM lk LEFT JOIN fe ON fe.sidecar_path = lk.sidecar_path AND fe.target = lk.target AND fe.actor_id = lk."by" AND fe.ts = lk.at""")
def lock_crosscheck(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf)
    events = log.withColumn("actor", F.struct(F.col("actor_id").alias("id"))).withColumn("sig", F.struct("kid"))
    paired = locks.pair_locks(lock_rows(log), events, ["sidecar_path"], F.struct("ts_utc", "event_id"))
    return paired.select("event_id", "code")


@R.add("f04_kind_filter", """
SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY 1""")
def kind_filter(spark: SparkSession, sf: str) -> DataFrame:
    return event_log(spark, sf).where(F.col("role").isin("view", "click", "error")).groupBy(F.col("role").alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


@R.add("f06_event_rules", f"""
WITH RECURSIVE {STORED_SQL}
SELECT event_id, 'later_without_prevHash' AS code FROM st WHERE s_seq <> 1 AND prev_hash IS NULL
UNION ALL SELECT event_id, 'first_has_prevHash' FROM st WHERE s_seq = 1 AND prev_hash IS NOT NULL""")
def event_rules(spark: SparkSession, sf: str) -> DataFrame:
    return conform.broken_events(stored(spark, sf)).select("event_id", "code")


@R.add("j17_log_merge", """
WITH c AS (
  SELECT event_id, event_type AS name, CASE WHEN value > 10 THEN '' ELSE 'A' || lpad(CAST(user_id AS VARCHAR), 3, '0') END AS tape,
    strftime(ts, '%H:00:00:00') AS start FROM events),
bt AS (SELECT tape, start, max(event_id) AS hit FROM c WHERE tape <> '' GROUP BY 1, 2),
bn AS (SELECT name, max(event_id) AS hit FROM c WHERE tape = '' GROUP BY 1)
SELECT c.event_id, CASE WHEN c.tape = '' THEN bn.hit ELSE bt.hit END AS hit
FROM c LEFT JOIN bt ON bt.tape = c.tape AND bt.start = c.start LEFT JOIN bn ON bn.name = c.name""")
def log_merge(spark: SparkSession, sf: str) -> DataFrame:
    from clipledger.operators import matching

    user = F.lpad(F.col("user_id").cast("string"), 3, "0")
    clips = event_log(spark, sf).select(
        "event_id", F.col("role").alias("name"), F.when(F.col("value") > 10, "").otherwise(F.concat(F.lit("A"), user)).alias("tape"),
        F.date_format("ts_utc", "HH':00:00:00'").alias("start"),
    )
    log = clips.select("name", "tape", "start", F.col("event_id").alias("ix"), F.col("event_id").alias("hit"))
    return matching.merge_log(clips, log, "hit").select("event_id", "hit")


def ledger_documents(spark: SparkSession, sf: str, daily: bool = False) -> DataFrame:
    """One document per chain: the stored events of a user, or of a user's day, and the lock records that go with them."""
    ev = stored(spark, sf, daily)
    path = F.concat(
        F.lit("shows/u"), F.col("user_id").cast("string"), F.lit("/g"), F.lpad(F.col("group_ix").cast("string"), 6, "0"),
        F.lit(".omc.json"),
    )
    lock = F.when(
        F.col("action") == "lock",
        F.to_json(F.struct(
            F.col("target"), F.lit("entity").alias("scope"), F.col("actor.id").alias("by"),
            F.when(F.col("value") > 40, "2024-02-01T00:00:00Z").otherwise(F.col("ts")).alias("at"),
            F.struct(F.lit("ed25519").alias("alg"), F.when(F.col("value") < 1, "kid-other").otherwise(F.col("sig.kid")).alias("kid"),
                     F.lit("c2ln").alias("value")).alias("sig"),
        )),
    )
    chains = ev.groupBy(path.alias("sidecar_path")).agg(
        F.array_sort(F.collect_list(F.struct("event_ix", "raw_text"))).alias("e"),
        F.array_sort(F.collect_list(F.when(lock.isNotNull(), F.struct(F.col("event_ix"), lock.alias("l"))))).alias("k"),
    )

    def group(domain: str, items) -> Column:
        return F.concat(F.lit(f'{{"domain":"{domain}","value":['), F.array_join(items, ","), F.lit("]}"))

    body = F.concat(
        F.lit('{"Asset":[{"schemaVersion":"v2.8","entityType":"Asset","identifier":[],"assetFC":{"functionalProperties":{"customData":['),
        group(schemas.EVENT_DOMAIN, F.transform("e", lambda x: x["raw_text"])), F.lit(","),
        group(schemas.LOCK_DOMAIN, F.transform("k", lambda x: x["l"])), F.lit("]}}}]}"),
    )
    return doc_source.document_rows(chains.select("sidecar_path", body.alias("body")))


DOC_AUDIT_SQL = (
    STORED_SQL
    + ","
    + KEYS_SQL
    + """,
dl AS (SELECT *, 'shows/u' || user_id || '/g' || lpad(CAST(group_ix AS VARCHAR), 6, '0') || '.omc.json' AS doc FROM st),
fe AS (SELECT doc, target, actor_id, ts, arg_min(kid, event_ix) AS kid FROM dl WHERE action = 'lock' GROUP BY 1, 2, 3, 4),
fx AS (
  SELECT doc, '2' AS stage FROM dl WHERE s_seq <> 1 AND prev_hash IS NULL
  UNION ALL SELECT doc, '3' FROM dl WHERE seq_bad
  UNION ALL SELECT doc, '3' FROM dl WHERE link_bad
  UNION ALL SELECT doc, '4' FROM dl LEFT JOIN rk ON rk.kid = dl.kid
    WHERE rk.kid IS NULL OR s_hash <> r_hash OR coalesce(strptime(ts, '%Y-%m-%dT%H:%M:%SZ') < valid_from, false)
      OR coalesce(strptime(ts, '%Y-%m-%dT%H:%M:%SZ') > valid_until, false) OR coalesce(strptime(ts, '%Y-%m-%dT%H:%M:%SZ') > revoked_at, false)
  UNION ALL SELECT dl.doc, '5' FROM dl LEFT JOIN fe ON fe.doc = dl.doc AND fe.target = dl.target AND fe.actor_id = dl.actor_id
      AND fe.ts = CASE WHEN value > 40 THEN '2024-02-01T00:00:00Z' ELSE dl.ts END
    WHERE action = 'lock' AND (fe.kid IS NULL OR fe.kid <> CASE WHEN value < 1 THEN 'kid-other' ELSE dl.kid END))"""
)


def _document_audit(spark: SparkSession, sf: str, only: set[str] | None = None) -> audit_plan.Audit:
    ring = doc_source.expand_keys(key_entries(spark, sf))
    return audit_plan.audit(audit_plan.Inputs(
        ledger_documents(spark, sf), keyring=ring, revocations=doc_source.revocation_rows(revocation_lists(spark, sf)),
        only=only,
    ))


@R.add("g01_audit", f"""
WITH RECURSIVE {DOC_AUDIT_SQL}
SELECT d.doc AS sidecar_path, CAST(count(*) FILTER (f.stage = '2') AS BIGINT) AS payload, CAST(count(*) FILTER (f.stage = '3') AS BIGINT) AS chain,
  CAST(count(*) FILTER (f.stage = '4') AS BIGINT) AS keys, CAST(count(*) FILTER (f.stage = '5') AS BIGINT) AS locks,
  CASE WHEN count(f.stage) = 0 THEN 'OK' ELSE 'FAIL (' || count(f.stage) || ' error(s))' END AS summary
FROM (SELECT DISTINCT doc FROM dl) d LEFT JOIN fx f ON f.doc = d.doc GROUP BY d.doc""")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    rep = _document_audit(spark, sf).reports
    errors = lambda s: F.filter("stages", lambda x: x["stage"] == s)[0]["errors"]
    return rep.select(
        "sidecar_path", errors("2").alias("payload"), errors("3").alias("chain"), errors("4").alias("keys"),
        errors("5").alias("locks"), "summary",
    )


@R.add("p01_flatten", f"""
WITH RECURSIVE {STORED_SQL}
SELECT 'shows/u' || user_id || '/g' || lpad(CAST(group_ix AS VARCHAR), 6, '0') || '.omc.json' AS sidecar_path, s_seq AS seq, action, target,
  s_hash AS hash, kid FROM st""")
def flatten_events(spark: SparkSession, sf: str) -> DataFrame:
    from clipledger.operators import flatten

    groups = flatten.custom_data(ledger_documents(spark, sf))
    return flatten.events(groups).select("sidecar_path", "seq", "action", "target", "hash", F.col("sig.kid").alias("kid"))


@R.add("p02_domain_pivot", f"""
WITH {EV_SQL},
dy AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(ts_utc AS DATE)), 0) AS day FROM lg)
SELECT 'shows/u' || user_id || '/g' || lpad(CAST(day AS VARCHAR), 6, '0') || '.omc.json' AS sidecar_path,
  CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (action = 'lock') AS BIGINT) AS locks FROM dy GROUP BY 1""")
def domain_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One document per user and day, as many as the log has of them."""
    from clipledger.operators import flatten

    size = F.size(F.col("value").cast("array<variant>"))
    groups = flatten.custom_data(ledger_documents(spark, sf, daily=True))
    pick = lambda d: F.sum(F.when(F.col("domain") == d, size).otherwise(0)).cast("bigint")
    return groups.groupBy("sidecar_path").agg(
        pick(schemas.EVENT_DOMAIN).alias("events"), pick(schemas.LOCK_DOMAIN).alias("locks")
    )


@R.add("g05_export", f"""
WITH RECURSIVE {DOC_AUDIT_SQL},
t AS (
  SELECT doc, count(*) AS events, count(*) FILTER (action = 'lock') AS locks, arg_max({{'kid': kid, 'hash': s_hash}}, (ts, s_seq, event_ix)) AS tip,
    arg_max(kid, (ts, s_seq, event_ix)) FILTER (action = 'lock') AS lk FROM dl GROUP BY doc)
SELECT t.doc AS sidecar_path, regexp_extract(t.doc, '(g[0-9]+[.]omc)[.]json$', 1) AS name, 'false' AS signed,
  tip.kid AS kid, CAST(events AS VARCHAR) AS events, CAST(locks AS VARCHAR) AS locks, CASE WHEN locks > 0 THEN lk ELSE '' END AS lockedby,
  substr(regexp_replace(tip.hash, '^[^:]*:', ''), 1, 12) AS chainhead
FROM t""")
def export(spark: SparkSession, sf: str) -> DataFrame:
    """The rows come from the tables of the audit, of which only stage 4 is asked for."""
    rows = _lower(export_plan.export_audited(_document_audit(spark, sf, {"4"}), now()))
    return rows.select("sidecar_path", "name", "signed", "kid", "events", "locks", "lockedby", "chainhead")


@R.add("k01_documents", """
WITH c AS (
  SELECT event_id, 'vol/c' || event_id || CASE event_type WHEN 'view' THEN '.mov' WHEN 'click' THEN '.ari' ELSE '.R3D' END AS clip_path,
    md5(props) AS value FROM events),
h AS (SELECT *, sha256('|' || clip_path) AS idh FROM c),
n AS (SELECT *, 'urn:uuid:' || substr(idh, 1, 8) || '-' || substr(idh, 9, 4) || '-' || substr(idh, 13, 4) || '-' || substr(idh, 17, 4) || '-' || substr(idh, 21, 12) AS id FROM h)
SELECT 'c' || event_id || '.omc.json' AS sidecar_path, clip_path, 'sha256:' || sha256('{"action":"create","actor":{"id":"urn:service:ingest","role":"IngestService"},"prevHash":null,"seq":1,"target":"'
  || id || '","tool":{"name":"clipledger","version":"0.1"},"ts":"2024-02-01T00:00:00Z"}') AS chain_head FROM n""")
def documents(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    ext = F.when(F.col("event_type") == "view", ".mov").when(F.col("event_type") == "click", ".ari").otherwise(".R3D")
    clips = ev.select(
        F.concat(F.lit("vol/c"), F.col("event_id").cast("string"), ext).alias("clip_path"), F.lit("md5").alias("alg"),
        F.md5("props").alias("value"),
    )
    built = doc_source.document_rows(ingest.build_documents(clips, now()))
    from clipledger.operators import flatten

    # Read back from the document text: what is written is what counts.
    groups = flatten.custom_data(built)
    clip = flatten.artifacts(groups).where("role = 'clip-integrity'").select("sidecar_path", F.col("path").alias("clip_path"))
    head = flatten.events(groups).select("sidecar_path", hashes.event_hash(F.col("raw")).alias("chain_head"))
    return clip.join(head, "sidecar_path")


@R.add("p24_derived_ids", """
SELECT event_id, 'urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
FROM (SELECT event_id, sha256(props || chr(31) || event_type) AS h FROM events)""")
def derived_ids(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events")
    return ev.select("event_id", text.derived_id(F.col("props"), F.col("event_type")).alias("id"))


@R.add("p25_document_record", """
SELECT event_id, 'c' || event_id AS name, '2024-02-01T00:00:00Z' AS created_on, 'ingested from manifest, clip bytes not read' AS reason,
  'digital.movingImage' AS structural_type FROM events""")
def document_record(spark: SparkSession, sf: str) -> DataFrame:
    clips = load(spark, sf, "events").select(
        "event_id", F.concat(F.lit("vol/c"), F.col("event_id").cast("string"), F.lit(".mov")).alias("clip_path"),
        F.lit("md5").alias("alg"), F.md5("props").alias("value"),
    )
    body = doc_source.document_rows(ingest.build_documents(clips, now()))
    get = lambda p: F.try_variant_get("body", p, "string")
    return body.select(
        F.substring(get("$.Asset[0].identifier[1].identifierValue"), 2, 30).cast("bigint").alias("event_id"),
        get("$.Asset[0].name").alias("name"), get("$.Asset[0].provenance.createdOn").alias("created_on"),
        get("$.Asset[0].provenance.reason").alias("reason"), get("$.Asset[0].AssetSC.structuralType").alias("structural_type"),
    )
