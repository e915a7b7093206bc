"""Signing key queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.bindings import Registry, load
from clipledger.bindings.tables import KEYS_SQL, STORED_SQL, event_log, key_entries, revocation_lists, stored
from clipledger.functions import text
from clipledger.operators import conform, ingest, keys, rollup
from clipledger.plans import health
from clipledger.sources import documents as doc_source

R = Registry()
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """Keyring with revocations applied."""
    return keys.apply_revocations(
        doc_source.expand_keys(key_entries(spark, sf)), doc_source.revocation_rows(revocation_lists(spark, sf))
    )


def _shown(df: DataFrame) -> DataFrame:
    times = [c for c in ("valid_from", "valid_until", "revoked_at") if c in df.columns]
    for c in times:
        df = df.withColumn(c, text.iso_z(F.col(c)))
    return df


@R.add("s11_keyring", f"""
WITH {KEYS_SQL}
SELECT kid, public_key, strftime(valid_from, {ISO}) AS valid_from, strftime(valid_until, {ISO}) AS valid_until FROM kr""")
def keyring(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(doc_source.expand_keys(key_entries(spark, sf))).select("kid", "public_key", "valid_from", "valid_until")


@R.add("s12_revocations", """
SELECT 'kid-' || s_suppkey AS kid, CAST(0 AS BIGINT) AS ix, '2024-01-05T00:00:00Z' AS revoked_at, 'lost' AS reason FROM supplier WHERE s_acctbal < 3000
UNION ALL
SELECT 'kid-' || s_suppkey, 1, CASE WHEN s_acctbal >= 1000 THEN '2024-01-12T00:00:00Z' END, 'review' FROM supplier WHERE s_acctbal < 3000""")
def revocations(spark: SparkSession, sf: str) -> DataFrame:
    rows = _shown(doc_source.revocation_rows(revocation_lists(spark, sf)))
    return rows.select("kid", F.col("ix").cast("bigint").alias("ix"), "revoked_at", "reason")


@R.add("j07_revocation_override", f"""
WITH {KEYS_SQL}
SELECT kid, public_key, strftime(valid_from, {ISO}) AS valid_from, strftime(valid_until, {ISO}) AS valid_until,
  strftime(revoked_at, {ISO}) AS revoked_at, reason FROM rk""")
def revocation_override(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(ring(spark, sf)).select("kid", "public_key", "valid_from", "valid_until", "revoked_at", "reason")


@R.add("j06_event_keys", """
SELECT e.event_id, 'pk-' || s_suppkey AS public_key, s_suppkey IS NOT NULL AS key_known
FROM events e LEFT JOIN supplier ON s_suppkey = e.user_id""")
def event_keys(spark: SparkSession, sf: str) -> DataFrame:
    log = event_log(spark, sf).withColumn("sig", F.struct("kid"))
    return keys.with_keys(log, ring(spark, sf)).select("event_id", "public_key", "key_known")


@R.add("j08_key_validity", f"""
WITH RECURSIVE {STORED_SQL}, {KEYS_SQL}
SELECT event_id, CASE WHEN rk.kid IS NULL THEN 'unknown_kid' WHEN s_hash <> r_hash THEN 'hash_mismatch'
    WHEN strptime(ts, {ISO}) < valid_from THEN 'before_valid_from' WHEN strptime(ts, {ISO}) > valid_until THEN 'after_valid_until'
    WHEN strptime(ts, {ISO}) > revoked_at THEN 'after_revocation' END AS code
FROM st LEFT JOIN rk ON rk.kid = st.kid""")
def key_validity(spark: SparkSession, sf: str) -> DataFrame:
    return keys.key_state(stored(spark, sf), ring(spark, sf)).select("event_id", "code")


@R.add("f05_expiry_outlook", f"""
WITH {KEYS_SQL}
SELECT kid, CASE WHEN valid_until < TIMESTAMP '2024-01-20' THEN 'expired' ELSE 'expiring' END AS state FROM rk
WHERE revoked_at IS NULL AND valid_until IS NOT NULL AND valid_until < TIMESTAMP '2024-01-20' + INTERVAL 5 DAY""")
def expiry_outlook(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))
    return keys.expiring(ring(spark, sf), now, days=5).select("kid", "state")


@R.add("g08_expired_in_use", f"""
WITH {KEYS_SQL}
SELECT kid FROM rk WHERE valid_until < TIMESTAMP '2024-01-20' AND kid IN (SELECT 'kid-' || user_id FROM events)""")
def expired_in_use(spark: SparkSession, sf: str) -> DataFrame:
    now = F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))
    return health.expired_in_use(ring(spark, sf), event_log(spark, sf), now).select("kid")


@R.add("o05_keys_without_backend", """
SELECT 'kid-' || c_custkey AS kid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def keys_without_backend(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("kid-"), F.col(c).cast("string")).alias("kid")
    mapped = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(name("o_custkey"))
    return keys.without_backend(load(spark, sf, "customer").select(name("c_custkey")), mapped)


@R.add("f07_vocabulary", """
SELECT c_custkey, 'n' || c_nationkey AS value FROM customer
WHERE CASE WHEN c_acctbal < 0 THEN c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  ELSE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) END""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    values = load(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, "$.debtor").otherwise("$.nation").alias("where_"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("value")
    )
    fields = F.filter(
        F.array(F.when(F.col("n_regionkey") == 1, "$.debtor"), F.when(F.col("n_regionkey") != 2, "$.nation")), lambda x: x.isNotNull()
    )
    allowed = load(spark, sf, "nation").select(
        F.explode(fields).alias("where_"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("value")
    )
    return conform.outside_vocabulary(values, allowed).select("c_custkey", "value")


@R.add("j03_show_file", """
WITH f AS (SELECT n_regionkey, min('/fdl/' || n_name || '.fdl') AS fdl_path FROM nation GROUP BY 1)
SELECT c_custkey, fdl_path FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f USING (n_regionkey)""")
def show_file(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation")
    clips = load(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("show")
    )
    framing = nation.select(F.col("n_regionkey").alias("show"), F.concat(F.lit("/fdl/"), F.col("n_name"), F.lit(".fdl")).alias("path"))
    return ingest.attach_show_file(clips, framing, "show", "fdl_path").select("c_custkey", "fdl_path")


@R.add("j16_snapshot_drift", """
WITH a AS (SELECT p_partkey, sha256(p_brand || p_type) AS h FROM part WHERE p_size > 2),
b AS (SELECT p_partkey, sha256(CASE WHEN p_size > 40 THEN p_type ELSE p_brand || p_type END) AS h FROM part WHERE p_size < 48)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN b.h IS NULL THEN 'missing_published' WHEN a.h IS NULL THEN 'missing_local'
  WHEN a.h = b.h THEN 'ok' ELSE 'drift' END AS state FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def snapshot_drift(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    name = F.col("p_partkey").alias("name")
    both = F.concat("p_brand", "p_type")
    local = part.where("p_size > 2").select(name, F.sha2(both, 256).alias("sha256"))
    published = part.where("p_size < 48").select(name, F.sha2(F.when(F.col("p_size") > 40, F.col("p_type")).otherwise(both), 256).alias("sha256"))
    return rollup.snapshot_drift(local, published).withColumnRenamed("name", "p_partkey")


@R.add("p04_tape_id", """
SELECT s_suppkey, regexp_extract(chr(65 + s_nationkey) || substr(s_name, CASE WHEN s_acctbal > 0 THEN 10 ELSE 1 END), '^([A-Z][0-9]{3})', 1) AS tape
FROM supplier""")
def tape_id(spark: SparkSession, sf: str) -> DataFrame:
    start = F.when(F.col("s_acctbal") > 0, 10).otherwise(1)
    name = F.concat(F.chr(F.col("s_nationkey") + 65), F.substr("s_name", start))
    return load(spark, sf, "supplier").select("s_suppkey", text.tape_id(name).alias("tape"))


@R.add("g08_health", f"""
WITH {KEYS_SQL},
ol AS (SELECT kid, valid_until < TIMESTAMP '2024-01-20' AS gone FROM rk
  WHERE revoked_at IS NULL AND valid_until IS NOT NULL AND valid_until < TIMESTAMP '2024-01-20' + INTERVAL 30 DAY),
c AS (
  SELECT 'hash algorithms' AS title, 'fail' AS bad, CAST(0 AS BIGINT) AS "rows"
  UNION ALL SELECT 'keyring validity', 'fail', count(*) FROM rk
    WHERE valid_until < TIMESTAMP '2024-01-20' AND kid IN (SELECT 'kid-' || user_id FROM events)
  UNION ALL SELECT 'documents parse', 'fail', 0
  UNION ALL SELECT 'keys expired', 'fail', count(*) FROM ol WHERE gone
  UNION ALL SELECT 'keys expiring', 'warn', count(*) FROM ol WHERE NOT gone
  UNION ALL SELECT 'keyring present', 'present', count(*) FROM rk
  UNION ALL SELECT 'signing backends', 'fail', count(*) FROM rk WHERE kid NOT IN (SELECT 'kid-' || c_custkey FROM customer WHERE c_acctbal > 0))
SELECT title, CASE WHEN bad = 'present' THEN 'pass' WHEN "rows" = 0 THEN 'pass' ELSE bad END AS status, CAST("rows" AS BIGINT) AS "rows" FROM c""")
def run_health(spark: SparkSession, sf: str) -> DataFrame:
    from clipledger.bindings.ledger import ledger_documents

    backends = load(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("kid-"), F.col("c_custkey").cast("string")).alias("kid")
    )
    now = F.to_timestamp(F.lit("2024-01-20T00:00:00Z"))
    checks = health.health(health.Corpus(ledger_documents(spark, sf), ring(spark, sf), now, backends=backends))
    return checks.select("title", "status", "rows")


@R.add("f08_envelope", """
WITH s AS (
  SELECT *, '$.Asset[' || (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) || ']' AS place FROM supplier)
SELECT 'n' || s_nationkey AS sidecar_path, place || '.schemaVersion' AS place, 'missing' AS code FROM s WHERE s_acctbal < 0
UNION ALL SELECT 'n' || s_nationkey, place || '.name', 'wrong_type' FROM s WHERE s_acctbal > 9000
UNION ALL SELECT 'n' || s_nationkey, place || '.Asset[0].identifier', 'wrong_type' FROM s WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'n' || s_nationkey, place || '.Asset[0].Asset[0].identifier', 'missing' FROM s WHERE s_suppkey % 5 = 0""")
def envelope(spark: SparkSession, sf: str) -> DataFrame:
    """A document per nation with an asset per supplier; every fifth holds an asset that holds another, below the levels read at once."""
    from clipledger.operators import conform, flatten
    from clipledger.sources import documents

    inner = '"Asset":[{"schemaVersion":"v","entityType":"Asset","identifier":{},"Asset":[{"schemaVersion":"v","entityType":"Asset"}]}],'
    asset = F.concat(
        F.lit('{"entityType":"Asset","identifier":[],'), F.when(F.col("s_acctbal") < 0, "").otherwise('"schemaVersion":"v",'),
        F.when(F.col("s_suppkey") % 5 == 0, inner).otherwise(""), F.lit('"name":'), F.when(F.col("s_acctbal") > 9000, "7").otherwise('"s"'), F.lit("}"),
    )
    reels = load(spark, sf, "supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("sidecar_path")).agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", asset.alias("a")))).alias("s")
    )
    body = F.concat(F.lit('{"Asset":['), F.array_join(F.transform("s", lambda x: x["a"]), ","), F.lit("]}"))
    paths = [r[0] for r in conform.ENVELOPE_RULES]
    parsed = flatten.parse(documents.document_rows(reels.select("sidecar_path", body.alias("body"))), paths)
    found = conform.envelope_findings(parsed, flatten.cells(parsed, paths))
    return found.select("sidecar_path", F.col("where_").alias("place"), "code")
