"""Shared frames: an event ledger, keys and lock records derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.bindings import load
from clipledger.functions import text
from clipledger.operators import ledger, ordered

ACTIONS = {"view": "update", "signup": "create", "purchase": "lock", "error": "unlock", "click": "verify"}


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """events as rows of one log per user, unordered."""
    ev = load(spark, sf, "events")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])
    user = F.col("user_id").cast("string")
    at = F.col("ts").cast("timestamp")
    return ev.select(
        "event_id", "user_id", F.concat(F.lit("shows/u"), user, F.lit(".omc.json")).alias("sidecar_path"),
        at.alias("ts_utc"), text.iso_z(at).alias("ts"), action[F.col("event_type")].alias("action"),
        F.concat(F.lit("urn:user:u"), user).alias("actor_id"), F.col("event_type").alias("role"),
        F.concat(F.lit("urn:clip:k"), F.get_json_object("props", "$.k")).alias("target"),
        F.concat(F.lit("kid-"), user).alias("kid"), "value",
    )


def numbered(spark: SparkSession, sf: str, daily: bool = False) -> DataFrame:
    """The log with its order: one chain per user, however long, or one per user and UTC day; group_ix is then the day's number
    since 1970, 0 where an event has no time."""
    day = F.coalesce(F.unix_date(text.utc_day(F.col("ts_utc"))), F.lit(0)) if daily else F.lit(0)
    log = ordered.number_rows(
        event_log(spark, sf).withColumn("group_ix", day), ["user_id", "group_ix"], ordered.time_segment(F.col("ts_utc")), ["ts_utc", "event_id"], "seq"
    )
    return (
        log.withColumn("json_path", F.lit("Asset/0/assetFC/functionalProperties/customData"))
        .withColumn("event_ix", (F.col("seq") - 1).cast("int"))
    )


def _head(role: Column) -> Column:
    return F.concat(
        F.lit('{"action":"'), F.col("action"), F.lit('","actor":{"id":"'), F.col("actor_id"), F.lit('","role":"'), role,
        F.lit('"},"prevHash":'),
    )


def _tail(seq: Column) -> Column:
    return F.concat(
        F.lit(',"seq":'), seq.cast("string"), F.lit(',"target":"'), F.col("target"),
        F.lit('","tool":{"name":"app","version":"1"},"ts":"'), F.col("ts"), F.lit('"}'),
    )


def chained(spark: SparkSession, sf: str, daily: bool = False) -> DataFrame:
    """The log with prev_hash and hash of every event."""
    return ledger.build_chain(
        numbered(spark, sf, daily), ["user_id", "group_ix"], "event_ix", _head(F.col("role")), _tail(F.col("seq"))
    )


def stored(spark: SparkSession, sf: str, daily: bool = False) -> DataFrame:
    """The chained log as found on disk, with three kinds of damage.

    Large errors had their role rewritten, large clicks their hash, large signups their number.
    Columns are those of the event table, raw included.
    """
    ev = chained(spark, sf, daily)
    large = F.col("value") > 30
    role = F.when(large & (F.col("role") == "error"), "intruder").otherwise(F.col("role"))
    hash_ = F.when(
        large & (F.col("role") == "click"), F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256))
    ).otherwise(F.col("hash"))
    seq = F.when(large & (F.col("role") == "signup"), F.col("seq") + 90).otherwise(F.col("seq"))
    prev = F.coalesce(F.concat(F.lit('"'), F.col("prev_hash"), F.lit('"')), F.lit("null"))
    found = ev.withColumn("_role", role).withColumn("_hash", hash_).withColumn("_seq", seq)
    body = F.concat(_head(F.col("_role")), prev, F.regexp_replace(_tail(F.col("_seq")), r"\}$", ""))
    raw = F.concat(
        body, F.lit(',"hash":"'), F.col("_hash"), F.lit('","sig":{"alg":"ed25519","kid":"'), F.col("kid"),
        F.lit('","value":"c2ln"}}'),
    )
    return found.select(
        "user_id", "event_id", "sidecar_path", "json_path", "group_ix", "event_ix", F.col("_seq").alias("seq"), "ts",
        F.to_timestamp("ts").alias("ts_utc"), F.struct(F.col("actor_id").alias("id"), F.col("_role").alias("role")).alias("actor"),
        F.struct(F.lit("app").alias("name"), F.lit("1").alias("version")).alias("tool"), "action", "target", "prev_hash",
        F.col("_hash").alias("hash"),
        F.struct(F.lit("ed25519").alias("alg"), F.col("kid").alias("kid"), F.lit("c2ln").alias("value")).alias("sig"),
        F.parse_json(raw).alias("raw"), raw.alias("raw_text"), "value",
    )


def lock_rows(events: DataFrame) -> DataFrame:
    """One lock record per lock event; small ones carry another key, large ones another time."""
    kid = F.when(F.col("value") < 1, "kid-other").otherwise(F.col("kid"))
    at = F.when(F.col("value") > 40, "2024-02-01T00:00:00Z").otherwise(F.col("ts"))
    return events.where("action = 'lock'").select(
        "sidecar_path", "event_id", "target", F.lit("entity").alias("scope"), F.col("actor_id").alias("by"), at.alias("at"),
        F.struct(F.lit("ed25519").alias("alg"), kid.alias("kid"), F.lit("c2ln").alias("value")).alias("sig"),
    )


def key_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as keyring entries: rich ones in the bare form, others with a validity window."""
    s = load(spark, sf, "supplier")
    day = lambda base, n: F.date_format(F.date_add(F.lit(base).cast("date"), n), "yyyy-MM-dd'T00:00:00Z'")
    pub = F.concat(F.lit("pk-"), F.col("s_suppkey").cast("string"))
    full = F.concat(
        F.lit('{"publicKey":"'), pub, F.lit('","validFrom":"'), day("2023-12-25", F.col("s_nationkey")),
        F.lit('","validUntil":"'), day("2024-01-10", F.col("s_nationkey")), F.lit('"}'),
    )
    bare = F.concat(F.lit('"'), pub, F.lit('"'))
    return s.select(
        F.concat(F.lit("kid-"), F.col("s_suppkey").cast("string")).alias("kid"),
        F.when(F.col("s_acctbal") > 8000, bare).otherwise(full).alias("entry"), "s_suppkey", "s_nationkey", "s_acctbal",
    )


def revocation_lists(spark: SparkSession, sf: str) -> DataFrame:
    """One small list per supplier that is short of funds, the second entry overriding the first."""
    s = key_entries(spark, sf).where("s_acctbal < 3000")
    second = F.when(F.col("s_acctbal") < 1000, F.lit(None)).otherwise("2024-01-12T00:00:00Z")
    item = lambda at, why: F.struct(
        F.col("kid").alias("kid"), at.alias("revokedAt"), F.lit(why).alias("reason")
    )
    return s.select(F.array(item(F.lit("2024-01-05T00:00:00Z"), "lost"), item(second, "review")).alias("revocations"))


# --- the same frames in SQL ---------------------------------------------------------------
EV_SQL = """
ev AS (
  SELECT event_id, user_id, 'shows/u' || user_id || '.omc.json' AS sidecar_path, ts AS ts_utc,
    strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ts,
    CASE event_type WHEN 'view' THEN 'update' WHEN 'signup' THEN 'create' WHEN 'purchase' THEN 'lock'
      WHEN 'error' THEN 'unlock' WHEN 'click' THEN 'verify' END AS action,
    'urn:user:u' || user_id AS actor_id, event_type AS role,
    'urn:clip:k' || json_extract_string(props, '$.k') AS target, 'kid-' || user_id AS kid, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq_all, 0 AS group_ix,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events),
lg AS (
  SELECT *, seq - 1 AS event_ix,
    '{"action":"' || action || '","actor":{"id":"' || actor_id || '","role":"' AS h1, '"},"prevHash":' AS h2,
    ',"target":"' || target || '","tool":{"name":"app","version":"1"},"ts":"' || ts || '"}' AS t
  FROM ev)"""

CHAIN_SQL = (
    EV_SQL
    + """,
chain AS (
  SELECT event_id, user_id, group_ix, seq, CAST(NULL AS VARCHAR) AS prev_hash,
    'sha256:' || sha256(h1 || role || h2 || 'null,"seq":' || seq || t) AS hash
  FROM lg WHERE seq = 1
  UNION ALL
  SELECT lg.event_id, lg.user_id, lg.group_ix, lg.seq, c.hash,
    'sha256:' || sha256(h1 || role || h2 || '"' || c.hash || '","seq":' || lg.seq || t)
  FROM chain c JOIN lg ON lg.user_id = c.user_id AND lg.group_ix = c.group_ix AND lg.seq = c.seq + 1)"""
)

STORED_SQL = (
    CHAIN_SQL
    + """,
st0 AS (
  SELECT lg.*, chain.prev_hash, CASE WHEN value > 30 AND role = 'error' THEN 'intruder' ELSE role END AS s_role,
    CASE WHEN value > 30 AND role = 'click' THEN 'sha256:' || sha256(CAST(event_id AS VARCHAR)) ELSE chain.hash END AS s_hash,
    CASE WHEN value > 30 AND role = 'signup' THEN lg.seq + 90 ELSE lg.seq END AS s_seq
  FROM lg JOIN chain USING (event_id)),
st AS (
  SELECT *, 'sha256:' || sha256(h1 || s_role || h2 || coalesce('"' || prev_hash || '"', 'null') || ',"seq":' || s_seq || t) AS r_hash,
    s_seq <> coalesce(lag(s_seq) OVER w, 0) + 1 AS seq_bad,
    prev_hash IS DISTINCT FROM lag(s_hash) OVER w AS link_bad
  FROM st0 WINDOW w AS (PARTITION BY user_id, group_ix ORDER BY event_ix))"""
)

LOCK_SQL = """
lk AS (
  SELECT sidecar_path, event_id, target, actor_id AS "by",
    CASE WHEN value > 40 THEN '2024-02-01T00:00:00Z' ELSE ts END AS at,
    CASE WHEN value < 1 THEN 'kid-other' ELSE kid END AS kid
  FROM lg WHERE action = 'lock')"""

KEYS_SQL = """
kr AS (
  SELECT 'kid-' || s_suppkey AS kid, 'pk-' || s_suppkey AS public_key, s_acctbal,
    CASE WHEN s_acctbal > 8000 THEN NULL ELSE TIMESTAMP '2023-12-25' + to_days(s_nationkey) END AS valid_from,
    CASE WHEN s_acctbal > 8000 THEN NULL ELSE TIMESTAMP '2024-01-10' + to_days(s_nationkey) END AS valid_until
  FROM supplier),
rk AS (
  SELECT *, CASE WHEN s_acctbal >= 1000 AND s_acctbal < 3000 THEN TIMESTAMP '2024-01-12' END AS revoked_at,
    CASE WHEN s_acctbal < 3000 THEN 'review' END AS reason
  FROM kr)"""
