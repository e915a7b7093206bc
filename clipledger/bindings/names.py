"""Name queries over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.bindings import Registry, load
from clipledger.functions import text
from clipledger.operators import ingest, matching
from clipledger.plans import match as plan

R = Registry()


@R.add("p03_name_fallback", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN p_brand WHEN p_size < 20 THEN 'f' || p_partkey ELSE p_name END AS name FROM part""")
def name_fallback(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    asset = F.when(size < 10, "").when(size < 20, F.lit(None)).otherwise(F.col("p_name"))
    file_name = F.when(size < 10, "").otherwise(F.concat(F.lit("f"), F.col("p_partkey").cast("string")))
    return load(spark, sf, "part").select("p_partkey", text.first_name(asset, file_name, F.col("p_brand")).alias("name"))


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Small parts are documents that look for clips among the large parts.

    A document's name is all or part of a part name; its file base is another part of it.
    """
    p = load(spark, sf, "part")
    words = F.split("p_name", " ")
    name = F.when(F.col("p_size") < 6, F.col("p_name")).when(F.col("p_size") < 12, words[0]).when(
        F.col("p_size") < 18, F.concat("p_name", F.lit(" take2"))
    ).otherwise("")
    docs = p.where("p_size <= 25").select(F.col("p_partkey").alias("sidecar_ix"), name.alias("name"), words[1].alias("base"))
    clips = p.where("p_size > 25").select(F.col("p_partkey").alias("clip_ix"), F.col("p_name").alias("clip_name"))
    return docs, clips


SIDES_SQL = """
dc AS (
  SELECT p_partkey AS sidecar_ix, CASE WHEN p_size < 6 THEN p_name WHEN p_size < 12 THEN split_part(p_name, ' ', 1)
    WHEN p_size < 18 THEN p_name || ' take2' ELSE '' END AS name, split_part(p_name, ' ', 2) AS base FROM part WHERE p_size <= 25),
cn AS (SELECT DISTINCT p_name AS clip_name FROM part WHERE p_size > 25),
sc AS (
  SELECT DISTINCT name, base, clip_name, CASE WHEN name = clip_name THEN 100 WHEN name <> '' AND contains(clip_name, name) THEN 90
    WHEN name <> '' AND contains(name, clip_name) THEN 85 WHEN base <> '' AND contains(clip_name, base) THEN 80
    WHEN base <> '' AND contains(base, clip_name) THEN 75 ELSE 0 END AS score
  FROM (SELECT DISTINCT name, base FROM dc) d, cn)"""


@R.add("p19_name_scores", f"WITH {SIDES_SQL} SELECT name, base, clip_name, CAST(score AS BIGINT) AS score FROM sc WHERE score > 0")
def name_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs, clips = _sides(spark, sf)
    return matching.class_scores(docs.select("name", "base").distinct(), clips.select("clip_name").distinct())


def _greedy_sql(sides: str) -> str:
    """The plain loop over sides: one document after the other over the clips still free; m has the matches."""
    return f"""
{sides},
d AS (SELECT *, row_number() OVER (ORDER BY sidecar_ix) AS rn FROM dc),
w AS (
  SELECT sc.name, sc.base, p.p_partkey AS clip_ix, score FROM sc JOIN part p ON p.p_name = sc.clip_name AND p.p_size > 25 WHERE score >= 65),
r AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS sidecar_ix, CAST(NULL AS BIGINT) AS clip_ix, CAST(NULL AS BIGINT) AS score
  UNION ALL
  SELECT rn, CASE WHEN hit.clip_ix IS NULL THEN used ELSE list_append(used, hit.clip_ix) END, sidecar_ix, hit.clip_ix, CAST(hit.score AS BIGINT)
  FROM (
    SELECT d.rn, any_value(r.used) AS used, d.sidecar_ix,
      arg_max({{'clip_ix': w.clip_ix, 'score': w.score}}, (w.score, -w.clip_ix)) FILTER (w.clip_ix IS NOT NULL AND NOT list_contains(r.used, w.clip_ix)) AS hit
    FROM r JOIN d ON d.rn = r.rn + 1 LEFT JOIN w ON w.name = d.name AND w.base = d.base GROUP BY d.rn, d.sidecar_ix)),
m AS (SELECT sidecar_ix, clip_ix, score FROM r WHERE clip_ix IS NOT NULL)"""


@R.add("j14_fuzzy_match", f"WITH RECURSIVE {_greedy_sql(SIDES_SQL)} SELECT * FROM m")
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    docs, clips = _sides(spark, sf)
    return matching.assign(docs, clips)


NAMED_SIDES_SQL = SIDES_SQL.replace("ELSE '' END AS name", "ELSE split_part(p_name, ' ', 2) || '.omc' END AS name")
_EVENT = '{"action":"create","actor":{"id":"urn:user:p","role":"x"},"prevHash":null,"seq":1,"target":"urn:clip:'


@R.add("g06_match", f"""
WITH RECURSIVE {_greedy_sql(NAMED_SIDES_SQL)},
e AS (SELECT *, split_part(p_name, ' ', 2) AS base, sha256('{_EVENT}' || p_partkey || '"}}') AS hash FROM part)
SELECT m.sidecar_ix, m.clip_ix, m.score, 'false' AS signed, 'kid-' || e.p_brand AS kid, '1' AS events, '0' AS locks, '' AS lockedby,
  '2024-02-01T00:00:00Z' AS lastverified, e.base || '.omc.json' AS sidecarpath, substr(e.hash, 1, 12) AS chainhead
FROM m JOIN e ON e.p_partkey = m.sidecar_ix""")
def match_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Small parts as documents with one event each, matched to the large parts as clips; a document without a name goes by its file."""
    p = load(spark, sf, "part").where("p_size <= 25").withColumnRenamed("p_partkey", "sidecar_ix")
    docs, clips = _sides(spark, sf)
    event = F.concat(F.lit(_EVENT), F.col("sidecar_ix").cast("string"), F.lit('"'))
    signed = F.concat(
        event, F.lit(',"hash":"sha256:'), F.sha2(F.concat(event, F.lit("}")), 256), F.lit('","sig":{"alg":"ed25519","kid":"kid-'), F.col("p_brand"),
        F.lit('","value":"c2ln"}}'),
    )
    body = F.concat(
        F.lit('{"Asset":[{"name":"'), F.col("name"), F.lit('","assetFC":{"functionalProperties":{"customData":[{"domain":"'),
        F.lit(schemas.EVENT_DOMAIN), F.lit('","value":['), signed, F.lit("]}]}}}]}"),
    )
    rows = p.join(docs, "sidecar_ix").select(
        "sidecar_ix", F.concat(F.lit("/d/p"), F.col("sidecar_ix").cast("string"), F.lit("/"), F.col("base"), F.lit(".omc.json")).alias("sidecar_path"),
        body.alias("text"),
    ).withColumn("body", F.try_parse_json("text"))
    out = plan.match(rows, clips, F.to_timestamp(F.lit("2024-02-01T00:00:00Z")))
    short = {c: c.split("_", 1)[1].lower() for c in schemas.EIGHT_FIELDS}
    return out.select("sidecar_ix", "clip_ix", "score", *[F.col(c).alias(n) for c, n in short.items()])


@R.add("j02_side_files", """
WITH c AS (SELECT p_partkey, p_name AS stem FROM part),
a AS (SELECT p_name AS stem, min('/amf/' || p_brand || '/' || p_name || '.amf') AS amf_path FROM part WHERE p_size > 40 GROUP BY 1),
d AS (SELECT p_name AS stem, min('/cdl/' || p_brand || '/' || p_name || '.cdl') AS cdl_path FROM part WHERE p_size < 3 GROUP BY 1)
SELECT p_partkey, amf_path, cdl_path FROM c LEFT JOIN a USING (stem) LEFT JOIN d USING (stem)""")
def side_files(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    clips = p.select("p_partkey", F.col("p_name").alias("stem"))
    named = lambda kind: F.concat(F.lit(f"/{kind}/"), "p_brand", F.lit("/"), "p_name", F.lit(f".{kind}")).alias("path")
    aux = p.where("p_size > 40").select(named("amf")).unionByName(p.where("p_size < 3").select(named("cdl")))
    with_amf = ingest.attach_by_stem(clips, aux, "amf", "amf_path")
    return ingest.attach_by_stem(with_amf, aux, "cdl", "cdl_path").select("p_partkey", "amf_path", "cdl_path")
