"""Content queries: documents are file bytes, embeddings are colour numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger.bindings import Registry, load
from clipledger.functions import hashes, text
from clipledger.operators import colour, conform, integrity

R = Registry()


@R.add("p05_clean_cell", """
SELECT doc_id, md5(translate(text, chr(9) || chr(13) || chr(10), '   ')) AS cleaned, text <> translate(text, chr(9) || chr(13) || chr(10), '   ') AS changed
FROM documents""")
def clean_cell(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = text.clean_cell(F.col("text"))
    return load(spark, sf, "documents").select("doc_id", F.md5(cleaned).alias("cleaned"), (F.col("text") != cleaned).alias("changed"))


@R.add("p26_detail_cut", """
SELECT doc_id, CASE WHEN length(text) > 220 THEN substring(text, 1, 220) || ' […]' ELSE text END AS detail FROM documents""")
def detail_cut(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", text.clip_detail(F.col("text")).alias("detail"))


def _alg():
    return F.when(F.col("lang") == "en", "sha256").when(F.col("lang") == "de", "md5").when(F.col("lang") == "fr", "sha1").otherwise("sha512")


@R.add("a10_content_digest", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'sha256' WHEN 'de' THEN 'md5' WHEN 'fr' THEN 'sha1' ELSE 'blake3' END AS alg,
  CASE lang WHEN 'en' THEN sha256(text) WHEN 'de' THEN md5(text) WHEN 'fr' THEN sha1(text) END AS value,
  CASE WHEN lang IN ('en', 'de', 'fr') THEN 'ok' ELSE 'unsupported' END AS status FROM documents""")
def content_digest(spark: SparkSession, sf: str) -> DataFrame:
    alg = F.when(_alg() == "sha512", "blake3").otherwise(_alg())
    contents = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), alg.alias("alg"), F.col("text").alias("content")
    )
    return hashes.content_digests(contents).select(F.col("path").cast("bigint").alias("doc_id"), "alg", "value", "status")


@R.add("a10_content_digest_xx")
def content_digest_xx(spark: SparkSession, sf: str) -> DataFrame:
    """xxh64 / xxh3 with seed 0: no SQL engine at hand has them, checked against vectors in the tests."""
    alg = F.when(F.col("lang") == "en", "xxh64").otherwise("xxh3")
    contents = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"), alg.alias("alg"), F.col("text").alias("content")
    )
    return hashes.content_digests(contents).select(F.col("path").cast("bigint").alias("doc_id"), "alg", "value", "status")


OUTCOME_SQL = """
a AS (
  SELECT d.*, CASE WHEN source = 'web' THEN 'c4' WHEN lang = 'de' THEN 'md5' ELSE 'sha256' END AS alg,
    l.doc_id IS NOT NULL AND quality = 0 AS gone, n_chars > 3000 AS tampered, n_chars < 40 AS malformed
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id))"""


@R.add("j09_artifact_integrity", f"""
WITH {OUTCOME_SQL}
SELECT doc_id, CASE WHEN gone THEN 'missing' WHEN malformed THEN 'malformed' WHEN alg = 'c4' THEN 'unsupported'
  WHEN tampered THEN 'mismatch' ELSE 'ok' END AS outcome FROM a""")
def artifact_integrity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").withColumn("path", F.concat(F.lit("/d/"), F.col("doc_id").cast("string")))
    bad = load(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 0")
    here = docs.join(bad, "doc_id", "left_anti").select("path")
    alg = F.when(F.col("source") == "web", "c4").when(F.col("lang") == "de", "md5").otherwise("sha256")
    declared = F.when(F.col("n_chars") > 3000, F.concat(F.col("text"), F.lit("x"))).otherwise(F.col("text"))
    value = F.when(alg == "md5", F.md5(declared)).otherwise(F.sha2(declared, 256))
    arts = docs.select(
        F.col("doc_id").cast("string").alias("sidecar_path"), F.lit("p").alias("json_path"), F.lit(0).alias("group_ix"),
        F.lit(0).alias("artifact_ix"), F.lit("source-file").alias("kind"), "path", F.col("path").alias("resolved"), alg.alias("alg"),
        F.when(F.col("n_chars") >= 40, value).alias("value"),
    )
    asked = integrity.digest_requests(arts, here)
    contents = docs.select("path", F.col("text").alias("content")).join(asked, "path")
    out = integrity.artifact_outcomes(arts, here, hashes.content_digests(contents))
    return out.select(F.col("sidecar_path").cast("bigint").alias("doc_id"), "outcome")


@R.add("o04_already_processed", """
SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(d.text) FROM documents d JOIN labels l USING (doc_id)) GROUP BY text""")
def already_processed(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    done = docs.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("sha256")
    return docs.join(done, "sha256", "left_anti").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All numbers of each row."""
    e = load(spark, sf, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", v.alias("v"))


def _shifted(v, step: float):
    return F.transform(v, lambda x: x + F.lit(step))


@R.add("p20_colour_equality", """
WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
w AS (SELECT *, [x + CASE label % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 4e-6 ELSE 2e-5 END for x in v] AS w FROM v)
SELECT vec_id, len([1 for i in range(1, len(v) + 1) if abs(v[i] - w[i]) > 1e-5]) = 0 AS same FROM w""")
def colour_equality(spark: SparkSession, sf: str) -> DataFrame:
    step = F.when(F.col("label") % 3 == 0, 0.0).when(F.col("label") % 3 == 1, 4e-6).otherwise(2e-5)
    other = F.transform("v", lambda x: x + step)
    return _vectors(spark, sf).select("vec_id", colour.near(F.col("v"), other).alias("same"))


COLOUR_SQL = """
v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings),
l AS (
  SELECT label, vec_id // 4 AS amf, [x + CASE WHEN vec_id % 2 = 0 THEN 4e-6 ELSE 2e-5 END for x in v] AS w FROM v),
n AS (SELECT label, count(DISTINCT amf) AS pairs FROM l GROUP BY 1),
m AS (
  SELECT v.vec_id, count(DISTINCT l.amf) AS matches FROM v JOIN l USING (label)
  WHERE abs(v[1] - w[1]) <= 1e-5 AND abs(v[2] - w[2]) <= 1e-5 AND len([1 for i in range(1, len(v) + 1) if abs(v[i] - w[i]) > 1e-5]) = 0
  GROUP BY 1),
ag AS (
  SELECT label, vec_id, pairs, CAST(coalesce(matches, 0) AS BIGINT) AS matches, pairs - coalesce(matches, 0) AS warnings
  FROM v JOIN n USING (label) LEFT JOIN m USING (vec_id))"""


def _agreement(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    step = F.when(F.col("vec_id") % 2 == 0, 4e-6).otherwise(2e-5)
    looks = rows.select("label", F.expr("vec_id div 4").alias("path"), F.transform("v", lambda x: x + step).alias("v"))
    cdls = rows.select("label", F.col("vec_id").alias("path"), "v")
    return colour.agreement(cdls, looks, ["label"])


@R.add("j12_colour_agreement", f"""
WITH {COLOUR_SQL} SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(pairs AS BIGINT) AS pairs, matches, CAST(warnings AS BIGINT) AS warnings FROM ag""")
def colour_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(spark, sf).select(
        F.col("label").cast("bigint").alias("label"), F.col("path").alias("vec_id"), "pairs", "matches", "warnings"
    )


@R.add("a12_pair_statistics", f"""
WITH {COLOUR_SQL}
SELECT CAST(label AS BIGINT) AS label, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(warnings) AS BIGINT) AS warnings
FROM ag GROUP BY label""")
def pair_statistics(spark: SparkSession, sf: str) -> DataFrame:
    out = colour.pair_statistics(_agreement(spark, sf), ["label"])
    return out.withColumn("label", F.col("label").cast("bigint"))


@R.add("f06_artifact_rules", """
WITH a AS (
  SELECT doc_id, source, lang, n_chars FROM documents)
SELECT doc_id, 'pattern_id' AS code FROM a WHERE lang <> 'en'
UNION ALL SELECT doc_id, 'vocabulary_role' FROM a WHERE n_chars > 2000
UNION ALL SELECT doc_id, 'missing_kind' FROM a WHERE n_chars < 60
UNION ALL SELECT doc_id, 'missing_mhlEntry' FROM a WHERE n_chars < 60
UNION ALL SELECT doc_id, 'missing_subtype' FROM a WHERE n_chars < 60
UNION ALL SELECT doc_id, 'extra_key' FROM a WHERE lang = 'de'
UNION ALL SELECT doc_id, 'too_short_hash_value' FROM a WHERE lang = 'fr'""")
def artifact_rules(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents")
    scheme = F.when(F.col("lang") == "en", "urn:doc:").otherwise("doc ")
    part = lambda cond, yes, no="": F.when(cond, yes).otherwise(no)
    raw = F.concat(
        F.lit('{"id":"'), scheme, F.col("doc_id").cast("string"), F.lit('","role":"'),
        part(F.col("n_chars") > 2000, "poster", "framing"), F.lit('",'), part(F.col("n_chars") >= 60, '"kind":"asc-fdl",'),
        F.lit('"path":"./x.fdl",'), part(F.col("lang") == "de", '"note":1,'), F.lit('"hash":{"alg":"md5","value":"'),
        F.when(F.col("lang") == "fr", "00").otherwise(F.md5("text")), F.lit('"}}'),
    )
    return conform.broken_artifacts(d.select("doc_id", F.parse_json(raw).alias("raw"))).select("doc_id", "code")
