"""Manifest and integrity queries: lineitem rows are manifest entries, orders the media inventory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.bindings import Registry, load
from clipledger.functions import hashes
from clipledger.operators import ingest, integrity
from clipledger.session import checkpoint_dir
from clipledger.streaming import watch

R = Registry()
#: Folders the versions of u04 are dealt to by stem.
BUCKETS = 8

# Wide entries as a manifest holds them: a column per tag, '' for an empty one, null for an absent one.
TAGS = ["md5", "sha1", "sha256", "xxhash64be", "c4", "crc32"]


def wide(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    ext = F.when(F.col("l_linenumber") == 7, ".txt").otherwise(".mov")
    price = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return li.select(
        F.concat(F.lit("/offload/s"), supp, F.lit("/roll.mhl")).alias("manifest_path"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), ext).alias("file"),
        F.struct(F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").alias("part"), price.alias("price")).alias("entry_ix"),
        "l_orderkey", "l_returnflag", "l_linestatus",
        F.when(F.col("l_tax") < 0.05, F.md5(part)).alias("md5"),
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", F.sha1(part)).alias("sha1"),
        F.when(F.col("l_linestatus") == "O", F.sha2(part, 256)).alias("sha256"),
        F.substring(F.md5(supp), 1, 16).alias("xxhash64be"),
        F.when(F.col("l_discount") > 0.08, F.concat(F.lit("c4"), part)).alias("c4"),
        supp.alias("crc32"),
    )


WIDE_SQL = """
wd AS (
  SELECT '/offload/s' || l_suppkey || '/roll.mhl' AS manifest_path, 'o' || l_orderkey || CASE WHEN l_linenumber = 7 THEN '.txt' ELSE '.mov' END AS file,
    CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_orderkey, l_returnflag, l_linestatus,
    CASE WHEN l_tax < 0.05 THEN md5(CAST(l_partkey AS VARCHAR)) END AS md5,
    CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN sha1(CAST(l_partkey AS VARCHAR)) END AS sha1,
    CASE WHEN l_linestatus = 'O' THEN sha256(CAST(l_partkey AS VARCHAR)) END AS sha256,
    substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 16) AS xxh64, CASE WHEN l_discount > 0.08 THEN 'c4' || l_partkey END AS c4
  FROM lineitem)"""


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.gather_tags(wide(spark, sf), TAGS)


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("manifest_path", "file", "entry_ix.line", "entry_ix.part", "entry_ix.price", *cols)


@R.add("p15_algorithm_names", f"""
WITH {WIDE_SQL}, l AS (UNPIVOT wd ON md5, sha1, sha256, xxh64, c4 INTO NAME alg VALUE value)
SELECT alg, l_returnflag, CAST(count(*) AS BIGINT) AS entries, CAST(count(DISTINCT value) AS BIGINT) AS hashes FROM l GROUP BY 1, 2""")
def algorithm_names(spark: SparkSession, sf: str) -> DataFrame:
    long = entries(spark, sf).select("l_returnflag", F.explode("hashes").alias("alg", "value")).where("value is not null")
    return long.groupBy("alg", "l_returnflag").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("value").alias("hashes")
    )


@R.add("p13_strongest_hash", f"""
WITH {WIDE_SQL}
SELECT manifest_path, file, line, part, price,
  CASE WHEN sha256 <> '' THEN 'sha256' WHEN c4 <> '' THEN 'c4' WHEN sha1 <> '' THEN 'sha1' ELSE 'xxh64' END AS alg,
  CASE WHEN sha256 <> '' THEN sha256 WHEN c4 <> '' THEN c4 WHEN sha1 <> '' THEN sha1 ELSE xxh64 END AS value FROM wd""")
def strongest_hash(spark: SparkSession, sf: str) -> DataFrame:
    alg, value = hashes.pick(F.col("hashes"), schemas.STRONG_FIRST, skip_empty=True)
    return _flat(entries(spark, sf), alg.alias("alg"), value.alias("value"))


@R.add("p14_registry_hash", f"""
WITH {WIDE_SQL}
SELECT manifest_path, file, line, part, price,
  CASE WHEN md5 IS NOT NULL THEN 'md5' WHEN sha1 IS NOT NULL THEN 'sha1' WHEN sha256 IS NOT NULL THEN 'sha256' ELSE 'xxh64' END AS alg,
  coalesce(md5, sha1, sha256, xxh64) AS value FROM wd""")
def registry_hash(spark: SparkSession, sf: str) -> DataFrame:
    alg, value = hashes.pick(F.col("hashes"), schemas.REGISTRY_ORDER, skip_empty=False)
    return _flat(entries(spark, sf), alg.alias("alg"), value.alias("value"))


@R.add("w04_first_entry", f"""
WITH {WIDE_SQL}, x AS (SELECT *, min({{'line': line, 'part': part, 'price': price}}) OVER (PARTITION BY manifest_path, file) AS m FROM wd)
SELECT DISTINCT manifest_path, file, m.line AS line, m.part AS part, m.price AS price FROM x""")
def first_entry(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(integrity.first_entries(entries(spark, sf)))


def media(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are not pending are the files that exist."""
    return load(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".mov")).alias("path"),
        F.round("o_totalprice").cast("bigint").alias("length"),
    )


@R.add("f02_missing_clips", """
SELECT l_returnflag, CAST(count(*) FILTER (o.o_orderkey IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (o.o_orderkey IS NOT NULL) AS BIGINT) AS present
FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') o ON o_orderkey = l_orderkey GROUP BY 1""")
def missing_clips(spark: SparkSession, sf: str) -> DataFrame:
    """The flag rides in the manifest's name; every entry is a clip with a hash, so only the inventory decides."""
    rows = load(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("manifest_path"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit(".mov")).alias("file"),
        F.lit(0).alias("entry_ix"), F.lit("").alias("manifest_sha256"), F.create_map(F.lit("md5"), F.lit("00")).alias("hashes"),
    )
    found = ingest.entry_outcomes(rows, media(spark, sf), root_join=False)
    return found.groupBy(F.col("manifest_path").alias("l_returnflag")).agg(
        F.count_if(F.col("outcome") == "missing_clip").alias("missing"), F.count_if(F.col("outcome") == "ok").alias("present")
    )


@R.add("f03_no_usable_hash", f"""
WITH {WIDE_SQL}
SELECT manifest_path, CAST(count(*) AS BIGINT) AS dropped FROM wd WHERE coalesce(md5, '') = '' AND coalesce(sha1, '') = '' GROUP BY 1""")
def no_usable_hash(spark: SparkSession, sf: str) -> DataFrame:
    rows = ingest.gather_tags(wide(spark, sf).drop("sha256", "xxhash64be", "c4"), ["md5", "sha1", "crc32"])
    alg, _ = hashes.pick(F.col("hashes"), schemas.STRONG_FIRST, skip_empty=True)
    return rows.where(alg.isNull()).groupBy("manifest_path").agg(F.count(F.lit(1)).alias("dropped"))


OUTCOME_SQL = (
    WIDE_SQL
    + """,
oc AS (
  SELECT manifest_path, file, line, part, price, CAST(round(o.o_totalprice) AS BIGINT) AS length,
    CASE WHEN ends_with(file, '.txt') THEN 'not_clip' WHEN o.o_orderkey IS NULL THEN 'missing_clip' ELSE 'ok' END AS outcome,
    CASE WHEN sha256 <> '' THEN 'sha256' WHEN c4 <> '' THEN 'c4' WHEN sha1 <> '' THEN 'sha1' ELSE 'xxh64' END AS alg,
    CASE WHEN sha256 <> '' THEN sha256 WHEN c4 <> '' THEN c4 WHEN sha1 <> '' THEN sha1 ELSE xxh64 END AS value
  FROM wd LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON 'o' || o.o_orderkey || '.mov' = file)"""
)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf).withColumn("manifest_sha256", F.sha2("manifest_path", 256))
    return ingest.entry_outcomes(rows, media(spark, sf), root_join=False)


@R.add("j01_entries_inventory", f"WITH {OUTCOME_SQL} SELECT manifest_path, file, line, part, price, outcome, alg, length FROM oc")
def entries_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_outcomes(spark, sf), "outcome", "alg", "length")


@R.add("a09_coverage", f"""
WITH {OUTCOME_SQL}
SELECT manifest_path, CAST(count(*) FILTER (outcome = 'ok') AS BIGINT) AS documents, CAST(count(*) FILTER (outcome <> 'ok') AS BIGINT) AS skipped,
  CAST(coalesce(sum(length) FILTER (outcome = 'ok'), 0) AS BIGINT) AS bytes FROM oc GROUP BY 1""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.coverage(_outcomes(spark, sf), ["manifest_path"])


def _id_sql(text: str) -> str:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "'urn:uuid:' || " + " || '-' || ".join(f"substr(sha256({text}), {a}, {n})" for a, n in cuts)


@R.add("g02_ingest", f"""
WITH {OUTCOME_SQL},
k AS (SELECT *, sha256(manifest_path) AS msha, sha256(manifest_path) || '|' || file AS key, split_part(file, '.', 1) AS stem FROM oc WHERE outcome = 'ok'),
i AS (
  SELECT *, {_id_sql('key')} AS id, {_id_sql("key || chr(31) || 'source-file' || chr(31) || file")} AS id0,
    {_id_sql("key || chr(31) || 'asc-mhl' || chr(31) || manifest_path")} AS id1 FROM k),
h AS (
  SELECT *, 'sha256:' || sha256('{{"action":"create","actor":{{"id":"urn:service:ingest","role":"IngestService"}},"prevHash":null,"seq":1,"target":"'
    || id || '","tool":{{"name":"clipledger","version":"0.1"}},"ts":"2024-02-01T00:00:00Z"}}') AS hash FROM i)
SELECT stem || '.omc.json' AS sidecar_path, hash AS chain_head, md5('{{"Asset":[{{"schemaVersion":"v2.8","entityType":"Asset","identifier":[{{"identifierScope":"clip-uuid","identifierValue":"'
  || id || '"}},{{"identifierScope":"source-filename","identifierValue":"' || stem || '"}}],"name":"' || stem
  || '","description":"Ingested from ' || regexp_replace(manifest_path, '.*/', '')
  || '","provenance":{{"CreatedBy":{{"identifier":[{{"identifierScope":"actor","identifierValue":"urn:service:ingest"}}]}},"Role":{{"identifier":[{{"identifierScope":"crew-role","identifierValue":"IngestService"}}]}},"createdOn":"2024-02-01T00:00:00Z","reason":"ingested from manifest, clip bytes not read"}},"AssetSC":{{"schemaVersion":"v2.8","entityType":"AssetSC","identifier":[{{"identifierScope":"clip-sc-uuid","identifierValue":"astsc-' || id || '"}}],"structuralType":"digital.movingImage","structuralProperties":{{"linkset":{{"recordType":"item","mediaType":"video/quicktime"}},"fileDetails":{{"fileName":"'
  || stem || '","filePath":"/","fileExtension":"mov","mediaType":"video/quicktime"}},"purpose":"general"}}}},"assetFC":{{"functionalType":"capture.ocf","functionalProperties":{{"customData":[{{"domain":"{schemas.ARTIFACT_DOMAIN}","namespace":"urn:clipledger:sidecar:v0.1","schema":"urn:clipledger:sidecar:v0.1:artifacts.schema.json","value":[{{"id":"'
  || id0 || '","role":"clip-integrity","kind":"source-file","path":"' || file || '","hash":{{"alg":"' || alg || '","value":"' || value
  || '"}}}},{{"id":"' || id1 || '","role":"integrity","kind":"asc-mhl","path":"' || manifest_path || '","mhlEntry":"' || file || '","hash":{{"alg":"sha256","value":"' || msha
  || '"}},"immutable":true}}]}},{{"domain":"{schemas.EVENT_DOMAIN}","namespace":"urn:clipledger:sidecar:v0.1","schema":"urn:clipledger:sidecar:v0.1:events.schema.json","value":[{{"action":"create","actor":{{"id":"urn:service:ingest","role":"IngestService"}},"prevHash":null,"seq":1,"target":"'
  || id || '","tool":{{"name":"clipledger","version":"0.1"}},"ts":"2024-02-01T00:00:00Z","hash":"' || hash || '"}}]}},{{"domain":"{schemas.LOCK_DOMAIN}","namespace":"urn:clipledger:sidecar:v0.1","schema":"urn:clipledger:sidecar:v0.1:locks.schema.json","value":[]}}]}}}}}}]}}') AS body_md5 FROM h""")
def run_ingest(spark: SparkSession, sf: str) -> DataFrame:
    clips = ingest.usable(_outcomes(spark, sf))
    built = ingest.build_documents(clips, F.to_timestamp(F.lit("2024-02-01T00:00:00Z")))
    return built.select("sidecar_path", "chain_head", F.md5("body").alias("body_md5"))


@R.add("j10_manifest_inner", """
WITH art AS (
  SELECT o_orderkey, '/roll/o' || o_orderkey || '/m.mhl' AS mp, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'c9.mov' ELSE 'c1.mov' END AS entry,
    o_orderstatus <> 'P' AS present, o_orderpriority FROM orders),
man AS (SELECT '/roll/o' || l_orderkey || '/m.mhl' AS mp, 'c' || l_linenumber || '.mov' AS file, l_partkey, l_returnflag, l_suppkey FROM lineitem),
fst AS (SELECT mp, file, min(l_partkey) AS pk FROM man GROUP BY 1, 2),
pk AS (
  SELECT mp, file, min(CASE l_returnflag WHEN 'A' THEN 'md5' WHEN 'R' THEN 'sha1' END) AS alg, min(CASE WHEN l_returnflag <> 'N' THEN md5(CAST(l_suppkey AS VARCHAR)) END) AS val
  FROM (SELECT *, row_number() OVER (PARTITION BY mp, file ORDER BY l_partkey, l_suppkey, l_returnflag) AS rn FROM man) WHERE rn = 1 GROUP BY 1, 2),
dg AS (SELECT mp, min(md5(CAST(l_suppkey AS VARCHAR))) AS val FROM man WHERE file = 'c1.mov' GROUP BY 1)
SELECT o_orderkey, CASE WHEN NOT present THEN 'skip_no_manifest' WHEN fst.mp IS NULL THEN 'no_entry' WHEN pk.alg IS NULL THEN 'no_algorithm'
  WHEN o_orderpriority = '5-LOW' THEN 'skip_no_camera_file' WHEN dg.val = pk.val THEN 'ok' ELSE 'mismatch' END AS outcome
FROM art LEFT JOIN fst ON fst.mp = art.mp AND fst.file = art.entry LEFT JOIN pk ON pk.mp = art.mp AND pk.file = art.entry LEFT JOIN dg ON dg.mp = art.mp""")
def manifest_inner(spark: SparkSession, sf: str) -> DataFrame:
    orders, li = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    folder = lambda c: F.concat(F.lit("/roll/o"), F.col(c).cast("string"))
    arts = orders.select(
        F.col("o_orderkey").cast("string").alias("sidecar_path"), F.lit("p").alias("json_path"), F.lit(0).alias("group_ix"),
        F.lit(0).alias("artifact_ix"), F.lit("asc-mhl").alias("kind"), F.lit("./m.mhl").alias("path"),
        F.concat(folder("o_orderkey"), F.lit("/m.mhl")).alias("resolved"), F.concat(folder("o_orderkey"), F.lit("/far")).alias("base_dir"),
        F.when(F.col("o_orderpriority") == "3-MEDIUM", "c9.mov").otherwise("c1.mov").alias("mhl_entry"),
    )
    supp = F.md5(F.col("l_suppkey").cast("string"))
    rows = li.select(
        F.concat(folder("l_orderkey"), F.lit("/m.mhl")).alias("manifest_path"),
        F.concat(F.lit("c"), F.col("l_linenumber").cast("string"), F.lit(".mov")).alias("file"), F.struct("l_partkey", "l_suppkey", "l_returnflag").alias("entry_ix"),
        hashes.gather({"md5": F.when(F.col("l_returnflag") == "A", supp), "sha1": F.when(F.col("l_returnflag") == "R", supp)}).alias("hashes"),
        supp.alias("value"),
    )
    # Urgent clips lie beside the manifest, others under the document's folder, low ones nowhere.
    place = F.when(F.col("o_orderpriority") == "1-URGENT", "/c1.mov").when(F.col("o_orderpriority") != "5-LOW", "/far/c1.mov")
    files = orders.where("o_orderstatus <> 'P'").select(F.concat(folder("o_orderkey"), F.lit("/m.mhl")).alias("path")).unionByName(
        orders.where(place.isNotNull()).select(F.concat(folder("o_orderkey"), place).alias("path"))
    )
    content = rows.where("file = 'c1.mov'").groupBy("manifest_path").agg(F.min("value").alias("value"))
    both = content.select(
        F.regexp_replace("manifest_path", "/m.mhl$", "").alias("d"), "value",
        F.explode(F.array(F.lit("md5"), F.lit("sha1"))).alias("alg"), F.lit("ok").alias("status"),
    )
    digests = both.select(F.explode(F.array(F.concat("d", F.lit("/c1.mov")), F.concat("d", F.lit("/far/c1.mov")))).alias("path"), "alg", "value", "status")
    none = rows.select("manifest_path").where(F.lit(False))
    out = integrity.manifest_outcomes(integrity.manifest_claims(arts, rows, none, files), digests)
    return out.select(F.col("sidecar_path").cast("bigint").alias("o_orderkey"), "outcome")


@R.add("o03_union_formats", f"""
WITH {WIDE_SQL}
SELECT manifest_path, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS v1, CAST(count(xx) AS BIGINT) AS with_size
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN price END AS xx FROM wd) GROUP BY 1""")
def union_formats(spark: SparkSession, sf: str) -> DataFrame:
    w = wide(spark, sf)
    v1 = w.where("l_returnflag = 'A'").select("manifest_path", "file", F.lit("v1").alias("version"), F.col("entry_ix.price").alias("size"))
    v2 = w.where("l_returnflag <> 'A'").select("manifest_path", "file", F.lit("v2").alias("version"))
    both = v1.unionByName(v2, allowMissingColumns=True)
    return both.groupBy("manifest_path").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("version") == "v1").alias("v1"), F.count("size").alias("with_size")
    )


VERSION_SQL = """
d AS (
  SELECT 'p' || l_partkey AS stem, md5(CAST(l_suppkey % 3 AS VARCHAR)) AS value, l_orderkey * 10 + l_linenumber AS arrival, l_shipdate < TIMESTAMP '1996-06-01' AS known
  FROM lineitem),
k AS (SELECT stem, value, min(arrival) AS arrival, count(*) FILTER (NOT known) AS copies, max(CAST(known AS INT)) AS known FROM d GROUP BY 1, 2),
v AS (SELECT stem, count(*) AS versions FROM k GROUP BY 1)"""


@R.add("u04_collisions", f"""
WITH {VERSION_SQL}
SELECT stem, value, arrival, CAST(copies AS BIGINT) AS copies,
  CASE WHEN known = 1 THEN 'refresh' WHEN versions > 1 THEN 'conflict' ELSE 'write' END AS outcome,
  stem || CASE WHEN versions > 1 THEN '.' || substr(value, 1, 8) ELSE '' END || '.omc.json' AS name
FROM k JOIN v USING (stem)""")
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Versions known before arrive in a first batch, the others in four more; each batch meets only the published versions of its own stems.
    What is returned is the view over all of them: names as they are in the end, and copies over all batches."""
    li = load(spark, sf, "lineitem")
    rows = li.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("stem"), F.lit("md5").alias("alg"),
        F.md5((F.col("l_suppkey") % 3).cast("string")).alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("arrival"),
        F.when(F.col("l_shipdate") < F.lit("1996-06-01").cast("timestamp"), 0).otherwise(1 + F.col("l_suppkey") % 4).alias("batch"),
    )
    root, published, arrived = f"{checkpoint_dir(spark)}/u04-{uuid.uuid4().hex}", None, None
    for batch in range(5):
        new = rows.where(F.col("batch") == batch)
        found = ingest.resolve_collisions(new, watch.known_versions(new, published, BUCKETS)).where("copies > 0")
        found = found.withColumns({"batch": F.lit(batch), "bucket": watch.bucket_of(BUCKETS)})
        found.write.mode("append").partitionBy("bucket").parquet(root)
        arrived = spark.read.schema(found.schema).parquet(root)
        published = arrived.where("outcome <> 'refresh'")
    later = F.when(F.col("batch") > 0, F.col("copies")).otherwise(0)
    seen = arrived.groupBy("stem", "value").agg(
        F.min("arrival").alias("arrival"), F.sum(later).alias("copies"), (F.min("batch") == 0).alias("known"),
    )
    named = watch.with_names(seen)
    outcome = F.when(F.col("known"), "refresh").when(F.col("name") == F.concat("stem", F.lit(".omc.json")), "write").otherwise("conflict")
    return named.select("stem", "value", "arrival", "copies", outcome.alias("outcome"), "name")
