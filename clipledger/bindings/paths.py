"""Path queries over page addresses read as file paths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipledger import schemas
from clipledger.bindings import Registry, load
from clipledger.functions import hashes, paths, text
from clipledger.operators import ingest, integrity, matching
from clipledger.session import checkpoint_dir
from clipledger.sources import documents as doc_source

R = Registry()

# Address to path: the host is the volume, the query is cut, names without extension get one.
EXTS = ["mov", "MXF", "ari", "txt", "mp4", "dpx", "r3d"]


def files(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^https?://", ""), r"[?#].*$", "")
    trimmed = F.regexp_replace(bare, r"/+$", "")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("page_id") % len(EXTS) + 1).cast("int"))
    named = F.when(trimmed.endswith(".html"), trimmed).otherwise(F.concat(trimmed, F.lit("."), ext))
    return p.select("page_id", F.concat(F.lit("/vol/"), named).alias("path"), F.octet_length("html").cast("bigint").alias("length")).select(
        "*", F.split("path", "/")[2].alias("host"), F.split("path", "/")[3].alias("lang")
    )


_EXT_SQL = ", ".join(f"'{e}'" for e in EXTS)
FILES_SQL = f"""
f0 AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS p FROM pages),
f AS (
  SELECT page_id, '/vol/' || CASE WHEN ends_with(p, '.html') THEN p ELSE p || '.' || ([{_EXT_SQL}])[page_id % {len(EXTS)} + 1] END AS path,
    CAST(octet_length(encode(html)) AS BIGINT) AS length FROM f0),
fl AS (
  SELECT *, string_split(path, '/')[3] AS host, string_split(path, '/')[4] AS lang, regexp_extract(path, '([^/]*)$', 1) AS base,
    regexp_replace(path, '/?[^/]*$', '') AS dir FROM f),
fx AS (SELECT *, lower(regexp_extract(base, '.[.]([^.]+)$', 1)) AS ext, regexp_replace(base, '^(.+)[.][^.]*$', '\\1') AS stem FROM fl)"""
CLIP_SQL = "ext IN (" + ", ".join(f"'{e}'" for e in schemas.MANIFEST_CLIP_EXTS) + ")"


@R.add("s07_media_inventory", f"WITH {FILES_SQL} SELECT page_id, path, length FROM fx WHERE {CLIP_SQL}")
def media_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """Every page is a file of as many bytes as its row says, below a folder of its own; what comes back is what the tree holds."""
    root = f"{checkpoint_dir(spark)}/s07-{uuid.uuid4().hex}"
    local = root.removeprefix("file:")
    placed = files(spark, sf).select("page_id", F.concat(F.lit(f"{root}/p"), F.col("page_id").cast("string"), F.col("path")).alias("path"), "length")
    made = placed.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_make_files, "path string")
    made.write.format("noop").mode("overwrite").save()
    found = doc_source.inventory(spark, root, exts=schemas.MANIFEST_CLIP_EXTS)
    inside = F.substring_index("path", f"{local.rsplit('/', 1)[1]}/p", -1)
    return found.select(
        F.regexp_extract(inside, "^([0-9]+)", 1).cast("bigint").alias("page_id"), F.regexp_replace(inside, "^[0-9]+", "").alias("path"), "length"
    )


def _make_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for pdf in batches:
        for path, length in zip(pdf["path"], pdf["length"]):
            store, inner = fs.FileSystem.from_uri(path if "://" in path else "file://" + "/" + path.removeprefix("file:").lstrip("/"))
            store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(inner, compression=None) as f:
                f.write(b"\0" * int(length))
        yield pdf[["path"]]


@R.add("s08_basename_index", f"WITH {FILES_SQL} SELECT base AS basename, CAST(count(*) AS BIGINT) AS files, min(path) AS first_path FROM fx GROUP BY 1")
def basename_index(spark: SparkSession, sf: str) -> DataFrame:
    return doc_source.by_basename(files(spark, sf))


@R.add("s15_bundle_pick", f"""
WITH {FILES_SQL}
SELECT host, arg_min(path, (len(string_split(path, '/')), path)) AS path FROM fx GROUP BY host""")
def bundle_pick(spark: SparkSession, sf: str) -> DataFrame:
    return doc_source.shallowest(files(spark, sf), "host")


@R.add("p09_relative_path", f"""
WITH {FILES_SQL},
b AS (SELECT *, CASE WHEN lang = 'en' THEN '/vol/' || host ELSE '/vol/' || left(host, length(host) - 1) END AS root FROM fx)
SELECT page_id, CASE WHEN starts_with(path, root || '/') THEN './' || substr(path, length(root) + 2) ELSE path END AS rel FROM b""")
def relative_path(spark: SparkSession, sf: str) -> DataFrame:
    host = F.when(F.col("lang") == "en", F.col("host")).otherwise(F.substr("host", F.lit(1), F.length("host") - 1))
    root = F.concat(F.lit("/vol/"), host)
    return files(spark, sf).select("page_id", paths.relative_to(F.col("path"), root).alias("rel"))


@R.add("p10_name_parts", f"WITH {FILES_SQL} SELECT page_id, base AS basename, stem, ext, dir FROM fx")
def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.translate("path", "/", "\\")
    return files(spark, sf).select(
        "page_id", paths.basename(p).alias("basename"), paths.stem(p).alias("stem"), paths.extension(p).alias("ext"),
        paths.dirname(p).alias("dir"),
    )


@R.add("p11_double_extension", f"WITH {FILES_SQL} SELECT page_id, CASE WHEN ext = 'html' THEN base ELSE stem END AS name FROM fx")
def double_extension(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("path").endswith(".html"), F.concat("path", F.lit(".omc.json"))).otherwise(F.col("path"))
    return files(spark, sf).select("page_id", paths.strip_double_extension(p).alias("name"))


_TYPE = lambda i: " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in schemas.MEDIA_TYPES.items())


@R.add("p12_media_types", f"""
WITH {FILES_SQL}
SELECT page_id, CASE ext {_TYPE(0)} ELSE '{schemas.DEFAULT_MEDIA_TYPE[0]}' END AS structural_type,
  CASE ext {_TYPE(1)} ELSE '{schemas.DEFAULT_MEDIA_TYPE[1]}' END AS media_type,
  CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in schemas.CODECS.items())} ELSE '{schemas.DEFAULT_CODEC}' END AS codec FROM fx""")
def media_types(spark: SparkSession, sf: str) -> DataFrame:
    ext = paths.extension(F.col("path"))
    return files(spark, sf).select(
        "page_id", paths.structural_type(ext).alias("structural_type"), paths.media_type(ext).alias("media_type"),
        paths.codec(ext).alias("codec"),
    )


@R.add("p17_sidecar_path", f"WITH {FILES_SQL} SELECT page_id, dir || '/' || stem || '.omc.json' AS sidecar_path FROM fx")
def sidecar_path(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("page_id", paths.sidecar_for_clip(F.col("path")).alias("sidecar_path"))


OTHER_SQL = "CASE WHEN lang = 'en' THEN replace(path, '/en/', '/xx/') WHEN lang = 'de' THEN '/copy' || path ELSE '/copy/' || base END"


@R.add("p18_suffix_overlap", f"""
WITH {FILES_SQL},
r AS (SELECT page_id, list_reverse(string_split(path, '/')) AS a, list_reverse(string_split({OTHER_SQL}, '/')) AS b FROM fx)
SELECT page_id, CAST(len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS BIGINT) AS overlap FROM r""")
def suffix_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("page_id", paths.trailing_overlap(F.col("path"), _moved()).alias("overlap"))


def _moved():
    return (
        F.when(F.col("lang") == "en", F.replace("path", F.lit("/en/"), F.lit("/xx/")))
        .when(F.col("lang") == "de", F.concat(F.lit("/copy"), F.col("path")))
        .otherwise(F.concat(F.lit("/copy/"), paths.basename(F.col("path"))))
    )


@R.add("p23_lenient_int", f"""
WITH {FILES_SQL}
SELECT page_id, CASE WHEN regexp_full_match(stem, '[0-9]+') THEN TRY_CAST(stem AS BIGINT) END AS number, stem AS text FROM fx""")
def lenient_int(spark: SparkSession, sf: str) -> DataFrame:
    stem = paths.stem(F.col("path"))
    return files(spark, sf).select("page_id", text.lenient_int(stem).alias("number"), stem.alias("text"))


@R.add("f01_clip_filter", f"""
WITH {FILES_SQL}
SELECT lang, CAST(count(*) FILTER ({CLIP_SQL}) AS BIGINT) AS clips, CAST(count(*) FILTER (NOT {CLIP_SQL}) AS BIGINT) AS skipped FROM fx GROUP BY 1""")
def clip_filter(spark: SparkSession, sf: str) -> DataFrame:
    clip = paths.is_clip(F.col("path"))
    return files(spark, sf).groupBy("lang").agg(F.count_if(clip).alias("clips"), F.count_if(~clip).alias("skipped"))


@R.add("j04_nearest_manifest", f"""
WITH {FILES_SQL},
m AS (
  SELECT DISTINCT CASE ext WHEN 'txt' THEN dir ELSE regexp_replace(dir, '/[^/]*$', '') END AS mdir,
    CASE ext WHEN 'txt' THEN dir || '/roll.mhl' ELSE regexp_replace(dir, '/[^/]*$', '') || '/all.mhl' END AS manifest_path
  FROM fx WHERE ext IN ('txt', 'html')),
md AS (SELECT mdir, min(manifest_path) AS manifest_path FROM m GROUP BY 1)
SELECT page_id, arg_max(mdir, length(mdir)) AS roll_dir, arg_max(md.manifest_path, length(mdir)) AS manifest_path
FROM fx JOIN md ON fx.dir = mdir OR starts_with(fx.dir, mdir || '/') WHERE {CLIP_SQL} GROUP BY page_id""")
def nearest_manifest(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    ext, folder = paths.extension(F.col("path")), paths.dirname(F.col("path"))
    where = F.when(ext == "txt", F.concat(folder, F.lit("/roll.mhl"))).otherwise(F.concat(paths.dirname(folder), F.lit("/all.mhl")))
    manifests = f.where(ext.isin("txt", "html")).select(where.alias("manifest_path"))
    out = ingest.nearest_manifest(f.where(paths.is_clip(F.col("path"))), manifests)
    return out.select("page_id", "roll_dir", "manifest_path")


@R.add("j11_trust_manifest", f"""
WITH {FILES_SQL},
e AS (SELECT *, CASE WHEN lang = 'en' THEN lang || '/' || base ELSE base END AS entry FROM fx),
t AS (
  SELECT a.page_id, a.path, arg_min(md5(CASE WHEN m.length > 2000 THEN m.path ELSE m.base END), m.page_id) AS claim
  FROM e a JOIN e m ON m.host = a.host AND ends_with(a.path, m.entry)
  WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.host = m.host AND x.entry = m.entry AND x.page_id < m.page_id)
  GROUP BY 1, 2)
SELECT page_id FROM t JOIN fx USING (page_id) WHERE t.claim = md5(base)""")
def trust_manifest(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf).withColumn("base", paths.basename(F.col("path")))
    entry = F.when(F.col("lang") == "en", F.concat("lang", F.lit("/"), "base")).otherwise(F.col("base"))
    manifest_path = F.concat(F.lit("/m/"), F.col("host"), F.lit(".mhl"))
    own = [F.col("host").alias("sidecar_path"), F.lit("p").alias("json_path"), F.lit(0).alias("group_ix")]
    clips = f.select(
        *own, (F.col("page_id") * 2 + 1).alias("artifact_ix"), F.lit("source-file").alias("kind"), "path",
        F.lit(None).cast("string").alias("mhl_entry"), F.col("path").alias("resolved"), F.lit("md5").alias("alg"),
        F.md5("base").alias("value"),
    )
    lists = f.select(
        *own, (F.col("page_id") * 2).alias("artifact_ix"), F.lit("asc-mhl").alias("kind"), F.lit("").alias("path"),
        entry.alias("mhl_entry"), manifest_path.alias("resolved"), F.lit("sha256").alias("alg"), F.lit("-").alias("value"),
    )
    claim = F.md5(F.when(F.col("length") > 2000, F.col("path")).otherwise(F.col("base")))
    rows = f.select(
        manifest_path.alias("manifest_path"), F.col("page_id").alias("entry_ix"), entry.alias("file"),
        hashes.gather({"md5": claim}).alias("hashes"),
    )
    hit = integrity.trusted(clips.unionByName(lists), rows)
    return hit.select(F.expr("(artifact_ix - 1) div 2").alias("page_id"))


@R.add("j13_path_remap", f"""
WITH {FILES_SQL},
o AS (SELECT DISTINCT {OTHER_SQL} AS path FROM fx),
c AS (
  SELECT o.path, fx.path AS cand, fx.page_id, list_reverse(string_split(o.path, '/')) AS a, list_reverse(string_split(fx.path, '/')) AS b
  FROM o JOIN fx ON fx.base = regexp_extract(o.path, '([^/]*)$', 1)),
s AS (SELECT *, len(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[1:k] = b[1:k])) AS score FROM c)
SELECT path, arg_max(cand, (score, -page_id)) AS new_path, CAST(max(score) AS BIGINT) AS overlap FROM s GROUP BY path""")
def path_remap(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    return matching.remap_paths(f.select(_moved().alias("path")), f.select("path", F.col("page_id").alias("ix")))


@R.add("j15_adjacent_sidecar", f"""
WITH {FILES_SQL}, s AS (SELECT DISTINCT dir || '/' || stem || '.omc.json' AS sc FROM fx WHERE lang IN ('en', 'de'))
SELECT page_id, sc AS sidecar_path FROM fx LEFT JOIN s ON s.sc = dir || '/' || stem || '.omc.json'""")
def adjacent_sidecar(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf)
    sidecars = f.where(F.col("lang").isin("en", "de")).select(paths.sidecar_for_clip(F.col("path")).alias("sidecar_path"))
    return matching.adjacent(f, sidecars).select("page_id", "sidecar_path")


@R.add("o01_path_order", f"WITH {FILES_SQL} SELECT page_id, path FROM fx ORDER BY path, page_id")
def path_order(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).select("page_id", "path").orderBy("path", "page_id")


@R.add("o02_first_of_folder", f"WITH {FILES_SQL} SELECT dir, min(path) AS path FROM fx GROUP BY dir")
def first_of_folder(spark: SparkSession, sf: str) -> DataFrame:
    return files(spark, sf).groupBy(paths.dirname(F.col("path")).alias("dir")).agg(F.min("path").alias("path"))
