"""Readers and writers."""

import datetime
import hashlib
import json

import corpus
import xxhash
from pyspark.sql import functions as F

from clipledger import schemas, sinks
from clipledger.functions import hashes
from clipledger.sources import ale, documents, looks, manifests

XML = """<?xml version="1.0"?>
<m:hashlist version="1.1" xmlns:m="urn:x">
  <m:hash><m:file>A &amp; 1.mov</m:file><m:Size>12</m:Size><m:xxhash64BE>0012</m:xxhash64BE><m:md5></m:md5><m:odd>1</m:odd></m:hash>
  <m:hash><m:file>B.mov</m:file><m:size>big</m:size><m:sha1>0123</m:sha1></m:hash>
  <m:hash><m:file>B.mov</m:file><m:sha1>9999</m:sha1></m:hash>
</m:hashlist>
"""
YAML = """Version: 2.0.0
Hashes:
  - File: C 1.mov
    Size: 7
    LastModificationDate: 2024-01-01T10:00:00Z
    xxh64: "00ff"
  - File: D.mov
    blake3: aa
"""


def test_manifests(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.mhl").write_text(XML)
    (tmp_path / "b.ascmhl").write_text(YAML)
    (tmp_path / "bad.mhl").write_text("Hashes:\n  - File: {a: b\n      c")
    (tmp_path / "cut.mhl").write_text("<hashlist><hash><file>Z.mov</file></hash>")
    (tmp_path / "other.txt").write_text(YAML)
    rows, rejects = manifests.manifests(spark, str(tmp_path))
    want = sorted([
        ("A & 1.mov", 12, "12", {"xxh64": "0012", "md5": ""}, "1.1"), ("B.mov", None, "big", {"sha1": "0123"}, "1.1"),
        ("B.mov", None, None, {"sha1": "9999"}, "1.1"), ("C 1.mov", 7, "7", {"xxh64": "00ff"}, "2.0.0"),
        ("D.mov", None, None, {"blake3": "aa"}, "2.0.0"),
    ], key=lambda r: (r[0], str(r[3])))
    got = sorted(
        ((r.file, r.size, r.size_text, {k: v for k, v in r.hashes.items() if v is not None}, r.version) for r in rows.collect()),
        key=lambda r: (r[0], str(r[3])),
    )
    assert got == want
    assert {(r.manifest_path.rsplit("/", 1)[1], r.code) for r in rejects.collect()} == {
        ("bad.mhl", "not_flat_yaml"), ("cut.mhl", "truncated_xml")
    }
    # The same rows from texts already in hand, as the stream reads them.
    names = [str(tmp_path / p) for p in ("x/a.mhl", "b.ascmhl", "bad.mhl", "cut.mhl")]
    texts = spark.createDataFrame([(p, "s", open(p).read()) for p in names], "manifest_path string, manifest_sha256 string, text string")
    again, _ = manifests.rows_from_texts(texts)
    assert sorted(((r.file, str({k: v for k, v in r.hashes.items() if v is not None})) for r in again.collect())) == sorted(
        (g[0], str(g[3])) for g in got
    )
    from clipledger.operators import integrity

    firsts = {r.file: r.hashes["sha1"] for r in integrity.first_entries(rows).collect()}
    assert firsts["B.mov"] == "0123"
    hashed = {r.manifest_path: r.manifest_sha256 for r in manifests.manifest_files(spark, str(tmp_path)).collect()}
    assert hashed == {p: hashlib.sha256(open(p, "rb").read()).hexdigest() for p in names}
    assert {(r.manifest_path, r.manifest_sha256) for r in rows.collect()} == {(p, hashed[p]) for p in names[:2]}


def test_a_huge_manifest_is_many_tasks(spark, tmp_path):
    n = 20_000
    items = "".join(f"  <hash{' a=\"1\"' if i % 7 == 0 else ''}>\n<file>c{i}.mov</file><md5>{i:032x}</md5></hash>\n" for i in range(n))
    (tmp_path / "big.mhl").write_text(f'<?xml version="1.0"?><hashlist version="1.1">{items}</hashlist>')
    (tmp_path / "notes.mhl").write_text("Version: 2.0.0\nHashes:\n  - File: z.mov\n    md5: aa\n")
    (tmp_path / "latin.mhl").write_bytes(b"<hashlist><hash><file>\xe9.mov</file></hash></hashlist>")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert manifests.scan(spark, str(tmp_path / "big.mhl")).rdd.getNumPartitions() > 8
        rows, rejects = manifests.manifests(spark, str(tmp_path))
        got = sorted((r.entry_ix, r.file, r.hashes["md5"]) for r in rows.where("version = '1.1'").collect())
        assert got == [(i, f"c{i}.mov", f"{i:032x}") for i in range(n)]
        assert [(r.file, r.version) for r in rows.where("version <> '1.1'").collect()] == [("z.mov", "2.0.0")]
        assert [(r.manifest_path.rsplit("/", 1)[1], r.code) for r in rejects.collect()] == [("latin.mhl", "not_utf8")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_looks(spark, tmp_path):
    (tmp_path / "a.cdl").write_text(corpus.CDL.format(sat="0.9"))
    (tmp_path / "bad.cdl").write_text(corpus.CDL.format(sat="0.9").replace("1.1 1.0 0.9", "1.1 1.0"))
    (tmp_path / "a.amf").write_text(corpus.AMF)
    good, bad = looks.cdls(spark, str(tmp_path))
    r = good.collect()
    assert len(r) == 1 and list(r[0].slope) == [1.1, 1.0, 0.9] and r[0].saturation == 0.9 and r[0].description == "d"
    assert [x.path.rsplit("/", 1)[1] for x in bad.collect()] == ["bad.cdl"]
    look = looks.amf_looks(spark, str(tmp_path)).collect()
    assert len(look) == 1 and look[0].applied is False and list(look[0].offset) == [0.01, 0.0, 0.0]


def test_keyring_and_revocations(spark, tmp_path):
    corpus.write_keyring(tmp_path / "keyring.json")
    (tmp_path / "rev.json").write_text(json.dumps({"revocations": [
        {"kid": "kid-1", "revokedAt": "2024-03-01T00:00:00Z", "reason": "a"}, {"kid": "kid-1", "revokedAt": None, "reason": None},
        {"kid": "nobody", "revokedAt": "2024-03-01T00:00:00Z"},
    ]}))
    from clipledger.operators import keys

    ring = documents.keyring(spark, str(tmp_path / "keyring.json"))
    out = {r.kid: r for r in keys.apply_revocations(ring, documents.revocations(spark, str(tmp_path / "rev.json"))).collect()}
    assert out["kid-old"].public_key == "bare-key" and out["kid-old"].valid_from is None
    assert out["kid-1"].revoked_at is None and set(out) == {"kid-1", "kid-old"}


def test_validity_bounds_pass(spark):
    from clipledger.operators import keys

    t = datetime.datetime
    rows = [(0, t(2024, 1, 1)), (1, t(2024, 1, 31)), (2, t(2023, 12, 31, 23, 59, 59)), (3, t(2024, 1, 31, 0, 0, 1)), (4, t(2024, 1, 20, 0, 0, 1))]
    df = spark.createDataFrame(rows, "i int, ts timestamp").select(
        "i", "ts", F.lit(t(2024, 1, 1)).alias("valid_from"), F.lit(t(2024, 1, 31)).alias("valid_until"),
        F.when(F.col("i") == 4, F.lit(t(2024, 1, 20))).alias("revoked_at"),
    )
    got = {r.i: r.code for r in df.select("i", keys.window_code(F.col("ts")).alias("code")).collect()}
    assert got == {0: None, 1: None, 2: "before_valid_from", 3: "after_valid_until", 4: "after_revocation"}


def test_watch_state(spark, tmp_path):
    many = [{"clipName": f"c{i}", "omcPath": "p", "signedAt": "t", "status": "signed"} for i in range(130)]
    (tmp_path / "full.json").write_text(json.dumps({"processed_mhl_sha256": ["a"], "emitted": many}, indent=2))
    (tmp_path / "old.json").write_text(json.dumps({"processed_mhl_sha256": ["a", "b"]}))
    (tmp_path / "bad.json").write_text(json.dumps({"emitted": []}))
    states = documents.watch_state(spark, str(tmp_path / "*.json"))
    sizes = {r.state_path.rsplit("/", 1)[1]: len(r.emitted) for r in states.collect()}
    assert sizes == {"full.json": 100, "old.json": 0, "bad.json": 0}
    first = documents.state_emissions(states).orderBy("ix").first()
    assert first.clip == "c30"
    from clipledger.plans import health

    assert [r.state_path.rsplit("/", 1)[1] for r in health.bad_states(states).collect()] == ["bad.json"]


def test_ale_round_trip(spark, tmp_path):
    names = ["Ünï\tname", "line\r\nbreak", "plain"]
    rows = spark.createDataFrame(
        [(f"/d/{i}.omc.json", "2024-02-01", i, *[n if c == "Name" else f"{c}{i}" for c in schemas.ALE_COLUMNS]) for i, n in enumerate(names)],
        ["sidecar_path", "day", "arrival", *schemas.ALE_COLUMNS],
    )
    sinks.write_ale(rows, str(tmp_path / "one"))
    assert len(list((tmp_path / "one").rglob("part-*.txt"))) == 1  # a day is one file
    sinks.write_ale(rows, str(tmp_path / "out"), parts=2)
    files = list((tmp_path / "out/day=2024-02-01").rglob("part-*.txt"))
    assert len(files) == 2
    for f in files:
        text = f.read_bytes().decode()
        assert text.startswith("Heading\r\nFIELD_DELIM\tTABS\r\n") and text.endswith("\r\n") and text.count("Heading") == 1
    got = [r.cells for r in ale.ale_rows(spark, str(tmp_path / "out"), glob="part-*").collect()]
    assert sorted(c["Name"] for c in got) == sorted(["Ünï name", "line  break", "plain"])
    assert all(sorted(c) == sorted(schemas.ALE_COLUMNS) for c in got)
    odd = spark.createDataFrame([("f", "Heading\nX\tY\nZ\n\nColumn\nA\tB\tC\n\nData\n1\t2\n\n3\t4\t5\t6\n\n")], "path string, text string")
    assert [dict(r.cells) for r in ale.parse_ale(odd).orderBy("row_ix").collect()] == [
        {"A": "1", "B": "2", "C": ""}, {"A": "3", "B": "4", "C": "5"}
    ]


def test_digest_vectors(spark, tmp_path):
    cases = [b"", b"foo", b"bar", bytes(range(256)), b"\0" * 1024]
    algs = ["md5", "sha1", "sha256", "sha512", "xxh64", "xxh3", "blake3"]
    rows = [(f"{i}", a, c) for i, c in enumerate(cases) for a in algs]
    got = {(r.path, r.alg): (r.value, r.status) for r in hashes.content_digests(
        spark.createDataFrame(rows, "path string, alg string, content binary")).collect()}
    asked = []
    for i, c in enumerate(cases):
        (tmp_path / str(i)).write_bytes(c)
        asked += [(str(tmp_path / str(i)), a) for a in algs]
    read = {(r.path.rsplit("/", 1)[1], r.alg): (r.value, r.status) for r in hashes.file_digests(
        spark.createDataFrame([*asked, ("/none", "md5")], "path string, alg string")).collect()}
    assert read.pop(("none", "md5")) == (None, "missing")
    for i, c in enumerate(cases):
        want = {a: hashlib.new(a, c).hexdigest() for a in algs[:4]}
        want |= {"xxh64": xxhash.xxh64(c, seed=0).hexdigest(), "xxh3": xxhash.xxh3_64(c, seed=0).hexdigest()}
        for a in algs:
            expect = (want[a], "ok") if a in want else (None, "unsupported")
            assert got[(str(i), a)] == expect and read[(str(i), a)] == expect


def test_canonical_json(spark):
    import corpus as c

    e = {"z": None, "a": "tab\t\u000b\u001f é / \\u001F \"", "seq": 1, "n": {"b": [1, True], "a": {}}, "hash": "h", "sig": {"x": 1}}
    df = spark.createDataFrame([(json.dumps(e),)], "t string").select(hashes.canonical_json(F.parse_json("t")).alias("c"))
    assert df.first().c == c.canonical(e)


def test_files_that_cannot_be_read_are_no_mismatch(spark, tmp_path):
    (tmp_path / "a.mov").write_bytes(b"abc")
    asked = [(f"file:{tmp_path}/a.mov", "md5"), (f"{tmp_path}/none.mov", "md5"), (str(tmp_path), "md5"), ("s3a://b/c.mov", "md5")]
    got = hashes.file_digests(spark.createDataFrame(asked, "path string, alg string"), 2).collect()
    assert {(r.path, r.status) for r in got} == set(zip([p for p, _ in asked], ["ok", "missing", "unreadable", "unreadable"]))


def test_digests_by_uri(spark, tmp_path):
    (tmp_path / "a b").write_bytes(b"x")
    (tmp_path / "shut").write_bytes(b"y")
    (tmp_path / "shut").chmod(0)
    paths = {
        "plain": str(tmp_path / "a b"), "uri": f"file://{tmp_path}/a%20b", "one slash": f"file:{tmp_path}/a%20b", "none": f"file://{tmp_path}/no",
        "folder": str(tmp_path), "scheme": "nosuch://host/x", "word": "x",
    }
    got = {r.path: (r.value, r.status) for r in hashes.file_digests(
        spark.createDataFrame([(p, "md5") for p in [*paths.values(), str(tmp_path / "shut")]], "path string, alg string")).collect()}
    good = (hashlib.md5(b"x").hexdigest(), "ok")
    want = dict(plain=good, uri=good) | {"one slash": good, "none": (None, "missing")} | {k: (None, "unreadable") for k in ("folder", "scheme", "word")}
    assert {k: got[p] for k, p in paths.items()} == want
    try:
        (tmp_path / "shut").read_bytes()
    except PermissionError:
        assert got[str(tmp_path / "shut")] == (None, "unreadable")


def test_documents_written_twice_are_there_once(spark, tmp_path):
    one = spark.createDataFrame([("a", '{"x":1}'), ("b", '{"x":2}')], "roll string, body string")
    more = one.unionByName(spark.createDataFrame([("b", '{"x":3}')], "roll string, body string"))
    for by in (None, "roll"):
        out = str(tmp_path / str(by))
        for _ in range(2):
            sinks.write_documents(one, out, by)
        assert spark.read.text(out, recursiveFileLookup=True).count() == 2
        sinks.write_documents(more, out, by)
        sinks.write_documents(one.limit(0), out, by)
        assert sorted(r.body for r in sinks.read_documents(spark, out).collect()) == ['{"x":1}', '{"x":2}', '{"x":3}']


def test_listing_is_what_spark_lists(spark, tmp_path):
    for i in range(40):
        f = tmp_path / f"a{i % 3}" / f"b {i % 5}" / ("_hidden" if i == 7 else f"k={i}") / f"Ü{i} x.mov"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * (i + 1))
    (tmp_path / "top.txt").write_text("t")
    (tmp_path / ".dot").write_text("t")
    (tmp_path / "empty").mkdir()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path))
    want = sorted(tuple(r) for r in files.select(documents.plain_path(F.col("path")), "length", F.unix_millis("modificationTime")).collect())
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = documents.inventory(spark, root)
        assert sorted(tuple(r) for r in got.select("path", "length", F.unix_millis("mtime")).collect()) == want
    assert documents.inventory(spark, str(tmp_path), exts=["txt"]).count() == 1
    assert documents.inventory(spark, str(tmp_path / "empty")).count() == 0
