"""Ingest, re-hash, export, match, remap, health and the stream, end to end on files."""

import datetime
import hashlib
import json

import corpus
import pytest
from pyspark.sql import functions as F

from clipledger.functions import hashes
from clipledger.operators import flatten, rollup
from clipledger.plans import export, health, ingest, match
from clipledger.sources import documents as docs
from clipledger.sources import manifests
from clipledger.streaming import watch


def now():
    return F.to_timestamp(F.lit("2024-05-01T00:00:00Z"))


def sign():
    return F.pandas_udf(lambda t: t.map(lambda _: "c2ln"), "string")


def test_ingest_and_rehash_agree_and_validate(spark, tmp_path):
    root = tmp_path / "s"
    corpus.write_show(root)
    inv = docs.inventory(spark, str(root))
    rows, _ = manifests.manifests(spark, str(root))
    built, outcomes = ingest.from_manifests(rows, inv, now(), aux=inv, kid="kid-1", signer=sign())
    assert [r.outcome for r in outcomes.collect()] == ["ok"]
    files = manifests.manifest_files(spark, str(root))
    again = ingest.from_media(inv, files, "sha1", now(), aux=inv, kid="kid-1", signer=sign())
    for df in (built, again):
        r = df.collect()
        assert [x.value for x in r] == [hashlib.sha1(b"clip bytes").hexdigest()]
        arts, events, locks = corpus.parts(json.loads(r[0].body))
        assert [a["kind"] for a in arts] == ["source-file", "asc-mhl", "amf", "cdl", "asc-fdl"] and locks == []
        assert corpus.event_hash(events[0]) == events[0]["hash"] == r[0].chain_head
        assert arts[1]["mhlEntry"] == "A001_C001.mov" and arts[1]["immutable"] is True
    from clipledger.plans import audit as plan

    corpus.write_keyring(tmp_path / "k.json")
    found = plan.audit(plan.Inputs(docs.document_rows(built), inventory=inv, keyring=docs.keyring(spark, str(tmp_path / "k.json")))).findings
    assert {r.code for r in found.collect()} == {"unverified"}


def test_one_clip_and_relative_paths(spark, tmp_path):
    from clipledger.operators.ingest import Identity

    root = tmp_path / "s"
    corpus.write_show(root)
    inv = docs.inventory(spark, str(root))
    clip = str(root / "roll/A001_C001.mov")
    who = Identity(actor="urn:user:me", role="DIT", reason="one clip")
    (row,) = ingest.one_clip(inv, clip, "md5", now(), who, base_dir=str(root)).collect()
    body = json.loads(row.body)
    arts, events, _ = corpus.parts(body)
    assert (arts[0]["path"], arts[0]["hash"]) == ("./roll/A001_C001.mov", {"alg": "md5", "value": hashlib.md5(b"clip bytes").hexdigest()})
    assert events[0]["actor"] == {"id": "urn:user:me", "role": "DIT"} and body["Asset"][0]["provenance"]["reason"] == "one clip"
    from clipledger.plans import audit as plan

    found = plan.audit(plan.Inputs(docs.document_rows(ingest.one_clip(inv, clip, "md5", now(), who, base_dir=str(root))), inventory=inv, base_dir=str(root)))
    assert found.findings.where("stage = '6'").count() == 0 and found.artifacts.first().resolved == clip
    assert ingest.one_clip(inv, str(root / "none.mov"), "md5", now(), who).count() == 0
    report = json.loads(rollup.report_json(found.reports).first().report)
    assert set(report) == {"target", "base_dir", "stages", "errors", "summary"} and report["base_dir"] == str(root)
    said = {s["stage"]: s["lines"] for s in report["stages"]}
    assert said["6"] == ["OK"] and said["4"] == ["not checked: no keyring"] and said["8"] == ["not checked: no manifest"]


def test_one_clip_with_side_files_and_record(spark, tmp_path):
    from clipledger.operators.ingest import Identity
    from clipledger.plans import audit as plan

    root = tmp_path / "s"
    corpus.write_show(root)
    (root / "roll/edit.ale").write_text("Heading\n")
    inv = docs.inventory(spark, str(root))
    clip, who = str(root / "roll/A001_C001.mov"), Identity(actor="urn:user:me", role="DIT", reason="one clip")
    made = next((root / "roll").rglob("*.mhl"))
    side = {"manifest": str(made), "amf": str(root / "roll/A001_C001.amf"), "ale": str(root / "roll/edit.ale"), "cdl": str(root / "none.cdl")}
    built = ingest.one_clip(inv, clip, "sha1", now(), who, "kid-1", sign(), str(root), side_files=side, manifest_entry="A001_C001.mov")
    body = json.loads(built.first().body)
    arts, _, _ = corpus.parts(body)
    assert [(a["role"], a["kind"], a.get("subtype")) for a in arts] == [
        ("clip-integrity", "source-file", None), ("integrity", "asc-mhl", None), ("color-pipeline", "amf", None),
        ("edit-metadata", "resolve-export", "ale"),
    ]
    assert arts[3]["path"] == "./roll/edit.ale" and arts[3]["hash"]["value"] == hashlib.sha256(b"Heading\n").hexdigest()
    asset = body["Asset"][0]
    assert asset["description"] == f"Ingested from {made.name}" and asset["AssetSC"]["entityType"] == "AssetSC"
    assert asset["provenance"]["CreatedBy"]["identifier"][0]["identifierValue"] == "urn:user:me"
    assert asset["AssetSC"]["structuralProperties"]["codec"] == "QuickTime/ProRes" and asset["AssetSC"]["structuralProperties"]["purpose"] == "general"
    found = plan.audit(plan.Inputs(docs.document_rows(built), inventory=inv, base_dir=str(root), only={"1", "2", "6"}))
    assert found.findings.count() == 0
    for bad in ({"manifest": "m"}, {"lut": "x"}):
        with pytest.raises(ValueError):
            ingest.one_clip(inv, clip, "md5", now(), who, side_files=bad)


def test_report_lines_of_findings(spark):
    rows = [("d", "3", "error", "event[1]", "seq_gap", "3 after 1", 1), ("d", "3", "warning", "event[0]", "late", None, 1)]
    found = spark.createDataFrame(rows, "sidecar_path string, stage string, severity string, where_ string, code string, detail string, n long")
    targets = spark.createDataFrame([("d",), ("e",), ("e",)], "sidecar_path string")
    got = {(r.sidecar_path, r.stage): r for r in rollup.stage_results(found, targets, ["3", "6"], skipped={"6": "inventory"}).collect()}
    assert got["d", "3"].lines == ["event[0] warning: late", "event[1] error: seq_gap 3 after 1"] and got["d", "3"].errors == 1
    assert got["e", "3"].lines == ["OK"] and got["e", "6"].lines == ["not checked: no inventory"] and len(got) == 4
    assert "lines" not in rollup.stage_results(found, targets, ["3"]).columns


def test_export_match_and_remap(spark, tmp_path):
    root = tmp_path / "s"
    doc = corpus.write_show(root)
    rows = spark.createDataFrame([("/d/A001_C001.omc.json", json.dumps(doc))], "sidecar_path string, body string")
    d = docs.document_rows(rows)
    row = export.export(d, now()).first()
    events = corpus.parts(doc)[1]
    assert (row.Name, row.Tape, row.DWC_Events, row.DWC_Locks, row.DWC_LockedBy) == ("A001_C001", "A001", "3", "1", "kid-1")
    assert row.DWC_ChainHead == events[-1]["hash"].split(":")[1][:12] and row.DWC_LastVerified == "2024-05-01T00:00:00Z"
    assert export.export(d, now(), tape="B9").first().Tape == "B9"
    clips = spark.createDataFrame([(0, "other"), (1, "A001_C001_proxy")], "clip_ix long, clip_name string")
    hit = match.match(d.withColumn("sidecar_ix", F.lit(0).cast("bigint")), clips, now()).collect()
    assert [(r.clip_ix, r.score, r.DWC_Kid) for r in hit] == [(1, 90, "kid-1")]
    near = match.by_adjacency(spark.createDataFrame([("/d/A001_C001.mov",), ("/d/no.mov",)], "path string"), d, now()).collect()
    assert [r.path for r in near] == ["/d/A001_C001.mov"]
    inv = spark.createDataFrame([("up/roll/A001.mhl", 0), ("x/frame.fdl", 1), ("y/roll/frame.fdl", 2)], "path string, ix long")
    from clipledger.plans import audit as plan

    repaired = match.remap_and_audit(plan.Inputs(d, base_dir="/d"), inv)
    rows = {r.artifact_ix: r for r in repaired.artifacts.collect()}
    assert [rows[i].path for i in range(3)] == ["./roll/A001_C001.mov", "up/roll/A001.mhl", "y/roll/frame.fdl"]
    assert rows[2].resolved == "/d/y/roll/frame.fdl"
    # A path elsewhere in the document, inside an event too, is nobody's artifact: the chain stays whole.
    assert {r.code for r in repaired.findings.where("stage in ('3', '4')").collect()} == set()


def test_health(spark, tmp_path):
    doc = corpus.write_show(tmp_path / "s")
    corpus.parts(doc)[0][2]["hash"]["alg"] = "crc"
    rows = spark.createDataFrame([("a", json.dumps(doc)), ("b", "{"), ("c", "{}")], "sidecar_path string, body string")
    corpus.write_keyring(tmp_path / "k.json", until="2024-05-10T00:00:00Z")
    c = health.Corpus(docs.document_rows(rows), docs.keyring(spark, str(tmp_path / "k.json")), now())
    got = health.health(c)
    assert {r.title: (r.status, r.rows) for r in got.collect()} == {
        "hash algorithms": ("fail", 1), "keyring validity": ("pass", 0), "documents parse": ("fail", 2), "keys expired": ("pass", 0),
        "keys expiring": ("warn", 1), "keyring present": ("pass", 2),
    }
    assert health.overall(got).first().status == "fail"


def test_watch_stream(spark, tmp_path):
    root, lists = tmp_path / "s", tmp_path / "lists"
    (root / "r1").mkdir(parents=True)
    (root / "r2").mkdir()
    for r, data in (("r1", b"one"), ("r2", b"two")):
        (root / r / "A001.mov").write_bytes(data)
        (root / r / "m.mhl").write_text(f"Hashes:\n  - File: A001.mov\n    sha1: {hashlib.sha1(data).hexdigest()}\n")
    (root / "r2/copy.mhl").write_text((root / "r2/m.mhl").read_text())
    (root / "bad.mhl").write_text("Hashes:\n  - File: [x")
    t0 = datetime.datetime(2024, 1, 1)

    def listing(second, *paths):
        rows = [(str(root / p), 1, t0, t0 + datetime.timedelta(seconds=second)) for p in paths]
        from clipledger import schemas

        spark.createDataFrame(rows, schemas.FILE_OBS).coalesce(1).write.mode("append").parquet(str(lists))

    w = watch.Watch(str(tmp_path / "out"), lambda: docs.inventory(spark, str(root)), 3, kid="k", signer=sign())

    def drain():
        w.start(watch.observations(spark, str(lists)), str(tmp_path / "ck")).awaitTermination()

    listing(0, "r1/m.mhl")
    drain()
    assert w.table(spark, "documents") is None and w.documents(spark) is None
    listing(4, "r1/m.mhl")
    listing(8, "r1/m.mhl")
    drain()
    first = w.documents(spark).collect()
    assert [r.sidecar_path.rsplit("/", 1)[1] for r in first] == ["A001.omc.json"]
    listing(20, "r2/m.mhl", "r2/copy.mhl", "bad.mhl")
    listing(24, "r2/m.mhl", "r2/copy.mhl", "bad.mhl")
    drain()
    # The older document loses its clean name as well.
    names = sorted(r.sidecar_path.rsplit("/", 1)[1] for r in w.documents(spark).collect())
    assert names == sorted(f"A001.{hashlib.sha1(x).hexdigest()[:8]}.omc.json" for x in (b"one", b"two"))
    stats = {}
    for r in w.table(spark, "stats").collect():
        stats[r.outcome] = stats.get(r.outcome, 0) + r.n
    assert stats == {"manifests": 3, "documents": 2, "refreshed": 0, "conflicts": 1, "ok": 2, "quarantined": 0, "errors": 1}
    assert w.table(spark, "processed").count() == 3
    assert {r.status for r in watch.recent_emissions(w.table(spark, "emissions")).collect()} == {"signed"}
    assert w.log_table(spark).count() == 2


def shelf(root, n):
    """n manifests over four clip names, every third one a new hash of its name."""
    root.mkdir(parents=True)
    out = []
    for i in range(n):
        folder = root / f"r{i}"
        folder.mkdir()
        data = f"{i % 4}-{i // 3 % 2}".encode()
        (folder / f"A{i % 4}.mov").write_bytes(data)
        (folder / "m.mhl").write_text(f"Hashes:\n  - File: A{i % 4}.mov\n    sha1: {hashlib.sha1(data).hexdigest()}\n    note: n{i}\n")
        out.append(str(folder / "m.mhl"))
    (root / "bad.mhl").write_text("Hashes:\n  - File: [x")
    return [*out, str(root / "bad.mhl"), str(root / "gone.mhl")]


def shown(w, spark):
    """What a reader sees of a watch, without batch and attempt; documents as name, clip and hash."""
    docs = sorted((r.sidecar_path.rsplit("/", 1)[1], r.alg, r.value) for r in w.documents(spark).collect())
    rejects = sorted((r.manifest_path, r.code) for r in w.table(spark, "rejects").collect())
    stats = {}
    for r in w.table(spark, "stats").collect():
        stats[r.outcome] = stats.get(r.outcome, 0) + r.n
    return docs, rejects, stats, w.log_table(spark).count()


def test_five_batches_equal_one(spark, tmp_path):
    settled = [(p,) for p in shelf(tmp_path / "s", 12)]

    def watch_over(name, parts):
        w = watch.Watch(str(tmp_path / name), lambda: docs.inventory(spark, str(tmp_path / "s")), kid="k", signer=sign(), audit_files=True)
        for batch, rows in enumerate(parts):
            w.process(spark.createDataFrame(rows, "path string"), batch)
        return w

    one, five = watch_over("one", [settled]), watch_over("five", [settled[i::5] for i in range(5)])
    a, b = shown(one, spark), shown(five, spark)
    assert a[:2] == b[:2] and a[3] == b[3] == len(a[0])
    assert {len(n.split(".")) for n, _, _ in a[0]} == {4} and len(a[0]) == 8  # every name has two hashes
    assert {k: a[2][k] for k in ("manifests", "documents", "refreshed", "ok", "errors")} == {
        k: b[2][k] for k in ("manifests", "documents", "refreshed", "ok", "errors")
    } == {"manifests": 13, "documents": 8, "refreshed": 4, "ok": 8, "errors": 2}


def test_a_batch_that_dies_leaves_one_set_of_rows(spark, tmp_path):
    settled = spark.createDataFrame([(p,) for p in shelf(tmp_path / "s", 5)], "path string")

    class Fragile(watch.Watch):
        broken = True

        def _write(self, df, name, *rest, **more):
            if name == "processed" and self.broken:
                raise OSError("lost")
            super()._write(df, name, *rest, **more)

    w = Fragile(str(tmp_path / "out"), lambda: docs.inventory(spark, str(tmp_path / "s")), kid="k", signer=sign())
    try:
        w.process(settled, 0)
        raise AssertionError("should have died")
    except OSError:
        pass
    assert w.documents(spark) is None and w.table(spark, "rejects") is None
    w.broken = False
    w.process(settled, 0)
    w.process(settled, 0)  # done again although it was committed
    got, rejects, stats, logged = shown(w, spark)
    assert len(got) == logged == stats["documents"] == 5 and len(rejects) == stats["errors"] == 2


def test_log_rows_are_made_up_for(spark, tmp_path, monkeypatch):
    paths = shelf(tmp_path / "s", 4)
    w = watch.Watch(str(tmp_path / "out"), lambda: docs.inventory(spark, str(tmp_path / "s")), kid="k", signer=sign())
    with monkeypatch.context() as m:
        m.setattr(export, "export", lambda *a, **k: 1 / 0)
        w.process(spark.createDataFrame([(p,) for p in paths[:2]], "path string"), 0)
        assert w._read(spark, "log") is None
    w.process(spark.createDataFrame([(p,) for p in paths[2:]], "path string"), 1)
    assert w.log_table(spark).count() == w.documents(spark).count() == 4


def test_expired_paths_count_as_new(spark, tmp_path):
    from clipledger import schemas

    t0 = datetime.datetime(2024, 1, 1)
    seen = [("a", 0), ("a", 20), ("b", 20), ("b", 500), ("b", 520), ("a", 530), ("a", 600), ("b", 600)]
    for path, s in seen:
        row = [(path, 1, t0, t0 + datetime.timedelta(seconds=s))]
        spark.createDataFrame(row, schemas.FILE_OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def fired(name, expire):
        stream = watch.settle(watch.observations(spark, str(tmp_path / "in"), max_files=1), 15, expire)
        out = watch.run_to_table(spark, stream, str(tmp_path / name), str(tmp_path / f"{name}-ck"))
        return sorted((r.path, (r.settled_at - t0).seconds) for r in out.collect())

    assert fired("kept", None) == [("a", 20), ("b", 500)]
    # The watermark is that of the batch before, so b is still known when it comes back at 500.
    assert fired("gone", 60) == [("a", 20), ("a", 600), ("b", 500)]


def test_settle_state_equals_batch(spark, tmp_path):
    """Split over several micro-batches the stream fires exactly where the batch form does."""
    import random

    from clipledger import schemas
    from clipledger.operators import rollup

    rnd, t0 = random.Random(2), datetime.datetime(2024, 1, 1)
    rows = [(f"p{i % 7}", rnd.randrange(2), t0, t0 + datetime.timedelta(seconds=i)) for i in range(300)]
    for i in range(0, 300, 60):
        spark.createDataFrame(rows[i:i + 60], schemas.FILE_OBS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # Files are read oldest first, one per batch.
    stream = watch.settle(watch.observations(spark, str(tmp_path / "in"), max_files=1), 15)
    got = watch.run_to_table(spark, stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    want = rollup.settled(spark.createDataFrame(rows, schemas.FILE_OBS), 15, segment=40)
    cols = ["path", "length", "changed_at", "settled_at"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
