"""Rows, and how much work they cost, on tables built here."""

import datetime
import json
import random
import time

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clipledger.bindings import shelves
from clipledger.operators import flatten, ingest, integrity, ledger
from clipledger.sources import manifests


def _event_table(spark, folder, rows):
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    df.write.parquet(f"{folder}/events.parquet")


def test_pivot_has_a_document_per_user_and_day(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    at = lambda d, h: datetime.datetime(2024, 1, d, h, tzinfo=datetime.timezone.utc)
    kinds = ["purchase", "view", "purchase", "click", "purchase"]
    rows = [(i, at(1 + i // 2, i), 7, k, 2.0, '{"k": 1}') for i, k in enumerate(kinds)] + [(9, at(1, 3), 8, "view", 2.0, '{"k": 1}')]
    _event_table(spark, tmp_path, rows)
    got = {(r.sidecar_path, r.events, r.locks) for r in entry.queries()["p02_domain_pivot"](spark, str(tmp_path)).collect()}
    assert got == {
        ("shows/u7/g019723.omc.json", 2, 1), ("shows/u7/g019724.omc.json", 2, 1), ("shows/u7/g019725.omc.json", 1, 1),
        ("shows/u8/g019723.omc.json", 1, 0),
    }


def _one_group(spark, values):
    body = F.parse_json(F.lit(json.dumps(values)))
    return spark.range(1).select(
        F.lit("a").alias("sidecar_path"), F.lit("p").alias("json_path"), F.lit(0).alias("group_ix"),
        F.lit(flatten.schemas.EVENT_DOMAIN).alias("domain"), body.alias("value"),
    )


def test_events_bring_the_one_before(spark):
    for values in ([], [{"seq": 1}], [{"seq": i, "hash": f"h{i}"} for i in range(1, 6)], [{"seq": 1}, None, {"seq": 3}], {"seq": 1}, None):
        rows = flatten.events(_one_group(spark, values)).select(
            "event_ix", "seq", F.try_variant_get("prev_raw", "$.seq", "bigint").alias("prev")
        ).orderBy("event_ix").collect()
        seqs = [(v or {}).get("seq") for v in values] if isinstance(values, list) else []
        assert [tuple(r) for r in rows] == [(i, s, seqs[i - 1] if i else None) for i, s in enumerate(seqs)]


def test_a_long_chain_is_paired_in_one_pass(spark):
    """Quadratic pairing takes minutes here."""
    values = [{"seq": i, "hash": f"h{i}"} for i in range(1, 8001)]
    began = time.time()
    bad = ledger.chain_state(flatten.events(_one_group(spark, values))).where("seq_bad").count()
    assert (bad, time.time() - began < 40) == (0, True)


def test_first_entry_leaves_hashes_behind(spark):
    rows = [("m", "a", (2, 1), {"md5": "x"}), ("m", "a", (1, 5), {"md5": "y"}), ("m", "b", None, {"md5": "z"}), (None, "a", (1, 1), None)]
    df = spark.createDataFrame(rows, "manifest_path string, file string, entry_ix struct<line: bigint, part: bigint>, hashes map<string, string>")
    got = {(r.manifest_path, r.file, r.entry_ix, (r.hashes or {}).get("md5")) for r in integrity.first_entries(df).collect()}
    assert got == {("m", "a", (1, 5), "y"), ("m", "b", None, None), (None, "a", (1, 1), None)}
    plan = integrity.first_entries(df).select("manifest_path", "entry_ix")._jdf.queryExecution().optimizedPlan().toString()
    assert "min(entry_ix" in plan and "min_by" not in plan


def test_digests_cross_the_inventory_join_as_bytes(spark):
    shas = ["ab" * 32, "AB" * 32, "abc", "", None, "0f\n", "zz", "00" * 9000]
    rows = [(s, f"c{i}.mov" if i % 3 else f"c{i}.txt", i, {"sha256": s}) for i, s in enumerate(shas)]
    df = spark.createDataFrame(rows, "manifest_sha256 string, file string, entry_ix int, hashes map<string, string>").withColumn("manifest_path", F.lit("/m/a.mhl"))
    files = spark.createDataFrame([(f"c{i}.mov", i) for i in range(7)], "path string, length long")
    for root in (False, True):
        held = files.withColumn("path", F.concat(F.lit("/m/"), "path")) if root else files
        out = ingest.entry_outcomes(df, held, root_join=root)
        got = {r.entry_ix: r for r in out.collect()}
        assert [got[i].manifest_sha256 for i in range(len(shas))] == shas
        assert [got[i].value for i in range(len(shas))] == [s or None for s in shas]
        assert [got[i].file for i in range(len(shas))] == [r[1] for r in rows]
        assert [got[i].outcome for i in range(len(shas))] == ["not_clip", "ok", "ok", "not_clip", "no_hash", "ok", "not_clip", "missing_clip"]
        assert {r.entry_ix for r in ingest.usable(out).collect()} == {1, 2, 5}
        moved = ingest.usable(out).select("value", "manifest_sha256")._jdf.queryExecution().optimizedPlan().toString()
        assert "_value_bytes" in moved.split("Join", 1)[1]


def test_records_are_placed_across_batches():
    def batch(rows):
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), pa.int64(), pa.string()])]
        return pa.RecordBatch.from_arrays(cols, ["manifest_path", "block", "value"])

    rows = [("a", 0, "<"), ("a", 0, "x</"), ("a", 0, "\n<"), ("a", 0, "y</m:"), ("a", 9, "<"), ("a", 9, "z</"), ("b", 0, "q</"), ("b", 0, "</hashlist>")]
    want = [(0, 0), (1, 0), (2, 1), (3, 1), (0, 0), (1, 0), (0, 0), (1, 1)]
    for size in (1, 2, 3, 8):
        out = [r for b in manifests._placed(batch(rows[i : i + size]) for i in range(0, len(rows), size)) for r in b.to_pylist()]
        assert [(r["row"], r["n"]) for r in out] == want


def test_entries_of_manifests_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.mhl").write_text('<hashlist version="1.1"><hash><file>a.mov</file><md5>0</md5></hash><hash><file>b.mov</file></hash></hashlist>')
    (tmp_path / "b.mhl").write_text("Version: 2.0.0\nHashes:\n  - File: z.mov\n    md5: aa\n")
    rows, _ = manifests.manifests(spark, str(tmp_path), keep=False)
    assert {(r.entry_ix, r.file) for r in rows.collect()} == {(0, "a.mov"), (1, "b.mov"), (0, "z.mov")}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "row_number" not in plan


def _lineitem(spark, folder, suppliers):
    rows = [(k, k % 5, s, 1 + k % 3, 39.0 + k % 8, 10.0, 0.07 + k % 3 / 100, 0.04 + k % 2 / 50, "ANR"[k % 3], "OF"[k % 2]) for k, s in enumerate(suppliers)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, f"{names}, l_returnflag string, l_linestatus string").repartition(3).write.parquet(f"{folder}/lineitem.parquet")


def test_shelf_has_a_file_for_each_supplier_and_nothing_else(spark, tmp_path):
    """Spark's writer leaves a checksum beside each file, and starts processes for each."""
    suppliers = [1, 1, 2, 7, 2, 1, None, 40, 40, 7] * 3
    _lineitem(spark, tmp_path, suppliers)
    out = shelves._shelf(spark, str(tmp_path)).removeprefix("file:")
    import pathlib

    found = {p.relative_to(out).as_posix(): p.read_text() for p in pathlib.Path(out).rglob("*") if p.is_file()}
    names = {1: "1", 2: "2", 7: "7", 40: "40", None: "__HIVE_DEFAULT_PARTITION__"}
    assert set(found) == {f"supplier={n}/part-00000.txt" for n in names.values()}
    for supplier, name in names.items():
        text, mine = found[f"supplier={name}/part-00000.txt"], [k for k, s in enumerate(suppliers) if s == supplier]
        listed = [f"o{k} & {1 + k % 3}.mov" for k in mine]
        if supplier in (1, 7):
            assert text.startswith('<?xml version="1.0"?><hashlist version="1.1">\n<hash><file>') and text.endswith("</hash>\n</hashlist>\n")
            assert [x.split("</file>")[0].replace("&amp;", "&") for x in text.split("<file>")[1:]] == listed
        else:
            assert text.startswith("Version: 2.0.0\nHashes:\n  - File: ") and text.endswith("\n")
            assert [x.split("\n")[0] for x in text.split("- File: ")[1:]] == listed


def test_routing_scans_the_manifests_once_for_flags_and_heads(spark, tmp_path, monkeypatch):
    _lineitem(spark, tmp_path, [1, 1, 2, 7, 2, 1, 40, 40, 7] * 3)
    scans, scan = [], manifests.scan
    monkeypatch.setattr(manifests, "scan", lambda *a, **k: scans.append(a) or scan(*a, **k))
    got = {tuple(r) for r in entry.queries()["s06_format_routing"](spark, str(tmp_path)).collect()}
    assert got == {(1, "v1", "1.1", True, 9), (7, "v1", "1.1", True, 6), (2, "v2", "2.0.0", False, 6), (40, "v2", "2.0.0", False, 6)}
    assert len(scans) == 1


def test_yaml_is_parsed_as_its_patterns_tell(spark):
    """Whole-array steps against the patterns, text by text."""
    rng = random.Random(5)
    bits = ["\n", "\n  - ", "\n- ", "Hashes:", "\nHashes:", " ", "\t", "\r", "\r\n", "\x0b", "\f", "\u0085", "\u2028", "File: a", "md5: x", "key:", 'k: "q"', "k2: 'q'",
            "a: \"'x'\"", "#c", "{", "[", ":", "\u00e9", "\u00a0", "- ", "x: y: z", 'v: "q', "\ue000", 'w: a"b"', '"', "'"]
    lines = ["\n  - File: a b ", "\n    md5: 1 ", "\n   sha1: 'x' ", '\n    size: "q"', "\n  # c", "\n", "\r\n  - File: 'x'\r", "\n k:\u0085", '\n - z: "a"\u2028', "\n- z: 'a'\r"]
    some = lambda of, n: "".join(rng.choice(of) for _ in range(rng.randrange(n)))
    texts = ["Hashes:" + some(bits, 30) for _ in range(800)] + ["Version: 2.0\nHashes:" + some(lines, 12) for _ in range(800)] + ["", "Hashes:", "\nHashes:\n- "]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "manifest_path string, value string").repartition(3)
    want = manifests._exploded(df.select("manifest_path", manifests.yaml_items(F.col("value")).alias("flat"))).collect()
    got = manifests.yaml_entries(df).collect()
    told = lambda rows: {(r.manifest_path, r.entry_ix): (r.bad, not r.bad and r.entry) for r in rows}
    assert told(got) == told(want) and len(got) == len(want) and 0 < sum(r.bad for r in got) < len(got)


def test_small_manifests_share_tasks(spark, tmp_path):
    """Spark's own packing has a task for thirty files, however small they are."""
    for i in range(1400):
        (tmp_path / f"m{i}.mhl").write_text(f"Version: 2.0.0\nHashes:\n  - File: c{i}.mov\n")
    few = 4 * spark.sparkContext.defaultParallelism
    assert manifests.scan(spark, str(tmp_path)).rdd.getNumPartitions() == few
    rows, rejects = manifests.manifests(spark, str(tmp_path), keep=False)
    assert {(r.manifest_path.rsplit("/", 1)[1], r.file) for r in rows.collect()} == {(f"m{i}.mhl", f"c{i}.mov") for i in range(1400)}
    assert rejects.count() == 0


def test_blocks_are_surveyed_across_batches():
    yaml = "Version: 2.0.0\nHashes:\n  - File: a\n"
    rows = [
        ("a", 0, b"<hashlist><"), ("a", 0, b"x</"), ("a", 0, b"\n<"), ("a", 0, b"y</m:"), ("a", 9, b"z</"), ("a", 9, b"</hashlist>"), ("b", 0, yaml.encode()),
        ("c", 0, (yaml + "  - {File: a}\n").encode()), ("d", 0, b"q\xe9</"), ("d", 0, b"Hashes:\n- a"), ("e", 7, b"Hashes:\n- a"),
    ]
    want = {
        ("a", 0): (2, False, True, False, "<hashlist><"), ("a", 9): (1, True, True, False, None), ("b", 0): (0, False, True, False, yaml),
        ("c", 0): (0, False, True, True, yaml + "  - {File: a}\n"), ("d", 0): (1, False, False, True, "q\ufffd</"), ("e", 7): (0, False, True, False, None),
    }
    for size in (1, 2, 3, 20):
        batches = []
        for i in range(0, len(rows), size):
            path, block, value = zip(*rows[i : i + size])
            texts = pa.array(value, pa.binary()).view(pa.string())
            batches.append(pa.RecordBatch.from_arrays([pa.array(path), pa.array(block, pa.int64()), texts], ["manifest_path", "block", "value"]))
        out = [r for b in manifests._surveyed(iter(batches)) for r in b.to_pylist()]
        assert len(out) == len(want)
        assert {(r["manifest_path"], r["block"]): (r["entries"], r["closed"], r["valid"], r["bad"], r["head"]) for r in out} == want
