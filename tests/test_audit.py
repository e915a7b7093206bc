"""The audit on files: one good document, then one change at a time."""

import copy
import hashlib
import json

import corpus
import pytest

from clipledger.plans import audit as plan
from clipledger.sources import documents as docs
from clipledger.sources import looks, manifests
from pyspark.sql import functions as F


@pytest.fixture()
def show(tmp_path):
    root = tmp_path / "show"
    return root, corpus.write_show(root)


def accepts():
    """A verifier for the signatures of the corpus."""
    return F.pandas_udf(lambda text, sig, key: sig == "c2ln", "boolean")


def run(spark, root, doc, **more):
    more.setdefault("verifier", accepts())
    (root / "clip.omc.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))
    ring = root.parent / "keyring.json"
    corpus.write_keyring(ring, more.pop("until", "2024-12-31T00:00:00Z"))
    rows, rejects = manifests.manifests(spark, str(root))
    cdls, bad = looks.cdls(spark, str(root))
    out = plan.audit(plan.Inputs(
        docs.documents(spark, str(root)), inventory=docs.inventory(spark, str(root)), keyring=docs.keyring(spark, str(ring)),
        manifest=rows, manifest_rejects=rejects, cdls=cdls, cdl_errors=bad, looks=looks.amf_looks(spark, str(root)), **more,
    ))
    got = {}
    for r in out.findings.collect():
        got.setdefault(r.stage, []).append(r.code)
    return {k: sorted(v) for k, v in got.items()}, out


def test_good_document_passes(spark, show):
    got, out = run(spark, *show)
    assert got == {}
    rep = out.reports.collect()
    assert len(rep) == 1 and rep[0].summary == "OK" and len(rep[0].stages) == 9


def mutate(doc, fn):
    d = copy.deepcopy(doc)
    fn(d, *corpus.parts(d))
    return d


MUTANTS = {
    "drop kind": (lambda d, a, e, k: a[2].pop("kind"), {"2": ["missing_kind", "missing_mhlEntry", "missing_subtype"]}),
    "extra event key": (lambda d, a, e, k: e[2].update(note=1), {"2": ["extra_key"], "4": ["hash_mismatch"]}),
    "first seq 99": (
        lambda d, a, e, k: e[0].update(seq=99),
        {"2": ["later_without_prevHash"], "3": ["seq_gap", "seq_gap"], "4": ["hash_mismatch"]},
    ),
    "actor role": (lambda d, a, e, k: e[1]["actor"].update(role="X"), {"4": ["hash_mismatch"]}),
    "role and rehash": (lambda d, a, e, k: (e[0]["actor"].update(role="X"), corpus.rehash(e[:1])), {"3": ["link_broken"]}),
    "unknown kid": (
        lambda d, a, e, k: (e[2]["sig"].update(kid="nobody")), {"4": ["unknown_kid"]},
    ),
    "before validity": (lambda d, a, e, k: (e[2].update(ts="2024-02-01T00:00:00Z"), corpus.rehash(e, 2)), {"4": ["before_valid_from"]}),
    "lock time": (lambda d, a, e, k: k[0].update(at="2024-03-02T10:00:01Z"), {"5": ["no_match"]}),
    "lock kid": (lambda d, a, e, k: k[0]["sig"].update(kid="kid-old"), {"5": ["kid_mismatch"]}),
    "entry name": (lambda d, a, e, k: a[1].update(mhlEntry="other.mov"), {"8": ["no_entry"]}),
    "missing file": (lambda d, a, e, k: a[2].update(path="./roll/none.fdl"), {"6": ["missing"]}),
    "case of digest": (lambda d, a, e, k: a[2]["hash"].update(value=a[2]["hash"]["value"].upper()), {"6": ["mismatch"]}),
    "not an urn": (lambda d, a, e, k: k[0].update(by="me"), {"2": ["pattern_by"], "5": ["no_match"]}),
    "no schema version": (lambda d, a, e, k: d["Asset"][0].pop("schemaVersion"), {"1": ["missing"]}),
    "empty artifacts": (lambda d, a, e, k: a.clear(), {"2": ["group_empty"]}),
}


@pytest.fixture(scope="module")
def mutants(spark, tmp_path_factory):
    """All mutants beside the same files, in one audit."""
    root = tmp_path_factory.mktemp("mutants") / "show"
    good = corpus.write_show(root)
    for i, (change, _) in enumerate(MUTANTS.values()):
        (root / f"m{i}.omc.json").write_text(json.dumps(mutate(good, change), indent=2))
    _, out = run(spark, root, good)
    found = {}
    for r in out.findings.collect():
        found.setdefault(r.sidecar_path.rsplit("/", 1)[1], {}).setdefault(r.stage, []).append(r.code)
    return found


@pytest.mark.parametrize("name", MUTANTS)
def test_mutant(mutants, name):
    got = mutants.get(f"m{list(MUTANTS).index(name)}.omc.json", {})
    assert {k: sorted(v) for k, v in got.items()} == MUTANTS[name][1]


def test_good_document_among_mutants(mutants):
    assert "clip.omc.json" not in mutants


def test_flipped_clip_byte_fails_6_and_8(spark, show):
    root, doc = show
    (root / "roll/A001_C001.mov").write_bytes(b"Clip bytes")
    assert run(spark, root, doc)[0] == {"6": ["mismatch"], "8": ["mismatch"]}
    # Trusting the manifest moves the clip to stage 8 alone.
    assert run(spark, root, doc, trust_manifest=True)[0] == {"8": ["mismatch"]}


def test_colour_shift_warns_only(spark, show):
    root, doc = show
    (root / "roll/A001_C001.cdl").write_text(corpus.CDL.format(sat="0.91"))
    corpus.parts(doc)[0][3]["hash"]["value"] = hashlib.sha256((root / "roll/A001_C001.cdl").read_bytes()).hexdigest()
    got, out = run(spark, root, doc)
    assert got == {"9": ["colour_mismatch"]}
    assert out.reports.first().summary == "OK"


def test_missing_is_skip_and_unparseable(spark, show):
    root, doc = show
    (root / "roll/frame.fdl").unlink()
    assert run(spark, root, doc, missing_is_skip=True)[0] == {}
    assert run(spark, root, "{broken")[0] == {"1": ["unparseable"]}


def test_vocabulary(spark, show):
    root, doc = show
    words = spark.createDataFrame([("$.Asset[0].assetFC.functionalType", "other")], "where_ string, value string")
    got, _ = run(spark, root, doc, vocabulary=words, vocabulary_paths=["$.Asset[0].assetFC.functionalType"])
    assert got == {"7": ["not_in_vocabulary"]}


def test_every_asset_is_judged(spark, show):
    root, doc = show
    leaf = {"schemaVersion": "v", "entityType": "Asset"}
    doc["Asset"] += [{"entityType": 7, "identifier": [], "schemaVersion": "v", "Asset": [{**leaf, "identifier": [], "Asset": [leaf, {**leaf, "Asset": [{}]}]}]}]
    _, out = run(spark, root, doc)
    assert sorted((r.where_, r.code) for r in out.findings.where("stage = '1'").collect()) == sorted([
        ("$.Asset[1].entityType", "wrong_type"), ("$.Asset[1].Asset[0].Asset[0].identifier", "missing"),
        ("$.Asset[1].Asset[0].Asset[1].identifier", "missing"),
        *[(f"$.Asset[1].Asset[0].Asset[1].Asset[0].{k}", "missing") for k in ("schemaVersion", "entityType", "identifier")],
    ])
    words = spark.createDataFrame([("$.Asset[*].entityType", "Asset"), ("$.Asset[*].entityType", "7")], "where_ string, value string")
    doc["Asset"][1]["entityType"] = "Reel"
    _, out = run(spark, root, doc, vocabulary=words, vocabulary_paths=["$.Asset[*].entityType"])
    assert [(r.where_, r.detail) for r in out.findings.where("stage = '7'").collect()] == [("$.Asset[1].entityType", "Reel")]


def test_an_event_that_is_text_is_one_finding(spark, show):
    root, doc = show
    corpus.parts(doc)[1].append("oops")
    _, out = run(spark, root, doc)
    assert [(r.code, r.where_.rsplit(".", 1)[1]) for r in out.findings.where("stage = '2'").collect()] == [("not_object", "value[3]")]


def test_a_chain_of_a_million_events(spark):
    from clipledger.operators import ledger

    rows = spark.range(1_000_000).select(F.lit("c").alias("k"), F.col("id").alias("ix"))
    built = ledger.build_chain(rows, ["k"], "ix", F.lit("h"), F.col("ix").cast("string"))
    last = built.orderBy(F.col("ix").desc()).first()
    prev = None
    for i in range(1_000_000):
        before, prev = prev, "sha256:" + hashlib.sha256(f"h{'null' if prev is None else chr(34) + prev + chr(34)}{i}".encode()).hexdigest()
    assert (last.prev_hash, last.hash) == (before, prev)


def test_verifier_is_asked(spark, show):
    root, doc = show
    never = F.pandas_udf(lambda text, sig, key: text.map(lambda _: False), "boolean")
    assert run(spark, root, doc, verifier=never)[0] == {"4": ["bad_signature"] * 3}


def test_without_a_verifier_nothing_is_signed(spark, show):
    from clipledger.plans import export

    root, doc = show
    corpus.parts(doc)[1][0]["sig"]["value"] = "FORGED"
    got, out = run(spark, root, doc, verifier=None)
    assert got == {"4": ["unverified"] * 3}
    stage = out.stages.where("stage = '4'").first()
    assert (stage.status, stage.errors, stage.warnings) == ("warn", 0, 3)
    moment = F.to_timestamp(F.lit("2024-05-01T00:00:00Z"))
    d = docs.documents(spark, str(root))
    assert export.export(d, moment, out.stages).first().DWC_Signed == "false"
    assert run(spark, root, doc)[0] == {"4": ["bad_signature"]}


def test_nested_and_deep_groups(spark, tmp_path):
    from clipledger.operators import flatten

    doc = corpus.write_show(tmp_path / "s")
    inner = doc["Asset"][0]
    reel = {"Asset": [{"AssetSC": {"structuralProperties": {"assetGroup": {"memberCount": 2}}}, "Asset": [inner, copy.deepcopy(inner)]}]}
    deep = {"x": {"y": [{"customData": inner["assetFC"]["functionalProperties"]["customData"]}]}}
    entries = inner["assetFC"]["functionalProperties"]["customData"]
    top = {"customData": entries[:1], "customdata": entries, "a": [[], [{"customData": {"b": {"customData": entries[1:]}}}], 7, None]}
    texts = {"reel": json.dumps(reel), "deep": json.dumps(deep), "top": json.dumps(top), "bad": "{"}
    rows = spark.createDataFrame(list(texts.items()), "sidecar_path string, body string")
    d = docs.document_rows(rows)
    groups = flatten.custom_data(d)
    n = {(r.sidecar_path, r.json_path): r["count"] for r in groups.groupBy("sidecar_path", "json_path").count().collect()}
    assert n == {
        ("reel", "Asset/0/Asset/0/assetFC/functionalProperties/customData"): 3,
        ("reel", "Asset/0/Asset/1/assetFC/functionalProperties/customData"): 3, ("deep", "x/y/0/customData"): 3,
        ("top", "customData"): 1, ("top", "a/1/0/customData/b/customData"): 2,
    }
    assert flatten.events(groups).count() == 12
    assert [tuple(r) for r in flatten.reel_members(d).collect()] == [("reel", 2, 2)]
    assert {(r.sidecar_path, r.code) for r in flatten.corrupt(flatten.parse(d), groups).collect()} == {("bad", "unparseable")}
