"""Small corpora on disk: documents with media, manifests, colour files and keys."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from clipledger import schemas


def canonical(event: dict) -> str:
    body = {k: v for k, v in event.items() if k not in ("hash", "sig")}
    return json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def event_hash(event: dict) -> str:
    return "sha256:" + hashlib.sha256(canonical(event).encode()).hexdigest()


def rehash(events: list[dict], start: int = 0) -> None:
    for e in events[start:]:
        e["hash"] = event_hash(e)


def chain(actions: list[str], kid: str = "kid-1") -> list[dict]:
    out, prev = [], None
    for i, action in enumerate(actions):
        e = {
            "seq": i + 1, "ts": f"2024-03-0{i + 1}T10:00:00Z", "actor": {"id": "urn:email:a@b", "role": "DIT"},
            "tool": {"name": "tool", "version": "1"}, "action": action, "target": "urn:uuid:c1", "prevHash": prev,
        }
        e["hash"] = prev = event_hash(e)
        e["sig"] = {"alg": "ed25519", "kid": kid, "value": "c2ln"}
        out.append(e)
    return out


CDL = """<ColorCorrectionCollection xmlns="urn:ASC:CDL:v1.01"><ColorCorrection id="c"><Description>d</Description>
<SOPNode><Slope>1.1 1.0 0.9</Slope><Offset>0.01 0.0 0.0</Offset><Power>1 1 1</Power></SOPNode>
<SATNode><Saturation>{sat}</Saturation></SATNode></ColorCorrection></ColorCorrectionCollection>"""
AMF = """<aces:acesMetadataFile xmlns:aces="urn:ampas:aces:amf:v1.0" xmlns:cdl="urn:ASC:CDL:v1.01"><aces:pipeline>
<aces:lookTransform applied="false"><aces:description>look</aces:description><cdl:SOPNode><cdl:Slope>1.1 1.0 0.9</cdl:Slope>
<cdl:Offset>0.01 0.0 0.0</cdl:Offset><cdl:Power>1 1 1</cdl:Power></cdl:SOPNode><cdl:SatNode><cdl:Saturation>0.9</cdl:Saturation></cdl:SatNode>
</aces:lookTransform><aces:lookTransform><aces:description>no numbers</aces:description></aces:lookTransform></aces:pipeline></aces:acesMetadataFile>"""


def write_show(root: Path) -> dict:
    """One good document with everything beside it; returns the document."""
    (root / "roll").mkdir(parents=True)
    clip, fdl = b"clip bytes", b"{}"
    (root / "roll/A001_C001.mov").write_bytes(clip)
    (root / "roll/frame.fdl").write_bytes(fdl)
    (root / "roll/A001_C001.cdl").write_text(CDL.format(sat="0.9"))
    (root / "roll/A001_C001.amf").write_text(AMF)
    manifest = f"Version: 2.0.0\nHashes:\n  - File: A001_C001.mov\n    Size: 10\n    LastModificationDate: 2024-03-01T00:00:00Z\n    sha1: {hashlib.sha1(clip).hexdigest()}\n"
    (root / "roll/A001.mhl").write_text(manifest)

    def art(n, role, kind, path, alg="sha256", **more):
        digest = hashlib.new(alg, (root / path).read_bytes()).hexdigest()
        return {"id": f"urn:uuid:{n}", "role": role, "kind": kind, "path": "./" + path, "hash": {"alg": alg, "value": digest}, **more}

    arts = [
        art(1, "clip-integrity", "source-file", "roll/A001_C001.mov", "sha1"),
        art(2, "integrity", "asc-mhl", "roll/A001.mhl", mhlEntry="A001_C001.mov", immutable=True),
        art(3, "framing", "asc-fdl", "roll/frame.fdl"),
        art(4, "color-pipeline", "cdl", "roll/A001_C001.cdl"),
        art(5, "color-pipeline", "amf", "roll/A001_C001.amf"),
    ]
    events = chain(["create", "lock", "update"])
    lock = {
        "target": "urn:uuid:c1", "scope": "entity", "by": "urn:email:a@b", "at": events[1]["ts"],
        "sig": {"alg": "ed25519", "kid": "kid-1", "value": "c2ln"},
    }
    return {
        "Asset": [{
            "schemaVersion": "v2.8", "entityType": "Asset", "identifier": [], "name": "A001_C001",
            "assetFC": {"functionalType": "capture.ocf", "functionalProperties": {"customData": [
                {"domain": schemas.ARTIFACT_DOMAIN, "value": arts}, {"domain": schemas.EVENT_DOMAIN, "value": events},
                {"domain": schemas.LOCK_DOMAIN, "value": [lock]},
            ]}},
        }]
    }


def parts(doc: dict) -> tuple[list, list, list]:
    groups = doc["Asset"][0]["assetFC"]["functionalProperties"]["customData"]
    return tuple(g["value"] for g in groups)


def write_keyring(path: Path, until: str = "2024-12-31T00:00:00Z") -> None:
    path.write_text(json.dumps({"keys": {
        "kid-1": {"publicKey": "pk", "validFrom": "2024-03-01T10:00:00Z", "validUntil": until}, "kid-old": "bare-key",
    }}, indent=2))
