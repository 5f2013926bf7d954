"""Signatures by the standard's cases, and bundles as text against a verifier that reads one at a time."""

import base64
import hashlib
import json
import struct

from pyspark.sql import functions as F

from loglake.operators import checkpoints, evidence, ledger
from loglake.plans.lines import KV_SPEC
from loglake.plans.records import SEED, proven

# The first three cases of RFC 8032, section 7.1 (secret, public, message, signature).
CASES = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


def test_signatures():
    for seed, public, message, signature in (tuple(map(bytes.fromhex, c)) for c in CASES):
        assert checkpoints.public_key(seed) == public
        assert checkpoints.sign(seed, message) == signature
        assert checkpoints.verify(public, message, signature)
        assert not checkpoints.verify(public, message + b"x", signature)
        assert not checkpoints.verify(public, message, signature[:63] + bytes([signature[63] ^ 1]))
        assert not checkpoints.verify(public, message, signature[:32])
        raised = (int.from_bytes(signature[32:], "little") + checkpoints.ORDER).to_bytes(32, "little")
        assert not checkpoints.verify(public, message, signature[:32] + raised)  # the same number in another form
    assert not checkpoints.verify(b"\xff" * 32, b"", bytes(64)) and not checkpoints.verify(b"", b"", bytes(64))


def sha(*parts):
    return hashlib.sha256(b"".join(parts)).digest()


def judged(line):
    """One bundle, one step after the other."""
    b, h = json.loads(line), bytes.fromhex
    out = {"raw_hash": sha(base64.b64decode(b["record"]["raw_base64"])).hex() == b["event"]["raw_sha256"]}
    out["record"] = b["event"]["record_id"] == b["record"]["record_id"] and b["event"]["source_id"] == b["record"]["source_id"]
    p, a = b.get("proof"), b.get("anchor")
    if not p:
        return out
    out["leaf"] = sha(b"\0", base64.b64decode(b["record"]["body_base64"])) == h(p["leaf"])
    index, size, node, path = p["index"], p["size"], h(p["leaf"]), [h(x) for x in p["path"]]
    while size > 1:
        if index % 2 or index + 1 < size:
            node = sha(b"\1", path.pop(0), node) if index % 2 else sha(b"\1", node, path.pop(0))
        index, size = index // 2, (size + 1) // 2
    out["inclusion"] = node == h(p["root"]) and not path
    link = lambda s, n: sha(b"\2", h(s["prev"]), h(s["root"]), struct.pack(">qq", s["segment"], n))
    out["chain"] = link(p, p["size"]) == h(p["chain"])
    if not a:
        return out
    cp, chain, at = a["checkpoint"], p["chain"], p["segment"]
    text = f"{cp['version']}\nhead={cp['head']}\nsealed_through={cp['sealed_through']}\nsegments={cp['segments']}\nsigned_at={cp['signed_at']}\nprev={cp['prev']}\nkey={cp['key_id']}"
    fine = checkpoints.verify(h(a["public_key"]), text.encode(), base64.b64decode(cp["signature"])) and b["record"]["record_id"] <= cp["sealed_through"]
    for s in a["links"]:
        fine = fine and s["segment"] == at + 1 and s["prev"] == chain and link(s, s["count"]) == h(s["chain"])
        chain, at = s["chain"], s["segment"]
    out["covered"] = fine and chain == cp["head"] and at == cp["segments"]
    return out


def test_bundles_as_text(spark, sf_dir):
    made, runs, _ = proven(spark, sf_dir)
    told = {r["id"]: r["checks"] for r in evidence.checks(made, [KV_SPEC]).select(F.col("record.record_id").alias("id"), "checks").collect()}
    lines = {r["record_id"]: r["line"] for r in evidence.portable(made, evidence.links(runs, runs)).collect()}
    assert told.keys() == lines.keys() and len(told) > 500
    seen = set()
    for k, line in lines.items():
        for name, ok in judged(line).items():
            assert told[k][name] == ("pass" if ok else "fail"), (k, name)
            seen.add((name, ok))
        assert told[k]["anchor"] == told[k]["trusted"] == "skip"  # nothing was given to compare with
    assert len(seen) == 12


def test_ways(spark):
    seals, chain = [], bytes(32)
    for n in range(1, 12):
        root, prev = sha(b"root", bytes([n])), chain
        chain = sha(b"\2", prev, root, struct.pack(">qq", n, 10))
        seals.append((n, root, prev, chain, 10))
    book = spark.createDataFrame(seals, "segment bigint, root binary, prev binary, chain binary, count bigint")
    states = [(seals[k - 1][3].hex(), k * 10, k, str(k)) for k in (3, 8)]
    log = checkpoints.checked(checkpoints.signed(spark.createDataFrame(states, "head string, sealed_through bigint, segments bigint, signed_at string"), SEED), checkpoints.public_key(SEED))
    assert log.filter("refused is not null").count() == 0
    assert ledger.checkpoint_links(log.select(F.col("segments").alias("checkpoint"), F.col("sealed_through").alias("covered"), "signature", F.unhex("prev").alias("prev"))).count() == 0
    ways = {r["segment"]: r for r in evidence.walk(evidence.runs(book, log)).collect()}
    assert sorted(ways) == list(range(1, 9)) and [ways[k]["checkpoint"]["segments"] for k in range(1, 9)] == [3] * 3 + [8] * 5
    assert all(r["broken"] is None and r["reached"] for r in ways.values())
    gone = {r["segment"]: r for r in evidence.walk(evidence.runs(book.filter("segment != 6"), log)).collect()}
    assert {k: (r["broken"], r["reached"]) for k, r in gone.items() if k > 3} == {4: (7, True), 5: (7, True), 7: (None, True), 8: (None, True)}
    cut = {r["segment"]: r["reached"] for r in evidence.walk(evidence.runs(book.filter("segment != 8"), log)).collect()}
    assert cut == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False}
    other = checkpoints.checked(log.drop("public", "refused"), checkpoints.public_key(bytes(32)))
    assert {r["refused"] for r in other.collect()} == {"key"}
    assert {r["refused"] for r in checkpoints.checked(log.withColumn("sealed_through", F.lit(None).cast("bigint")), checkpoints.public_key(SEED)).collect()} == {"signature"}
    empty = evidence.runs(book, log.limit(0))
    assert evidence.walk(empty).count() == 0 and evidence.links(book, empty).count() == 0
