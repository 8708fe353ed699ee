"""Parallel Merkle trees against the list form, Ed25519 on published vectors, certificates."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from recollect.functions import ed25519
from recollect.operators import merkle, proof

#: RFC 8032, section 7.1: secret, public key, message, signature.
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("secret, public, message, signature", VECTORS)
def test_published_signatures(secret, public, message, signature):
    secret, public, message, signature = map(bytes.fromhex, (secret, public, message, signature))
    assert ed25519.public_key(secret) == public and ed25519.sign(secret, message) == signature
    assert ed25519.verify(public, message, signature)
    for bad in (signature[:-1], signature + b"x", bytes([signature[0] ^ 1]) + signature[1:], signature[:32] + (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little")):
        assert not ed25519.verify(public, message, bad)
    assert not ed25519.verify(public, message + b"x", signature) and not ed25519.verify(bytes(32)[:31], message, signature) and not ed25519.verify(b"\xff" * 32, message, signature)


def test_keys_from_pem():
    secret = bytes.fromhex(VECTORS[0][0])
    pem = lambda kind, der: f"x\n-----BEGIN {kind} KEY-----\n{base64.b64encode(der).decode()}\n-----END {kind} KEY-----\n"
    assert ed25519.private_key(pem("PRIVATE", ed25519.PRIVATE_DER + secret)) == secret
    assert ed25519.public_key_of(pem("PUBLIC", ed25519.PUBLIC_DER + secret).encode()) == secret
    for bad in ("", pem("PRIVATE", b"short"), pem("PUBLIC", ed25519.PUBLIC_DER + secret), "-----BEGIN PRIVATE KEY-----\n***\n-----END PRIVATE KEY-----"):
        with pytest.raises(ed25519.SigningKeyError):
            ed25519.private_key(bad)
    with pytest.raises(ed25519.SigningKeyError):
        ed25519.sign(b"short", b"")


@pytest.mark.parametrize("span", [2, 8, 4096])
def test_parallel_roots_are_those_of_the_lists(spark, monkeypatch, span):
    monkeypatch.setattr(merkle, "SPAN", span)
    monkeypatch.setattr(merkle, "HEIGHT", span.bit_length() - 1)
    sizes = [1, 2, 3, 5, 8, 9, 16, 17, 31, 64, 65, 127]
    rows = [(i, o, f"text {i}" if i % 5 else None, "h" if i % 7 == 0 else "") for o, n in enumerate(sizes) for i in range(n)] + [(1, None, "x", None), (1, 3, "text 1", "")] * 2
    m = spark.createDataFrame(rows, "id long, org_id int, content string, audit_hash string").repartition(6)
    want = {}
    for r in merkle.leaves(m, "org_id").collect():
        want.setdefault(r.key, []).append(bytes(r.node))
    got = {r.org_id: (r.merkle_root, r.leaves) for r in merkle.roots(m, "org_id").collect()}
    assert got == {o: (merkle.merkle(x).hex(), len(x)) for o, x in want.items()}
    assert merkle.roots(m.limit(0), "org_id").count() == 0


def test_certificates_hold_the_audit_rows_and_betray_changes(spark):
    m = spark.createDataFrame([(i, i % 2, f"t{i}") for i in range(9)], "id long, org_id long, content string")
    log = spark.createDataFrame([(10, 0, 2, "forget"), (11, 0, 4, "recall"), (15, 0, 8, "forget"), (16, 1, 2, "forget"), (17, 1, 99, "forget")], "id long, org_id long, memory_id long, operation string")
    secret = bytes.fromhex(VECTORS[1][0])
    certs = proof.certificates(m, "c", "k", "2024-02-01T00:00:00+00:00", True, proof.signer(secret), log)
    rows = {r.org_id: r for r in certs.collect()}
    assert (rows[0].audit_seq_start, rows[0].audit_seq_end, rows[1].audit_seq_start) == (10, 15, None)
    body = json.loads(rows[0].payload)
    assert body["memory_ids"] == ["0", "2", "4", "6", "8"] and body["hard_delete"] is True and body["audit_seq_end"] == 15
    assert base64.b64decode(body["merkle_root"]).hex() == rows[0].merkle_root
    check = proof.checker(bytes.fromhex(VECTORS[1][1]))
    assert {r.ok for r in proof.verified(certs, check).collect()} == {True}
    assert {r.ok for r in proof.verified(certs.withColumn("payload", F.concat("payload", F.lit(" "))), check).collect()} == {False}
    assert {r.ok for r in proof.verified(proof.certificates(m, "c", "k", "now"), check).collect()} == {False}


def test_roots_of_more_than_twelve_levels(spark):
    """Over 4096 leaves, where the queries' SQL has no level left."""
    sizes = {0: 4096, 1: 4097, 2: 9001}
    m = spark.createDataFrame([(i, o, f"text {i}") for o, n in sizes.items() for i in range(n)], "id long, org_id int, content string")
    want = {}
    for r in merkle.leaves(m, "org_id").collect():
        want.setdefault(r.key, []).append(bytes(r.node))
    assert {r.org_id: (r.merkle_root, r.leaves) for r in merkle.roots(m, "org_id").collect()} == {o: (merkle.merkle(x).hex(), sizes[o]) for o, x in want.items()}
