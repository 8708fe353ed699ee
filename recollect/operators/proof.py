"""Forget certificates: what was erased, its Merkle root, the audit rows that tell of it, and a signature over the canonical payload."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from . import merkle


def certificates(m: DataFrame, cert: str, key_id: str, signed_at: str, hard: bool = False, sign: Callable[[bytes], bytes] | None = None, log: DataFrame | None = None) -> DataFrame:
    """A row a tenant of forgotten memories (id, org_id, content, audit_hash): payload, signature (null without sign) and the
    first and last number of the tenant's audit rows (org_id, id, memory_id, operation) that tell of their forgetting.

    One row's payload lists all of a call's ids, as the certificate does; it is as large as the call."""
    roots = merkle.roots(m, "org_id")
    ids = m.groupBy("org_id").agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("memory_ids"))
    x = ids.join(roots, "org_id")
    if log is None:
        x = x.withColumn("audit_seq_start", F.lit(None).cast("long")).withColumn("audit_seq_end", F.lit(None).cast("long"))
    else:
        told = log.filter("operation = 'forget'").join(m.select("org_id", F.col("id").alias("memory_id")), ["org_id", "memory_id"], "left_semi")
        x = x.join(told.groupBy("org_id").agg(F.min("id").cast("long").alias("audit_seq_start"), F.max("id").cast("long").alias("audit_seq_end")), "org_id", "left")

    @F.pandas_udf("struct<payload:string,signature:binary>")
    def made(org: pd.Series, members: pd.Series, root: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
        number = lambda v: None if pd.isna(v) else int(v)
        out = []
        for o, ids, r, a, b in zip(org, members, root, first, last, strict=True):
            body = {"cert_id": f"{cert}-{o}", "org_id": o, "memory_ids": list(ids), "merkle_root": base64.b64encode(bytes.fromhex(r)).decode(), "signer_key_id": key_id, "signed_at": signed_at, "hard_delete": hard}
            payload = canonical_payload(body | {"audit_seq_start": number(a), "audit_seq_end": number(b)})
            out.append((payload.decode(), sign(payload) if sign else None))
        return pd.DataFrame(out, columns=["payload", "signature"])

    x = x.withColumn("c", made(F.col("org_id").cast("string"), "memory_ids", "merkle_root", "audit_seq_start", "audit_seq_end"))
    return x.select("org_id", "merkle_root", "leaves", "audit_seq_start", "audit_seq_end", "c.payload", "c.signature")


def canonical_payload(body: dict) -> bytes:
    return json.dumps(body, sort_keys=True, separators=(",", ":")).encode()


def hmac_signer(key: bytes) -> Callable[[bytes], bytes]:
    """A signer with a shared key."""
    return lambda payload: hmac.new(key, payload, hashlib.sha256).digest()


def signer(secret: bytes) -> Callable[[bytes], bytes]:
    """A signer with an Ed25519 secret, as ``ed25519.private_key`` reads it."""
    return lambda payload: ed25519.sign(secret, payload)


def checker(public: bytes) -> Callable[[bytes, bytes], bool]:
    """Checks signatures with the public key alone."""
    return lambda payload, signature: ed25519.verify(public, payload, signature)


def verified(certs: DataFrame, check: Callable[[bytes, bytes], bool]) -> DataFrame:
    """certs with ok: whether the signature belongs to the payload."""

    @F.pandas_udf("boolean")
    def told(payload: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([bool(s) and check(p.encode(), bytes(s)) for p, s in zip(payload, signature, strict=True)], dtype=bool)

    return certs.withColumn("ok", told("payload", "signature"))
