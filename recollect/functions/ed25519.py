"""Ed25519 signatures as RFC 8032 describes them, for certificates: a few a call, signed where the rows are made.

Keys are 32 bytes; ``private_key`` and ``public_key_of`` read them from PEM files. Not hardened against timing."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

#: Fixed values of the curve.
P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
#: What stands before a key in its DER form.
PRIVATE_DER, PUBLIC_DER = bytes.fromhex("302e020100300506032b657004220420"), bytes.fromhex("302a300506032b6570032100")

Point = tuple[int, int, int, int]
ZERO: Point = (0, 1, 1, 0)


class SigningKeyError(ValueError):
    """No key of this kind."""


def plus(a: Point, b: Point) -> Point:
    """Sum in extended coordinates (x, y, z, x * y / z)."""
    e = (a[1] - a[0]) * (b[1] - b[0])
    f = (a[1] + a[0]) * (b[1] + b[0])
    g, h = 2 * a[3] * b[3] * D, 2 * a[2] * b[2]
    left, right, low, high = f - e, h - g, h + g, f + e
    return left * right % P, low * high % P, right * low % P, left * high % P


def times(n: int, a: Point) -> Point:
    out = ZERO
    while n:
        if n & 1:
            out = plus(out, a)
        a, n = plus(a, a), n >> 1
    return out


def same(a: Point, b: Point) -> bool:
    return (a[0] * b[2] - b[0] * a[2]) % P == 0 and (a[1] * b[2] - b[1] * a[2]) % P == 0


def _x_of(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def packed(a: Point) -> bytes:
    inverse = pow(a[2], -1, P)
    x, y = a[0] * inverse % P, a[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def unpacked(data: bytes) -> Point | None:
    if len(data) != 32:
        return None
    value = int.from_bytes(data, "little")
    y = value & ((1 << 255) - 1)
    x = _x_of(y, value >> 255)
    return None if x is None else (x, y, 1, x * y % P)


@lru_cache
def base() -> Point:
    y = 4 * pow(5, -1, P) % P
    x = _x_of(y, 0)
    return x, y, 1, x * y % P


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@lru_cache(16)
def _expanded(secret: bytes) -> tuple[int, bytes, bytes]:
    """The secret's number, its prefix and its public key."""
    if len(secret) != 32:
        raise SigningKeyError("a secret key has 32 bytes")
    h = hashlib.sha512(secret).digest()
    number = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return number, h[32:], packed(times(number, base()))


def public_key(secret: bytes) -> bytes:
    return _expanded(secret)[2]


def sign(secret: bytes, message: bytes) -> bytes:
    number, prefix, public = _expanded(secret)
    r = _number(prefix, message)
    point = packed(times(r, base()))
    return point + ((r + _number(point, public, message) * number) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    a, r = unpacked(public), unpacked(signature[:32])
    s = int.from_bytes(signature[32:], "little")
    if a is None or r is None or len(signature) != 64 or s >= ORDER:
        return False
    return same(times(s, base()), plus(r, times(_number(signature[:32], public, message), a)))


def _der(pem: str | bytes, kind: str) -> bytes:
    text = pem.decode("ascii", "replace") if isinstance(pem, bytes) else pem
    start, end = f"-----BEGIN {kind} KEY-----", f"-----END {kind} KEY-----"
    if start not in text or end not in text:
        raise SigningKeyError(f"no {kind.lower()} key in PEM form")
    try:
        return base64.b64decode("".join(text.split(start)[1].split(end)[0].split()), validate=True)
    except ValueError as e:
        raise SigningKeyError("the key isn't in base64") from e


def private_key(pem: str | bytes) -> bytes:
    """The secret of an unencrypted PEM file."""
    der = _der(pem, "PRIVATE")
    if not der.startswith(PRIVATE_DER) or len(der) != len(PRIVATE_DER) + 32:
        raise SigningKeyError("not an Ed25519 private key")
    return der[-32:]


def public_key_of(pem: str | bytes) -> bytes:
    der = _der(pem, "PUBLIC")
    if not der.startswith(PUBLIC_DER) or len(der) != len(PUBLIC_DER) + 32:
        raise SigningKeyError("not an Ed25519 public key")
    return der[-32:]
