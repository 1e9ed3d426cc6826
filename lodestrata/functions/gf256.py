"""Arithmetic in GF(2^8) with x^8 + x^4 + x^3 + x^2 + 1 and generator 2: tables from the rule, numpy and Column forms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

POLYNOMIAL = 0x11D


def tables() -> tuple[np.ndarray, np.ndarray]:
    """exp (510 long, so that sums of two logarithms need no modulus) and log."""
    exp, log, x = np.zeros(510, np.int64), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (POLYNOMIAL if x & 0x80 else 0)
    return exp, log


EXP, LOG = tables()
#: Products of all pairs of bytes.
PRODUCT = np.where(np.outer(np.arange(256), np.arange(256)) == 0, 0, EXP[LOG[:, None] + LOG[None, :]]).astype(np.uint8)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.asarray(a), np.asarray(b)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]])


def times_power(byte: Column, power: Column) -> Column:
    """byte * 2^power as an expression."""
    exp, log = F.array(*map(F.lit, EXP[:255].tolist())), F.array(*map(F.lit, LOG.tolist()))
    return F.when(byte == 0, F.lit(0).cast("long")).otherwise(F.element_at(exp, ((F.element_at(log, (byte + 1).cast("int")) + power) % 255 + 1).cast("int")))


def parity(bodies: list[bytes]) -> tuple[bytes, bytes]:
    """P: XOR of the bodies, padded with zeros; Q: sum of 2^place * body."""
    n = max(map(len, bodies), default=0)
    p, q = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for i, b in enumerate(bodies):
        row = np.frombuffer(b, np.uint8)
        p[: len(row)] ^= row
        q[: len(row)] ^= PRODUCT[EXP[i % 255]][row]
    return p.tobytes(), q.tobytes()


def rebuild(bodies: list[bytes | None], p: bytes, q: bytes | None) -> list[bytes] | None:
    """The bodies with up to two holes filled (padded to P's length); None where that can't be."""
    holes = [i for i, b in enumerate(bodies) if b is None]
    if not holes:
        return list(bodies)  # type: ignore[arg-type]
    if len(holes) > 2 or (len(holes) == 2 and (q is None or (holes[1] - holes[0]) % 255 == 0)):
        return None
    left_p, left_q = (np.frombuffer(x, np.uint8).astype(np.int64) for x in parity([b or b"" for b in bodies] + [b"\0" * len(p)]))
    dp = left_p ^ np.frombuffer(p, np.uint8)
    out = list(bodies)
    if len(holes) == 1:
        out[holes[0]] = dp.astype(np.uint8).tobytes()
        return out  # type: ignore[return-value]
    a, b = holes
    dq = left_q ^ np.frombuffer(q, np.uint8)  # type: ignore[arg-type]
    bottom = int(EXP[a % 255] ^ EXP[b % 255])
    first = multiply(dq ^ multiply(dp, EXP[b % 255]), EXP[(255 - LOG[bottom]) % 255])
    out[a], out[b] = first.astype(np.uint8).tobytes(), (first ^ dp).astype(np.uint8).tobytes()
    return out  # type: ignore[return-value]
