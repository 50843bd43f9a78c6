"""Ed25519 as RFC 8032 describes it, in plain integers. A signature takes some hundred multiplications of a key met before, a thousand more of a new one; all in Python."""

from __future__ import annotations

import hashlib
from functools import lru_cache

_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_I = pow(2, (_P - 1) // 4, _P)


def _x(y: int, sign: int) -> int | None:
    xx = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(xx, (_P + 3) // 8, _P)
    if (x * x - xx) % _P:
        x = x * _I % _P
    if (x * x - xx) % _P or (x == 0 and sign):
        return None
    return x if x & 1 == sign else _P - x


_BY = 4 * pow(5, -1, _P) % _P
_BASE = (_x(_BY, 0), _BY, 1, _x(_BY, 0) * _BY % _P)
_ZERO = (0, 1, 1, 0)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


@lru_cache(256)
def _multiples(p: tuple) -> list[list[tuple]]:
    """0 to 15 times p, 16 p, 256 p and so on: worked out once for the base point and for each key."""
    rows = []
    for _ in range(64):
        row = [_ZERO]
        for _ in range(15):
            row.append(_add(row[-1], p))
        rows.append(row)
        p = _add(row[-1], p)
    return rows


def _times(k: int, p: tuple) -> tuple:
    out = _ZERO
    for row in _multiples(p):
        out, k = _add(out, row[k & 15]), k >> 4
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], -1, _P)
    x, y = p[0] * z % _P, p[1] * z % _P
    return (y | (x & 1) << 255).to_bytes(32, "little")


@lru_cache(1_000)
def _unpack(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x(y, sign) if y < _P else None
    return None if x is None else (x, y, 1, x * y % _P)


def _hash(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little")
    return a & (1 << 254) - 8 | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _pack(_times(_secret(seed)[0], _BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times(a, _BASE))
    r = _hash(prefix, message) % _L
    point = _pack(_times(r, _BASE))
    return point + ((r + _hash(point, key, message) * a) % _L).to_bytes(32, "little")


def verify(key_hex: str | None, signature_hex: str | None, message: bytes) -> bool:
    """False for whatever is no signature of that key on the message, malformed input included."""
    try:
        key, signature = bytes.fromhex(key_hex or ""), bytes.fromhex(signature_hex or "")
    except ValueError:
        return False
    if len(key) != 32 or len(signature) != 64:
        return False
    a, r, s = _unpack(key), _unpack(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    return _pack(_times(s, _BASE)) == _pack(_add(r, _times(_hash(signature[:32], key, message) % _L, a)))
