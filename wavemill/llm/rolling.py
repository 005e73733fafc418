"""Hashes of byte ranges in numpy.

Ranges: a polynomial over the field of 2^61 - 1 elements at a fixed random point, so that two different ranges agree with a chance
of their length over 2^61; nothing in the form of a text (as in the words of Thue and Morse, which defeat any odd base modulo
2^64) makes that likelier. Grams: the cheaper polynomial modulo 2^64, for where equal hashes of unlike grams do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
PRIME = (1 << 61) - 1
#: Two points of the field, and an odd base modulo 2^64.
POINTS = (0x0F3A9C4B7D21E685, 0x15D28E73A90B4C6F)
ODD = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, and of a word that goes to a digest instead.
PART, LONG = 1 << 18, 1 << 14
_P, _LOW32, _LOW31, _LOW30, _LOW29 = U(PRIME), U((1 << 32) - 1), U((1 << 31) - 1), U((1 << 30) - 1), U((1 << 29) - 1)
_byte = np.random.default_rng(71).integers(1, 2**63, 256, dtype=np.uint64)
_field: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
_ring: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x < 2^64 - 8."""
    x = (x & _P) + (x >> U(61))
    return np.minimum(x, x - _P)  # below the prime the difference wraps round to a large number


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, from halves of 31 and 30 bits."""
    a1, a0, b1, b0 = a >> U(31), a & _LOW31, b >> U(31), b & _LOW31
    mid = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & _LOW30) << U(31)) + a0 * b0)


def _geometric(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, times(out, np.full(1, pow(base, len(out), PRIME), dtype=np.uint64))])
    return out[:n]


def _field_powers(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if lane not in _field:
        p = _geometric(POINTS[lane], PART + 2 * LONG)
        _field[lane] = (p & _LOW32, p >> U(32), _geometric(pow(POINTS[lane], -1, PRIME), PART + 2 * LONG))
    return _field[lane]


class Ranges:
    """Hashes of any byte ranges of at most PART + LONG bytes, in constant time each."""

    def __init__(self, data: np.ndarray, lane: int = 0):
        low, high, self.inverse = _field_powers(lane)
        n = len(data)
        x = data.astype(np.uint64) + U(1)
        self.low, self.high = np.zeros(n + 1, dtype=np.uint64), np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(x * low[:n], out=self.low[1:])  # sums wrap round, their differences are right below 2^24 bytes
        np.cumsum(x * high[:n], out=self.high[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = self.high[end] - self.high[start], self.low[end] - self.low[start]
        x = (high >> U(29)) + ((high & _LOW29) << U(32)) + (low & _P) + (low >> U(61))
        return mix(times(_reduced(x), self.inverse[start]) ^ ((end - start).astype(np.uint64) << U(40)))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of ranges of a text of any length, whose starts ascend; ranges of more than LONG bytes by a digest."""
    out = np.zeros(len(start), dtype=np.uint64)
    short = np.flatnonzero(end - start <= LONG)
    for k in np.flatnonzero(end - start > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    at = 0
    while at < len(short):
        first = int(start[short[at]])
        to = int(np.searchsorted(start[short], first + PART - LONG, side="right"))
        part = short[at:to]
        last = int(end[part].max())
        out[part] = Ranges(data[first:last], lane).of(start[part] - first, end[part] - first)
        at = to
    return out


class Grams:
    """Hashes of all ranges of one width of a text of at most PART + LONG bytes."""

    def __init__(self, data: np.ndarray):
        if not _ring:
            with np.errstate(over="ignore"):
                for base in (ODD, pow(ODD, -1, 2**64)):
                    p = np.full(PART + 2 * LONG, base, dtype=np.uint64)
                    p[0] = 1
                    _ring.append(np.multiply.accumulate(p))
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_byte[data] * _ring[0][:n], out=self.sums[1:])

    def every(self, width: int) -> np.ndarray:
        m = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:m]) * _ring[1][:m])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
