"""A minimal perfect hash over 64-bit keys: levels of bit arrays, each holding the keys that fall alone."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multipliers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0xF1) >> _U(32)).astype("<u4")


class PerfectHash:
    """Maps n distinct keys to 0 .. n-1, each level in constant time; other keys give -1 or some slot."""

    SPREAD = 2.0

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            count = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(count - bits + total)
            total += int(count[-1]) if len(count) else 0
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, levels = keys.astype(np.uint64), []
        while len(rest):
            size = max(8, int(cls.SPREAD * len(rest)))
            at = (mix(rest, len(levels)) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (mix(keys[left], k) % _U(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        parts = [np.array([len(self.levels), *map(len, self.levels)], dtype="<u8").tobytes()]
        return b"".join(parts + [np.packbits(x).tobytes() for x in self.levels])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        k = int(np.frombuffer(data, "<u8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u8", k, 8), 8 * (k + 1), []
        for n in map(int, sizes):
            m = -(-n // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, m, at), count=n).astype(bool))
            at += m
        return cls(levels)
