"""Minimal perfect hash functions over 64-bit keys: levels of bit arrays in which each key has a bit of its own.

A key that shares its bit at one level goes on to the next; its slot is the rank of its bit. About three bits a key, and
looked up in a few array reads. Any key has a slot or none: what isn't in the set is told apart by a stored fingerprint.
"""

from __future__ import annotations

import io

import numpy as np

from .common import U64, mix

GAMMA = 1.7
MAX_LEVELS = 80


def _at(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ U64((level + 1) * 0xA0761D6478BD642F % (1 << 64))) % U64(bits)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, levels: list[np.ndarray], size: int):
        """levels: words of 64 bits each."""
        self.levels, self.size = levels, size
        self.ranks, base = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(base + np.concatenate([[0], np.cumsum(counts)[:-1]]))
            base += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """keys: distinct; ValueError otherwise."""
        levels, rest = [], keys.astype(U64)
        while len(rest):
            if len(levels) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            bits = -(-max(64, int(len(rest) * GAMMA)) // 64) * 64
            at = _at(rest, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(U64))
            rest = rest[~alone[at]]
        return cls(levels, len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it surely isn't in the set."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _at(keys[left], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(U64)
            hit = (word >> bit) & U64(1) == 1
            below = np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            out[left[hit]] = (ranks[at >> 6] + below)[hit]
            left = left[~hit]
        return out


def pack(arrays: dict[str, np.ndarray], mph: MinimalPerfectHash) -> bytes:
    out = io.BytesIO()
    np.savez(out, size=np.array([mph.size]), **{f"level{i}": x for i, x in enumerate(mph.levels)}, **arrays)
    return out.getvalue()


def unpack(blob: bytes) -> tuple[MinimalPerfectHash, dict[str, np.ndarray]]:
    with np.load(io.BytesIO(blob), allow_pickle=False) as z:
        got = {k: z[k] for k in z.files}
    levels = [got.pop(f"level{i}") for i in range(sum(k.startswith("level") for k in got))]
    return MinimalPerfectHash(levels, int(got.pop("size")[0])), got
