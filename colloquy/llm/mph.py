"""A minimal perfect hash over 64-bit keys, by levels of bits, with fingerprints per slot.

Level l hashes the keys that are left into a bit array of GAMMA bits a key; keys that have a bit
to themselves stay there, the others go on. A key's slot is the number of set bits before its
own, counted over all levels. Construction and lookup are whole-array numpy operations.
"""

from __future__ import annotations

import struct

import numpy as np

from colloquy.llm.common import mix64

MAGIC, GAMMA, LEVELS = b"CQIX", 2.0, 40


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(32)).astype(np.uint32)


class Index:
    """Distinct keys to (ordinal, offset, length)."""

    def __init__(self, bits: list[np.ndarray], prints: np.ndarray, ordinals: np.ndarray, offsets: np.ndarray, lengths: np.ndarray):
        self.bits, self.prints, self.ordinals, self.offsets, self.lengths = bits, prints, ordinals, offsets, lengths
        self.ranks, before = [], 0
        for b in bits:
            ranks = np.cumsum(b, dtype=np.int64)
            self.ranks.append(ranks - b + before)
            before += int(ranks[-1])

    @classmethod
    def build(cls, keys: np.ndarray, ordinals: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Index:
        bits, left = [], keys.astype(np.uint64)
        while len(left):
            if len(bits) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, int(GAMMA * len(left)))
            at = _at(left, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        made = cls(bits, *(np.empty(len(keys), t) for t in (np.uint32, np.uint32, np.uint64, np.uint32)))
        slot = made._slots(keys.astype(np.uint64))
        made.prints[slot], made.ordinals[slot], made.offsets[slot], made.lengths[slot] = fingerprints(keys.astype(np.uint64)), ordinals, offsets, lengths
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that no level holds."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, b in enumerate(self.bits):
            at = _at(keys[todo], level, len(b))
            here = b[at]
            out[todo[here]] = self.ranks[level][at[here]]
            todo = todo[~here]
        return out

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key's fingerprint is there (a foreign key passes once in 2^32), and its entry."""
        keys = keys.astype(np.uint64)
        if not len(self.prints):
            zero = np.zeros(len(keys), np.int64)
            return zero > 0, zero, zero, zero
        slot = self._slots(keys)
        safe = np.maximum(slot, 0)
        return (slot >= 0) & (self.prints[safe] == fingerprints(keys)), self.ordinals[safe].astype(np.int64), self.offsets[safe].astype(np.int64), self.lengths[safe].astype(np.int64)

    def dumps(self) -> bytes:
        head = MAGIC + struct.pack("<II", len(self.prints), len(self.bits)) + struct.pack(f"<{len(self.bits)}I", *map(len, self.bits))
        return head + b"".join(np.packbits(b).tobytes() for b in self.bits) + b"".join(x.astype(x.dtype.newbyteorder("<")).tobytes() for x in (self.prints, self.ordinals, self.offsets, self.lengths))

    @classmethod
    def loads(cls, data: bytes) -> Index:
        if data[:4] != MAGIC:
            raise ValueError("not an index")
        n, levels = struct.unpack_from("<II", data, 4)
        sizes, at, bits, rest = struct.unpack_from(f"<{levels}I", data, 12), 12 + 4 * levels, [], []
        for size in sizes:
            raw = np.frombuffer(data, np.uint8, (size + 7) // 8, at)
            bits.append(np.unpackbits(raw, count=size).astype(bool))
            at += len(raw)
        for kind in ("<u4", "<u4", "<u8", "<u4"):
            rest.append(np.frombuffer(data, kind, n, at))
            at += rest[-1].nbytes
        return cls(bits, *rest)
