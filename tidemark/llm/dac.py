"""Directly addressable codes: integers as 8-bit chunks on levels, with bitmaps that say which go on.

Level 0 holds the low 8 bits of every value; a set bit in its bitmap says that the value has a chunk on the next
level, at the place given by the number of set bits before it. A rank directory holds that number for every 512
bits, so any value is found without decoding its neighbours.
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(values: np.ndarray) -> bytes:
    """The coded form of unsigned 32-bit values."""
    rest, levels = values.astype(np.uint32), []
    while len(rest) or not levels:
        chunk, high = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = high > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
        ones = _ONES[bits].reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        levels.append((chunk, bits, ranks))
        rest = high[more]
        if not more.any():
            break
    out = [struct.pack("<I", len(levels))]
    for chunk, bits, ranks in levels:
        out += [struct.pack("<Q", len(chunk)), ranks.astype("<u4").tobytes(), bits.tobytes(), chunk.tobytes()]
    return b"".join(out)


class Codes:
    """Read access to a coded form; nothing is decoded up front."""

    def __init__(self, raw: bytes | memoryview, at: int = 0):
        n, = struct.unpack_from("<I", raw, at)
        at += 4
        self.levels = []
        for _ in range(n):
            size, = struct.unpack_from("<Q", raw, at)
            at += 8
            blocks = -(-size // BLOCK)
            ranks = np.frombuffer(raw, "<u4", blocks + 1, at)
            at += 4 * (blocks + 1)
            bits = np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at)
            at += len(bits)
            self.levels.append((np.frombuffer(raw, np.uint8, size, at), bits, ranks))
            at += size

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """Value ``i``, by one lookup on each of its levels."""
        value, shift = 0, 0
        for chunk, bits, ranks in self.levels:
            value |= int(chunk[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            head = i // BLOCK
            inside = bits[head * BLOCK // 8:i >> 3]
            i = int(ranks[head]) + int(_ONES[inside].sum()) + int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            shift += 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values ``a`` to ``b - 1``: on each level they are one stretch."""
        out = np.zeros(max(b - a, 0), np.uint32)
        where, shift = np.arange(len(out)), 0
        for chunk, bits, ranks in self.levels:
            if a >= b:
                break
            out[where] |= chunk[a:b].astype(np.uint32) << shift
            more = np.unpackbits(bits[a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:][:b - a].astype(bool)
            a = self._rank(bits, ranks, a)
            where = where[more]
            b = a + len(where)
            shift += 8
        return out

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        head = i // BLOCK
        rest = int(_ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)]) if i & 7 else 0
        return int(ranks[head]) + int(_ONES[bits[head * BLOCK // 8:i >> 3]].sum()) + rest
