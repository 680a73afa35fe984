"""Wavelet matrix over token ids, kept in one compressed file a shard.

One bit-plane per binary digit of the largest id, highest digit first; after
each plane the sequence is split stably, zeros before ones. Planes are cut
into blocks, each compressed alone, with the number of ones before it in a
directory, so that access, rank, select, counting and occurrence lookup read
a few blocks only.

File: MAGIC, length of the header, JSON header, documents (ids, their null
marks and first positions, compressed), directories, blocks.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"LCWM1\n"
#: Bits of one block; a multiple of 8.
BLOCK_BITS = 1 << 16


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def build(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray, **about) -> bytes:
    """The file of one shard: `ids` of all documents end to end, document k from starts[k] on (starts ends with len(ids))."""
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    left = ids.astype(np.uint16 if width <= 16 else np.uint32)
    compress = zstandard.ZstdCompressor(level=1).compress
    blocks, ones, sizes, zeros = [], [], [], []
    for digit in reversed(range(width)):
        bits = (left & left.dtype.type(1 << digit)) != 0
        packed = np.packbits(bits, bitorder="little")
        step = BLOCK_BITS // 8
        cut = [packed[i : i + step] for i in range(0, len(packed), step)]
        counts = np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(bits) else np.empty(0, np.int64)
        ones.append(np.concatenate([[0], np.cumsum(counts)]))
        for part in cut:
            data = compress(part.tobytes())
            blocks.append(data)
            sizes.append(len(data))
        zeros.append(int(len(bits) - counts.sum()))
        split = np.empty_like(left)
        np.compress(~bits, left, out=split[: zeros[-1]])
        np.compress(bits, left, out=split[zeros[-1] :])
        left = split
    docs = [_pack(np.array([d or 0 for d in doc_ids], "<i8")), _pack(np.array([d is None for d in doc_ids], "?")), _pack(np.asarray(starts, "<i8"))]
    tables = [_pack(np.concatenate(ones).astype("<i8")), _pack(np.array(sizes, "<i8"))]
    header = json.dumps({"n": len(ids), "width": width, "block_bits": BLOCK_BITS, "zeros": zeros, "parts": [len(x) for x in docs + tables], **about}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *docs, *tables, *blocks])


class WaveletFile:
    """Reads a shard's file; nothing but the blocks that a question needs is decompressed."""

    def __init__(self, data: bytes):
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", data[at - 4 : at])[0]
        self.about = json.loads(data[at : at + size])
        at += size
        parts = []
        for length in self.about["parts"]:
            parts.append(data[at : at + length])
            at += length
        self.n, self.width, self.zeros = self.about["n"], self.about["width"], self.about["zeros"]
        ids, null = _unpack(parts[0], "<i8"), _unpack(parts[1], "?")
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, null, strict=True)]
        self.starts = _unpack(parts[2], "<i8")
        self.block_bits = self.about["block_bits"]
        self.per_plane = -(-self.n // self.block_bits)
        self.ones = _unpack(parts[3], "<i8").reshape(self.width, self.per_plane + 1)
        self.ends = at + np.cumsum(_unpack(parts[4], "<i8"))
        self.first, self.data = at, data
        self._block = lru_cache(maxsize=256)(self._read_block)

    def _read_block(self, plane: int, block: int) -> np.ndarray:
        """Bits of a block."""
        k = plane * self.per_plane + block
        start = self.first if k == 0 else self.ends[k - 1]
        packed = _unpack(self.data[start : self.ends[k]], np.uint8)
        return np.unpackbits(packed, bitorder="little")[: self.n - block * self.block_bits]

    def _rank1(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        block, rest = divmod(i, self.block_bits)
        return int(self.ones[plane, block]) + (int(self._block(plane, block)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) `bit` of a plane."""
        before = self.ones[plane] if bit else np.minimum(np.arange(self.per_plane + 1) * self.block_bits, self.n) - self.ones[plane]
        block = int(np.searchsorted(before, k, side="right")) - 1
        return block * self.block_bits + int(np.flatnonzero(self._block(plane, block) == bit)[k - before[block]])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.width):
            block, rest = divmod(i, self.block_bits)
            bit, ones = int(self._block(plane, block)[rest]), self._rank1(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, value: int, start: int, end: int) -> tuple[int, int]:
        if value < 0 or value >> self.width:
            return 0, 0
        for plane in range(self.width):
            a, b = self._rank1(plane, start), self._rank1(plane, end)
            one = value >> self.width - 1 - plane & 1
            start, end = (self.zeros[plane] + a, self.zeros[plane] + b) if one else (start - a, end - b)
        return start, end

    def rank(self, value: int, i: int) -> int:
        """How often the id stands before position i."""
        start, end = self._range(value, 0, i)
        return end - start

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often the id stands in [start, end)."""
        a, b = self._range(value, start, self.n if end is None else end)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of the id; -1 if there are fewer."""
        a, b = self._range(value, 0, self.n)
        if not 0 <= k < b - a:
            return -1
        at = a + k
        for plane in reversed(range(self.width)):
            one = value >> self.width - 1 - plane & 1
            at = self._select(plane, one, at - self.zeros[plane] if one else at)
        return at

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, k) for k in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        values = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        unpack = zstandard.ZstdDecompressor().decompress
        begins = np.append(self.first, self.ends)
        for plane in reversed(range(self.width)):
            cuts = begins[plane * self.per_plane : (plane + 1) * self.per_plane + 1].tolist()
            packed = b"".join(unpack(self.data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: self.n].view(bool)
            above = np.empty_like(values)
            np.place(above, ~bits, values[: self.zeros[plane]])
            np.place(above, bits, values[self.zeros[plane] :] | values.dtype.type(1 << self.width - 1 - plane))
            values = above
        return values
