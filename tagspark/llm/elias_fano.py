"""Elias-Fano coding of an ascending list of whole numbers, with constant-time access to each.

Of every number the lowest bits are stored as they are, and the rest in unary: the i-th number
sets bit (high part + i). The place of every 64th set bit is kept as well, so that the i-th number
is found by reading a few bytes. About 2 + log2(universe / n) bits per number.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
_HEAD = struct.Struct("<IBIII")  # numbers, low bits, bytes of low parts, bytes of high parts, samples


def encode(numbers: np.ndarray) -> bytes:
    """Bytes of an ascending array of non-negative 64-bit numbers; repeats are fine."""
    numbers = np.asarray(numbers, np.uint64)
    n = len(numbers)
    if not n:
        return _HEAD.pack(0, 0, 0, 0, 0)
    width = max(0, (int(numbers[-1]) // n).bit_length() - 1)
    places = np.arange(width, dtype=np.uint64)
    low = ((numbers[:, None] >> places) & np.uint64(1)).astype(np.uint8).ravel()
    ones = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    parts = [
        np.packbits(low, bitorder="little").tobytes(),
        np.packbits(high, bitorder="little").tobytes(),
        ones[::SAMPLE].astype("<u4").tobytes(),
    ]
    return _HEAD.pack(n, width, len(parts[0]), len(parts[1]), len(parts[2]) // 4) + b"".join(parts)


class EliasFano:
    """Reads what `encode` wrote."""

    def __init__(self, coded: bytes) -> None:
        self.n, self.width, low, high, samples = _HEAD.unpack_from(coded)
        at = _HEAD.size
        self.low = np.frombuffer(coded, np.uint8, low, at)
        self.high = np.frombuffer(coded, np.uint8, high, at + low)
        self.samples = np.frombuffer(coded, "<u4", samples, at + low + high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, missing = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        bits = int(self.high[byte]) >> at % 8 << at % 8
        while bits.bit_count() <= missing:
            missing -= bits.bit_count()
            byte += 1
            bits = int(self.high[byte])
        for _ in range(missing):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        start = i * self.width
        chunk = int.from_bytes(self.low[start // 8 : (start + self.width + 7) // 8].tobytes(), "little")
        return (place - i) << self.width | chunk >> start % 8 & (1 << self.width) - 1

    def all(self) -> np.ndarray:
        """All numbers."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width)
        places = np.arange(self.width, dtype=np.uint64)
        return high | (bits.astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
