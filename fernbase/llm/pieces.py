"""Many short pieces of text at once: byte classes, hashes of spans, a table from hashes to places.

Hashes only say where to look: whoever takes a place from the table compares the bytes (:class:`Known`).
"""

from __future__ import annotations

import numpy as np

SPACE, LETTER, DIGIT, SIGN, ODD = range(5)
#: Classes of single bytes; ODD are control characters, the apostrophe and all but ASCII.
_CLASS = np.full(256, ODD, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
_CLASS[0x27] = ODD
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def classes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """The class of every byte. Two-byte Latin letters count as letters, but U+0130, whose lower case is a
    letter and a mark; with ``fold`` those of U+00C0 to U+00DE become lower case in ``data``."""
    kind = _CLASS[data]
    if (data >= 0x80).any():
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
        second = data[lead + 1]
        latin = data[lead] == 0xC3
        sign = latin & ((second == 0x97) | (second == 0xB7))
        dotted = (data[lead] == 0xC4) & (second == 0xB0)
        kind[lead] = kind[lead + 1] = np.where(dotted, ODD, np.where(sign, SIGN, LETTER))
        if fold:
            data[lead[latin & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 32
    return kind


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHash:
    """64-bit hashes of many spans of a buffer, from one prefix sum of byte times power. Never zero."""

    def __init__(self) -> None:
        self.power, self.inverse = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def __call__(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(raw) >= len(self.power):
            self.power, self.inverse = _powers(_BASE, len(raw) + 1), _powers(_INVERSE, len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)], out=total[1:])
        keys = (total[end] - total[start]) * self.inverse[start]
        keys ^= keys >> np.uint64(32)
        keys |= (keys == 0).astype(np.uint64)
        return keys


def _octets(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number; ``raw`` has seven bytes to spare."""
    return np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))


class Known:
    """The bytes of pieces, by place, and exact comparison of many spans with them, eight bytes at a time."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.raw, self.begin, self.n = np.zeros(1 << 16, np.uint8), np.zeros(1 << 12, np.int64), 0

    def add(self, pieces: list[bytes]) -> None:
        """The pieces get the next places."""
        at = int(self.begin[self.n])
        ends = at + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        end = int(ends[-1]) if len(ends) else at
        while len(self.raw) < end + 8:
            self.raw = np.concatenate([self.raw, np.zeros_like(self.raw)])
        while len(self.begin) <= self.n + len(pieces):
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        self.raw[at:end] = np.frombuffer(b"".join(pieces), np.uint8)
        self.begin[self.n + 1 : self.n + 1 + len(pieces)] = ends
        self.n += len(pieces)

    def same(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each span of ``raw`` (seven bytes to spare at its end) is the piece at its place."""
        at, size = self.begin[place], end - start
        equal = self.begin[place + 1] - at == size
        here, there = _octets(raw), _octets(self.raw)
        rest = np.flatnonzero(equal)
        done = 0
        while len(rest):
            left = size[rest] - done
            differ = here[start[rest] + done] ^ there[at[rest] + done]
            short = left < 8
            differ[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
            wrong = differ != 0
            equal[rest[wrong]] = False
            rest = rest[~wrong & (left > 8)]
            done += 8
        return equal


class PieceTable:
    """From 64-bit hashes to places, by open addressing, many at a time. Two pieces may share a hash."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        self.keys, self.places, self.size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32), 0

    def room(self) -> int:
        return (1 << self.bits) * 6 // 10 - self.size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys, -1 where unknown. A key is not zero."""
        out = np.full(len(keys), -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.places[slot[hit]]
            on = ~hit & (there != 0)
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, places: np.ndarray) -> None:
        """Distinct new keys."""
        self.size += len(keys)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[rest[free]]  # of several for one slot the last is in
            done = self.keys[slot] == keys[rest]
            self.places[slot[done]] = places[rest[done]]
            rest, slot = rest[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)
