"""An FM-index over the words of a shard, and matching statistics of streamed texts by backward search.

The text itself is kept only as its Burrows-Wheeler transform in a wavelet matrix of packed bits. Beside
it lie, for shortening a match, the common prefix of each two neighbouring rows and the nearest rows with
a shorter one. Many texts are streamed in lock-step: one step extends or shortens the match of each.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with a count before each word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts[:-1], dtype=np.int64))).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, (n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = ((symbols >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(ones) - ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def move(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i rows' occurrences of the symbol end in the last level's order."""
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i


def _later(names: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(names)
    if by < len(names):
        out[: len(names) - by] = names[by:]
    return out


def _sorted_suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the common prefix of each with the one before (-1 at both ends). The ends of
    segments (0) count as different symbols, so no two suffixes are alike beyond one."""
    n = len(text)
    ends = text == 0
    first = text + int(ends.sum())
    first[ends] = np.arange(int(ends.sum()))
    names = [np.unique(first, return_inverse=True)[1].astype(np.int64)]
    while names[-1].max(initial=0) + 1 < n:
        width = 1 << (len(names) - 1)
        names.append(np.unique(names[-1] * (n + 1) + _later(names[-1], width), return_inverse=True)[1].astype(np.int64))
    suffix = np.empty(n, np.int64)
    suffix[names[-1]] = np.arange(n)
    shared = np.full(n + 1, -1, np.int32)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    length = np.zeros(max(0, n - 1), np.int32)
    for k in range(len(names) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (names[k][np.minimum(a, n - 1)] == names[k][np.minimum(b, n - 1)])
        length[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    shared[1:n] = length
    return suffix, shared


def _nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before and after it with a smaller value."""
    held = values.tolist()
    n = len(held)
    before, after, stack = [0] * n, [n - 1] * n, [0]
    for i in range(1, n):
        v = held[i]
        while held[stack[-1]] > v:
            after[stack.pop()] = i
        top = stack[-1]
        before[i] = before[top] if held[top] == v else top
        stack.append(i)
    return np.array(before, np.int32), np.array(after, np.int32)


class FMIndex:
    """``text``: symbols as numbers from 1, with a 0 after each segment, the last one included."""

    def __init__(self, text: np.ndarray):
        text = text.astype(np.int64)
        self.n = len(text)
        suffix, self.shared = _sorted_suffixes(text)
        self.before, self.after = _nearest_smaller(self.shared)
        n_symbols = int(text.max(initial=0)) + 1
        self.wavelet = WaveletMatrix(text[suffix - 1], n_symbols)
        every = np.arange(n_symbols)
        less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))[:-1]
        self.origin = less - self.wavelet.move(every, np.zeros(n_symbols, np.int64))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows that begin with symbol + match, from those of the match; none if low = high."""
        twice = np.concatenate([symbol, symbol])
        both = self.origin[twice] + self.wavelet.move(twice, np.concatenate([low, high]))
        return both[: len(symbol)], both[len(symbol) :]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next longer set of rows: those of the match without as many last symbols as all its rows share
        no more; and the length that is left."""
        at = np.where(self.shared[low] >= self.shared[high], low, high)
        return self.before[at].astype(np.int64), self.after[at].astype(np.int64), np.maximum(self.shared[at], 0).astype(np.int64)

    def statistics(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Matching statistics of the stretches begin[k] .. end[k] of ``text``, each streamed from right to left:
        for each place the length of the longest match that begins there and ends in its stretch. Symbols that
        the index lacks are 0."""
        out = np.zeros(len(text), np.int64)
        some = end > begin
        begin, at = begin[some].astype(np.int64), end[some].astype(np.int64)
        low, high, length = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.zeros(len(at), np.int64)
        while len(at):
            symbol = text[at - 1]
            new_low, new_high = self.extend(symbol, low, high)
            grows = (new_high > new_low) & (symbol > 0)
            stuck = ~grows & (length == 0)
            shrinks = ~grows & ~stuck
            low, high, length = np.where(grows, new_low, low), np.where(grows, new_high, high), length + grows
            if shrinks.any():
                low[shrinks], high[shrinks], length[shrinks] = self.shorten(low[shrinks], high[shrinks])
            at = at - (grows | stuck)
            out[at[grows]] = length[grows]
            live = at > begin
            if not live.all():
                begin, at, low, high, length = begin[live], at[live], low[live], high[live], length[live]
        return out
