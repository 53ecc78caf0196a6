"""Counting quotient filters without loss: counters of packed words' numbers.

A phrase of n words is n numbers of equal width, packed into one key.  An invertible
permutation spreads the keys evenly; the permuted key is cut into a quotient and its whole
remainder, so that nothing is lost: the key can be had back.  A filter keeps, ordered by key,
how many keys each quotient has, the remainders in as many bytes as they need, and small
counts in one byte each.  Ordered filters are merged, counts of equal keys added.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 4
KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
MULTIPLIER = 0xBF58476D1CE4E5B9
ESCAPE = 255  # counts from here on stand in a list of their own


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(MULTIPLIER)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(KEYS[0])
    return x ^ (x >> np.uint64(29))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


class Packing:
    """Keys of ``words`` numbers below 2**``bits``, in two halves of at most 64 bits."""

    def __init__(self, words: int, bits: int):
        if words * bits > 128:
            raise ValueError("a key has at most 128 bits")
        self.words, self.bits = words, bits
        self.right_bits = words * bits // 2
        self.left_bits = words * bits - self.right_bits

    def packed(self, numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        left = np.zeros(len(numbers[0]), dtype=np.uint64)
        right = left.copy()
        for no, column in enumerate(reversed(numbers)):
            column, low = column.astype(np.uint64), no * self.bits
            if low < self.right_bits:
                right |= (column << np.uint64(low)) & _mask(self.right_bits)
            if low >= self.right_bits:
                left |= column << np.uint64(low - self.right_bits)
            elif low + self.bits > self.right_bits:
                left |= column >> np.uint64(self.right_bits - low)
        return left, right

    def unpacked(self, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
        numbers = []
        for no in range(self.words):
            low = no * self.bits
            if low >= self.right_bits:
                column = left >> np.uint64(low - self.right_bits)
            else:
                column = right >> np.uint64(low)
                if low + self.bits > self.right_bits:
                    column = column | (left << np.uint64(self.right_bits - low))
            numbers.append((column & _mask(self.bits)).astype(np.int64))
        return numbers[::-1]

    def permuted(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in KEYS[:ROUNDS]:
            right = right ^ (_mixed(left, key) & _mask(self.right_bits))
            left = left ^ (_mixed(right, key ^ MULTIPLIER) & _mask(self.left_bits))
        return left, right

    def restored(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for key in reversed(KEYS[:ROUNDS]):
            left = left ^ (_mixed(right, key ^ MULTIPLIER) & _mask(self.left_bits))
            right = right ^ (_mixed(left, key) & _mask(self.right_bits))
        return left, right

    def ordered(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray, merging: bool = False):
        """The keys in order, each once, with the sum of its counts; ``merging`` ordered filters."""
        if not len(left):
            return left, right, counts
        kind = "stable" if merging else None  # which merges what is in order already
        if self.left_bits + self.right_bits <= 64:
            order = np.argsort((left << np.uint64(self.right_bits)) | right, kind=kind)
        else:
            order = np.argsort(left, kind=kind)
            if ((left[order][1:] == left[order][:-1]) & (right[order][1:] != right[order][:-1])).any():
                order = np.lexsort((right, left))
        left, right, counts = left[order], right[order], counts[order]
        heads = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        return left[heads], right[heads], np.add.reduceat(counts, heads)


def _as_bytes(numbers: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _from_bytes(data: bytes, at: int, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
    return wide.view("<u8").ravel().astype(np.uint64)


class Filter:
    """The ordered keys of one range (those whose first ``range_bits`` bits are equal), as bytes."""

    def __init__(self, packing: Packing, range_bits: int):
        self.packing, self.range_bits = packing, range_bits
        self.rest_bits = packing.left_bits - range_bits
        self.right_width = -(-packing.right_bits // 8)

    def _widths(self, n: int) -> tuple[int, int]:
        quotient_bits = min(self.rest_bits, max(0, n.bit_length() - 1), 30)
        return quotient_bits, -(-(self.rest_bits - quotient_bits) // 8)

    def encoded(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray) -> bytes:
        n = len(left)
        quotient_bits, left_width = self._widths(n)
        rest = left & _mask(self.rest_bits)
        quotient = (rest >> np.uint64(self.rest_bits - quotient_bits)).astype(np.int64)
        runs = np.bincount(quotient, minlength=1 << quotient_bits)
        many, large = runs >= ESCAPE, counts >= ESCAPE
        head = np.array([n, many.sum(), large.sum()], dtype="<i8")
        return b"".join([
            head.tobytes(), np.where(many, ESCAPE, runs).astype(np.uint8).tobytes(), runs[many].astype("<i8").tobytes(),
            _as_bytes(rest & _mask(self.rest_bits - quotient_bits), left_width), _as_bytes(right, self.right_width),
            np.where(large, ESCAPE, counts).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes(),
        ])

    def decoded(self, data: bytes, range_no: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, many, large = np.frombuffer(data, "<i8", 3).tolist()
        quotient_bits, left_width = self._widths(n)
        at = 24
        runs = np.frombuffer(data, np.uint8, 1 << quotient_bits, at).astype(np.int64)
        at += len(runs)
        runs[runs == ESCAPE] = np.frombuffer(data, "<i8", many, at)
        at += 8 * many
        low = _from_bytes(data, at, n, left_width)
        at += n * left_width
        right = _from_bytes(data, at, n, self.right_width)
        at += n * self.right_width
        counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
        counts[counts == ESCAPE] = np.frombuffer(data, "<i8", large, at + n)
        quotient = np.repeat(np.arange(len(runs)), runs).astype(np.uint64)
        top = np.uint64(range_no << self.rest_bits) if self.rest_bits < 64 else np.uint64(0)
        return top | quotient << np.uint64(self.rest_bits - quotient_bits) | low, right, counts

    def split(self, left: np.ndarray, right: np.ndarray, counts: np.ndarray):
        """The filters of all ranges that have keys: range and bytes."""
        ranges = (left >> np.uint64(self.rest_bits)).astype(np.int64) if self.rest_bits < 64 else np.zeros(len(left), dtype=np.int64)
        heads = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]]) if len(left) else []
        for a, b in zip(heads, [*heads[1:], len(left)]):
            yield int(ranges[a]), self.encoded(left[a:b], right[a:b], counts[a:b])
