"""A Hamming-distance index over fingerprints in Gray order, for one range of them.

Sorted by Gray rank, neighbours differ in few bits.  Runs of FAN neighbours share a
node that keeps the bits on which they agree; what an upper node holds is factored
out of the nodes below it.  A search adds up the differences with the factored bits
on its way down and leaves out a whole group as soon as they pass the limit; at a
leaf the sum is the distance itself.
"""

from __future__ import annotations

import numpy as np

FAN = 8
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the reflected Gray sequence."""
    rank = words.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """`words` must be in Gray order."""

    def __init__(self, words: np.ndarray):
        pattern, mask = words, np.full(len(words), ALL)
        levels = [(pattern, mask)]
        while len(pattern) > FAN:
            starts = np.arange(0, len(pattern), FAN)
            agree = ~(np.bitwise_or.reduceat(pattern, starts) ^ np.bitwise_and.reduceat(pattern, starts))
            mask = agree & np.bitwise_and.reduceat(mask, starts)
            pattern = pattern[starts] & mask
            levels.append((pattern, mask))
        #: Per level: bits, and which of them are not yet held above.
        self.levels = []
        for k, (pattern, mask) in enumerate(levels):
            above = levels[k + 1][1][np.arange(len(pattern)) // FAN] if k + 1 < len(levels) else np.zeros(len(pattern), np.uint64)
            self.levels.append((pattern, mask & ~above))

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, word number) of all pairs at most `limit` bits apart."""
        top = len(self.levels[-1][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        apart = np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, own = self.levels[level]
            apart = apart + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            near = apart <= limit
            q, node, apart = q[near], node[near], apart[near]
            if level:
                width = len(self.levels[level - 1][0])
                q, apart = np.repeat(q, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                there = node < width
                q, node, apart = q[there], node[there], apart[there]
        return q, node


def roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Join the ends of the pairs (a, b): the root of each of n nodes, starting from `label`."""
    label = np.arange(n) if label is None else label
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while not np.array_equal(label, label[label]):
            label = label[label]


def linked(words: np.ndarray, limit: int, block: int = 128) -> np.ndarray:
    """Root number of each word: two words share it if a chain of near words joins them."""
    order = np.argsort(gray_rank(words), kind="stable")
    index, label = GrayIndex(words[order]), np.arange(len(words))
    for start in range(0, len(words), block):
        q, found = index.search(words[order[start : start + block]], limit)
        q += start
        keep = found > q
        label = roots(len(words), q[keep], found[keep], label)
    out = np.empty(len(words), np.int64)
    out[order] = order[label]
    return out
