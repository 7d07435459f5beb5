"""A Gray-order hierarchical index of 64-bit fingerprints, and its search for near ones.

Fingerprints are sorted by Gray rank, so that neighbours in the order share many bits. Every ``FAN`` consecutive ones
have a node above them with the bits that all of them share: a mask and a pattern under it; every ``FAN`` nodes have
again one. A node's mask holds its parent's, so going down only the bits that come new are compared, and the
differences add up; a group whose sum exceeds the limit is left out whole.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
FAN = 16
ALL = U64(0xFFFFFFFFFFFFFFFF)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(shift)
    return rank


def shared(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of the bits that each stretch of codes shares."""
    least, most = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
    mask = ~(least ^ most)
    return mask, least & mask


class GrayIndex:
    """Of codes in Gray order. ``levels`` go from the top to the codes: masks and patterns."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        low, high = codes, codes
        self.levels = [(np.full(len(codes), ALL), codes)]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask))
        self.levels.reverse()

    def search(self, queries: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a query, place of a code) that differ in ``limit`` bits or fewer."""
        top = len(self.levels[0][0])
        q = np.repeat(np.arange(len(queries)), top)
        node = np.tile(np.arange(top), len(queries))
        spent = np.zeros(len(q), np.uint8)
        above = None
        for depth, (mask, pattern) in enumerate(self.levels):
            new = mask[node] if above is None else mask[node] & ~above
            spent = spent + np.bitwise_count((queries[q] ^ pattern[node]) & new)
            near = spent <= limit
            q, node, spent = q[near], node[near], spent[near]
            if depth + 1 < len(self.levels):
                below = len(self.levels[depth + 1][0])
                above = np.repeat(mask[node], FAN)
                q, spent = np.repeat(q, FAN), np.repeat(spent, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                if len(node) and int(node.max()) >= below:
                    there = node < below
                    q, node, spent, above = q[there], node[there], spent[there], above[there]
        return q, node


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) between numbers, as (number, root) without the roots: the same components, a link a number."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(names))
    while True:
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]
