"""Vantage-point trees over bit fingerprints under Hamming distance.

A tree is fitted to a bounded sample: each inner node has a vantage fingerprint and a radius mu, near points (distance
at most mu) go left, the others right. A fingerprint has one home leaf; as a query of radius r it visits each leaf that
the triangle bounds leave open: left if d - r <= mu, right if d + r > mu. Every pair within r thus meets in the home
leaf of either partner. Within a leaf the tree is carried on in memory until a block is small enough to compare.
"""

from __future__ import annotations

import numpy as np

#: Pairs from which a block is split further, and pairs compared at once, which bounds what a dense block holds in memory.
BLOCK_PAIRS, COMPARED_PAIRS = 4_000_000, 500_000


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of uint64 words; a and b broadcast against each other."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int16)


class VPTree:
    """nodes: (vantage, mu, left, right), where a child >= 0 is a node and ~child a leaf."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.nodes: list[tuple[np.ndarray, int, int, int]] = []
        self.leaves, self.rng = 0, np.random.default_rng(seed)
        self.root = self._grow(sample, depth)

    def _grow(self, points: np.ndarray, depth: int) -> int:
        if depth > 0 and len(points) > 8:
            vantage, mu = split(points, self.rng)
            if vantage is not None:
                at = len(self.nodes)
                self.nodes.append(None)
                near = distances(points, vantage) <= mu
                self.nodes[at] = (vantage, mu, self._grow(points[near], depth - 1), self._grow(points[~near], depth - 1))
                return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home) of every visit; a row has one visit with home True."""
        out, todo = [], [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            at, rows, home = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                out.append((rows, np.full(len(rows), ~at), home))
                continue
            vantage, mu, left, right = self.nodes[at]
            d = distances(points[rows], vantage)
            for child, own, open_ in ((left, d <= mu, d - radius <= mu), (right, d > mu, d + radius > mu)):
                todo.append((child, rows[open_], home[open_] & own[open_]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def split(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray | None, int]:
    """A vantage point and the distance that parts the points most evenly; None if no distance parts them."""
    for at in rng.choice(len(points), min(4, len(points)), replace=False):
        d = np.sort(distances(points, points[at]))
        cuts = np.flatnonzero(d[1:] > d[:-1])
        if len(cuts):
            cut = cuts[np.argmin(np.abs(cuts + 1 - len(points) / 2))]
            if min(cut + 1, len(points) - cut - 1) >= len(points) // 20:
                return points[at], int(d[cut])
    return None, 0


class Links:
    """Union by least index over local items."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins a[i] with b[i]: hooks the larger root below the smaller until all agree."""
        while len(a):
            roots = self.roots()
            a, b = roots[a], roots[b]
            live = a != b
            a, b = a[live], b[live]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def link_leaf(members: np.ndarray, queries: np.ndarray, radius: int, links: Links, of_members: np.ndarray, of_queries: np.ndarray, shift: np.ndarray, keep=None, rng: np.random.Generator | None = None) -> None:
    """Joins each member and query within the radius; of_*: their indices in links. shift is the bits' mask for the tree's distance.

    members and queries: rows of uint64 words. keep(i, j): further exact condition on indices, vectorised.
    """
    rng = rng or np.random.default_rng(11)
    if not len(members) or not len(queries):
        return
    if len(members) * len(queries) > BLOCK_PAIRS and len(members) > 512:
        vantage, mu = split(members & shift, rng)
        if vantage is not None:
            near, d = distances(members & shift, vantage) <= mu, distances(queries & shift, vantage)
            share = (np.mean(d - radius[0] <= mu) + np.mean(d + radius[0] > mu)) / 2
            if share < 0.9:
                for own, open_ in ((near, d - radius[0] <= mu), (~near, d + radius[0] > mu)):
                    link_leaf(members[own], queries[open_], radius, links, of_members[own], of_queries[open_], shift, keep, rng)
                return
    step = max(1, COMPARED_PAIRS // len(members))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        i, j = np.nonzero(distances(part[:, None], members[None]) <= radius[1])
        a, b = of_queries[at + i], of_members[j]
        if keep is not None and len(a):
            ok = keep(a, b)
            a, b = a[ok], b[ok]
        links.join(a, b)
