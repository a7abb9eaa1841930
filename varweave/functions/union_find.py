"""Union-find: over arrays of edges at once, and pair by pair with ranks and sets of files."""

from __future__ import annotations

import numpy as np


def smallest_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges with the smallest vertex of its component.

    All edges at once: the larger root of every edge is hung under the smallest root that an edge links it to, the paths
    are halved until they are flat, and edges within one tree are dropped, until none is left.
    """
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    parent = np.arange(len(names))
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return names, names[parent]
        # Names are sorted, so the smaller position is the smaller key.
        a, b = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
        np.minimum.at(parent, b, a)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


class Fold:
    """A disjoint set of row keys whose sets carry the files they hold. On equal ranks the left set's root stays, with
    ``lower_wins`` the lower root."""

    def __init__(self, lower_wins: bool = False) -> None:
        self.parent: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.files: dict[int, int] = {}
        self.touched: dict[int, None] = {}
        self.lower_wins = lower_wins

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def offer(self, lhs: int, lhs_files: int, rhs: int, rhs_files: int) -> bool:
        """Unite the two sets unless they are one already or share a file."""
        x, y = self.find(lhs), self.find(rhs)
        if x == y:
            return False
        fx, fy = self.files.get(x, lhs_files), self.files.get(y, rhs_files)
        if fx & fy:
            return False
        rx, ry = self.rank.get(x, 0), self.rank.get(y, 0)
        swap = rx < ry or (rx == ry and self.lower_wins and y < x)
        root, other = (y, x) if swap else (x, y)
        self.parent[other] = root
        if rx == ry:
            self.rank[root] = rx + 1
        self.files.pop(other, None)
        self.files[root] = fx | fy
        self.touched[lhs] = self.touched[rhs] = None
        return True

    def updates(self) -> list[tuple[int, int, int, int]]:
        """(key, root, files, number of files) of every key that was united."""
        out = []
        for key in self.touched:
            root = self.find(key)
            files = self.files[root]
            out.append((key, root, files, (files & ((1 << 64) - 1)).bit_count()))
        return out
