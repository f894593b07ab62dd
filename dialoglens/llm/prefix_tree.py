"""A prefix tree of sorted sets, joined with a set at a time."""

from __future__ import annotations

import numpy as np


class PrefixTree:
    """Sets of dense ranks (ascending) with paths compressed: a node's edge holds ranks that all sets below share.

    Nodes are numbered level by level. A probe walks the levels once for all branches: a node's overlap with
    the probe is its parent's plus the matches on its edge, so sets with a common prefix share that count. A
    subtree is left as soon as what remains of the probe, or the longest rest below, can't reach the overlap
    that its smallest set needs.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sizes = sizes
        packed = [s.astype(">u4").tobytes() for s in sets]
        order = sorted(range(len(sets)), key=packed.__getitem__)
        parent, level, start, length, source = [-1], [0], [0], [0], [0]
        home = np.zeros(len(sets), dtype=np.int64)
        depth = [0]  # ranks from the root to the node's end
        path = [0]
        before: np.ndarray | None = None
        for i in order:
            own = sets[i]
            common = 0
            if before is not None:
                m = min(len(before), len(own))
                differ = np.flatnonzero(before[:m] != own[:m])
                common = int(differ[0]) if len(differ) else m
            while depth[path[-1]] > common and depth[parent[path[-1]]] >= common:
                path.pop()
            top = path[-1]
            if depth[top] > common:  # split the edge: a new node takes its upper part
                up, at = parent[top], len(parent)
                cut = common - depth[up]
                parent.append(up)
                start.append(start[top])
                length.append(cut)
                source.append(source[top])
                depth.append(common)
                parent[top], start[top], length[top] = at, start[top] + cut, length[top] - cut
                path[-1] = at
                top = at
            if len(own) > common:
                parent.append(top)
                start.append(common)
                length.append(len(own) - common)
                source.append(i)
                depth.append(len(own))
                top = len(parent) - 1
                path.append(top)
            home[i] = top
            before = own
        n = len(parent)
        par, dep = np.array(parent), np.array(depth)
        level = np.zeros(n, dtype=np.int64)
        for node in np.argsort(dep, kind="stable"):
            if node:
                level[node] = level[par[node]] + 1
        rank = np.empty(n, dtype=np.int64)
        by = np.lexsort((np.arange(n), level))
        rank[by] = np.arange(n)
        self.parent = np.where(par[by] >= 0, rank[par[by]], 0)
        self.level_first = np.searchsorted(level[by], np.arange(level.max() + 2))
        self.home = rank[home]
        edges = [sets[source[k]][start[k] : start[k] + length[k]] if k else np.empty(0, np.int64) for k in by]
        self.edge_size = np.array([len(e) for e in edges])
        self.edge_first = np.concatenate([[0], np.cumsum(self.edge_size)[:-1]])
        self.ranks = np.concatenate(edges).astype(np.int64) if len(edges) else np.empty(0, np.int64)
        self.last = np.array([e[-1] if len(e) else -1 for e in edges])
        self.least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.home, sizes)
        self.rest = np.zeros(n, dtype=np.int64)  # longest way from a node's end to the end of a set below
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            self.least[p] = min(self.least[p], self.least[k])
            self.rest[p] = max(self.rest[p], self.rest[k] + self.edge_size[k])

    def within(self, own: np.ndarray, size: int, percent: int, n_ranks: int) -> np.ndarray:
        """Numbers of the sets with 100 * intersection >= percent * union; ``size`` counts ranks no other set has, too."""
        holds = np.zeros(n_ranks + 1, dtype=np.int64)
        holds[own] = 1
        upto = np.cumsum(holds)
        overlap = np.full(len(self.parent), -1, dtype=np.int64)
        overlap[0] = 0
        for a, b in zip(self.level_first[1:-1], self.level_first[2:], strict=True):
            nodes = np.arange(a, b)
            nodes = nodes[overlap[self.parent[nodes]] >= 0]
            if not len(nodes):
                break
            sizes = self.edge_size[nodes]
            at = np.repeat(self.edge_first[nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            met = overlap[self.parent[nodes]] + np.add.reduceat(holds[self.ranks[at]], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            left = np.minimum(len(own) - upto[self.last[nodes]], self.rest[nodes])
            good = (100 + percent) * (met + left) >= percent * (size + self.least[nodes])
            overlap[nodes[good]] = met[good]
        found = overlap[self.home]
        return np.flatnonzero((found >= 0) & ((100 + percent) * found >= percent * (size + self.sizes)))


def linked(sets: list[np.ndarray], sizes: np.ndarray, sides: np.ndarray, percent: int) -> np.ndarray:
    """For each set the smallest number of a set that it is linked with, over any number of links.

    Where both values occur in ``sides``, only sets of different sides are compared.
    """
    n_ranks = int(max((s[-1] for s in sets if len(s)), default=-1)) + 1
    tree, label = PrefixTree(sets, sizes), np.arange(len(sets))
    two = sides.min() != sides.max()
    for i, own in enumerate(sets):
        hits = tree.within(own, int(sizes[i]), percent, n_ranks)
        if two:
            hits = hits[sides[hits] != sides[i]]
        met = np.unique(label[np.append(hits, i)])
        if len(met) > 1:
            label[np.isin(label, met[1:])] = met[0]
    return label
