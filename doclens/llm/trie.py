"""A prefix tree over sorted sets and the Jaccard join that traverses it.

Sets are ordered by one global order of their elements and stored as paths, so that sets which begin alike share nodes.
A probe walks the tree from the root, level by level: the overlap with a node's elements is computed once for all sets
below it, and a subtree is left as soon as what remains of the probe and of its sets cannot reach the overlap needed.
"""

from __future__ import annotations

import numpy as np


class Trie:
    """Path-compressed; nodes lie in order of level, so that the children of a node are neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        whole, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # within the tree, frequent elements come first: then similar sets share long paths
        rank = np.empty(len(whole), dtype=np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(whole))
        cuts = np.cumsum([len(s) for s in sets])[:-1]
        self.paths = [np.sort(p) for p in np.split(rank[which], cuts)]
        self.sizes = np.array([len(p) for p in self.paths], dtype=np.int64)
        self.member = np.zeros(len(whole), dtype=bool)
        self._build()

    def _build(self) -> None:
        order = sorted(range(len(self.paths)), key=lambda k: self.paths[k].astype(">u4").tobytes())
        parent, begin, end, owner, leaf = [-1], [0], [0], [order[0]], [-1]

        def node(up: int, a: int, b: int, of: int, is_leaf: bool) -> int:
            parent.append(up)
            begin.append(a)
            end.append(b)
            owner.append(of)
            leaf.append(of if is_leaf else -1)
            return len(parent) - 1

        stack = [0]
        for k, of in enumerate(order):
            path = self.paths[of]
            if k:
                before = self.paths[order[k - 1]]
                n = min(len(path), len(before))
                differ = np.flatnonzero(path[:n] != before[:n])
                shared = int(differ[0]) if len(differ) else n
                last = -1
                while end[stack[-1]] > shared:
                    last = stack.pop()
                if last >= 0 and end[stack[-1]] < shared:  # the edge to `last` splits
                    middle = node(stack[-1], begin[last], shared, owner[last], False)
                    parent[last], begin[last] = middle, shared
                    stack.append(middle)
                elif last < 0 and leaf[stack[-1]] >= 0:  # the set before is a prefix of this one; its leaf moves below a node of the same depth
                    old = stack.pop()
                    middle = node(parent[old], begin[old], end[old], owner[old], False)
                    parent[old], begin[old] = middle, end[old]
                    stack.append(middle)
            stack.append(node(stack[-1], end[stack[-1]], len(path), of, True))
        parent, begin, end = np.array(parent), np.array(begin), np.array(end)
        level = np.full(len(parent), -1)
        level[0] = 0
        frontier, children = [0], [[] for _ in range(len(parent))]
        for k, up in enumerate(parent.tolist()):
            if up >= 0:
                children[up].append(k)
        placed = [0]
        while frontier:
            frontier = [c for f in frontier for c in children[f]]
            placed.extend(frontier)
        place = np.empty(len(parent), dtype=np.int64)
        place[placed] = np.arange(len(placed))
        at = np.array(placed)
        self.leaf = np.array(leaf)[at]
        self.end = end[at]
        self.n_children = np.array([len(children[k]) for k in placed])
        self.first_child = np.cumsum(self.n_children) - self.n_children + 1
        up = np.where(parent[at] >= 0, place[parent[at]], 0)
        low = np.where(self.leaf >= 0, self.sizes[self.leaf], np.iinfo(np.int64).max)
        high = np.where(self.leaf >= 0, self.sizes[self.leaf], 0)
        for k in range(len(at) - 1, 0, -1):
            low[up[k]] = min(low[up[k]], low[k])
            high[up[k]] = max(high[up[k]], high[k])
        self.low, self.high = low, high
        edges = [self.paths[owner[k]][begin[k] : end[k]] for k in placed]
        self.edge = np.concatenate(edges)
        self.edge_size = np.array([len(e) for e in edges])
        self.edge_at = np.cumsum(self.edge_size) - self.edge_size
        self.last = np.array([int(self.paths[owner[k]][end[k] - 1]) if end[k] else -1 for k in placed])

    def similar(self, k: int, percent: int) -> np.ndarray:
        """The sets y (k itself among them) with 100 |x & y| >= percent |x | y|, x being set k."""
        x, n = self.paths[k], len(self.paths[k])
        self.member[x] = True
        seen = np.cumsum(np.concatenate([[0], self.member[self.edge]]))
        nodes, overlap = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        found = []
        while len(nodes):
            size = self.n_children[nodes]
            below = np.repeat(self.first_child[nodes] - np.cumsum(size) + size, size) + np.arange(size.sum())
            shared = np.repeat(overlap, size) + seen[self.edge_at[below] + self.edge_size[below]] - seen[self.edge_at[below]]
            rest = n - np.searchsorted(x, self.last[below], "right")
            depth = self.end[below]
            best = np.clip(depth + rest, self.low[below], self.high[below])
            reach = shared + np.minimum(rest, best - depth)
            going = (100 + percent) * reach >= percent * (n + best)
            nodes, overlap = below[going], shared[going]
            ends = self.leaf[nodes] >= 0
            hit = nodes[ends]
            exact = (100 + percent) * overlap[ends] >= percent * (n + self.sizes[self.leaf[hit]])
            found.append(self.leaf[hit][exact])
        self.member[x] = False
        return np.concatenate(found)


def linked(sets: list[np.ndarray], percent: int, probes: np.ndarray | None = None) -> list[int]:
    """A representative for each set: sets linked by similarity, directly or through others, share one.

    A set that already is in the largest component needs no probe of its own: every set outside it is probed against all.
    With `probes` (a mask), only those are probed, and a link between two other sets may be missed.
    """
    up = list(range(len(sets)))
    if len(sets) < 2:
        return up

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    tree = Trie(sets)
    weight = [1] * len(sets)
    largest = 0

    def probe(k: int) -> None:
        nonlocal largest
        for j in tree.similar(k, percent).tolist():
            a, b = root(k), root(j)
            if a != b:
                a, b = (a, b) if weight[a] >= weight[b] else (b, a)
                up[b] = a
                weight[a] += weight[b]
            if weight[a] > weight[root(largest)]:
                largest = a

    if probes is not None:
        for k in np.flatnonzero(probes).tolist():
            probe(k)
        return [root(k) for k in range(len(sets))]
    waiting = np.argsort(tree.sizes, kind="stable").tolist()
    waiting = waiting[len(waiting) // 2 :] + waiting[: len(waiting) // 2]
    probe(waiting.pop(0))
    while True:
        outside = [k for k in waiting if root(k) != root(largest)]
        if not outside:
            return [root(k) for k in range(len(sets))]
        done = set()
        for k in outside:
            if root(k) != root(largest):
                probe(k)
                done.add(k)
        waiting = [k for k in waiting if k not in done]
