"""Nested sets and closures over arrays: the form in which whole small graphs are processed within a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs made at once.
PAIRS = 1_000_000


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... (sizes[0] of them), starts[1], ..."""
    total = int(sizes.sum())
    if not total:
        return np.empty(0, dtype=np.int64)
    skip = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return np.arange(total) + skip


class NestedSets:
    """Numbers of a forest given by ``parent`` (-1 for none): ``size, lo, depth, root`` and ``ranged``.

    Sizes are added up from the leaves; nodes they never complete are ``looped``. Ranges are handed down from the roots,
    to each child after the sum of the sizes of the siblings before it; what no root reaches is not ``ranged``. Numbers
    run on over all trees, so ``order[lo + 1 : lo + size]`` are a node's descendants.
    """

    def __init__(self, parent: np.ndarray):
        n = len(parent)
        self.parent, self.size = parent, np.ones(n, dtype=np.int64)
        waiting = np.bincount(parent[parent >= 0], minlength=n)
        done = np.zeros(n, dtype=bool)
        front = np.flatnonzero(waiting == 0)
        while len(front):
            done[front] = True
            up = parent[front]
            ok = up >= 0
            np.add.at(self.size, up[ok], self.size[front[ok]])
            np.subtract.at(waiting, up[ok], 1)
            touched = np.unique(up[ok])
            front = touched[waiting[touched] == 0]
        self.looped = ~done
        kids = np.flatnonzero(parent >= 0)
        kids = kids[np.argsort(parent[kids], kind="stable")]
        count = np.bincount(parent[kids], minlength=n)
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        run = np.concatenate([[0], np.cumsum(self.size[kids])])
        off = np.zeros(n, dtype=np.int64)
        off[kids] = run[:-1] - run[first[parent[kids]]]
        self.lo, self.depth, self.root = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.arange(n)
        self.ranged = np.zeros(n, dtype=bool)
        front = np.flatnonzero((parent < 0) & done)
        self.lo[front] = np.cumsum(self.size[front]) - self.size[front]
        self.levels = []
        while len(front):
            self.ranged[front] = True
            self.levels.append(front)
            below = kids[_ragged(first[front], count[front])]
            up = parent[below]
            self.lo[below] = self.lo[up] + 1 + off[below]
            self.depth[below], self.root[below] = self.depth[up] + 1, self.root[up]
            front = below
        self.order = np.empty(int(self.ranged.sum()), dtype=np.int64)
        self.order[self.lo[self.ranged]] = np.flatnonzero(self.ranged)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ancestor, descendant, depth between them), a bounded number at a time."""
        a = np.flatnonzero(self.ranged & (self.size > 1))
        ends = np.cumsum(self.size[a] - 1)
        start = 0
        while start < len(a):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
            part = a[start:stop]
            below = self.order[_ragged(self.lo[part] + 1, self.size[part] - 1)]
            above = np.repeat(part, self.size[part] - 1)
            yield above, below, self.depth[below] - self.depth[above]
            start = stop


def closure(n: int, child: np.ndarray, parent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ancestor, descendant, least number of links) over edges of any shape, breadth first."""
    order = np.argsort(child, kind="stable")
    ups = parent[order]
    count = np.bincount(child, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    front = np.unique(child * n + parent)
    seen, depth = front, 1
    while len(front):
        d, a = front // n, front % n
        yield a, d, np.full(len(a), depth)
        nxt = np.unique(np.repeat(d, count[a]) * n + ups[_ragged(first[a], count[a])])
        front = np.setdiff1d(nxt, seen, assume_unique=True)
        seen = np.union1d(seen, front)
        depth += 1


def rooted(n: int, child: np.ndarray, parent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(nodes on loops, nodes below loops, number of descendants, levels) over edges of any shape.

    Level k has (node, root, place in level k - 1 of the parent that leads there) of every node whose least number of
    links to a root is k; of parents as near, the one of least ``rank``. Roots are the nodes without parents and, of each
    loop that no edge leaves, the node of least rank.
    """
    n_above, n_below, on = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    steps = [(a, d) for a, d, _ in closure(n, child, parent)]
    for a, d in steps:
        n_above += np.bincount(d, minlength=n)
        n_below += np.bincount(a, minlength=n)
        on[d[a == d]] = True
    # The ancestors of a loop that no edge leaves are its nodes, who all have the same ones.
    least, first, below = n_above.copy(), rank.copy(), np.zeros(n, dtype=bool)
    for a, d in steps:
        np.minimum.at(least, d, n_above[a])
        np.minimum.at(first, d, rank[a])
        below[d[on[a]]] = True
    is_root = (n_above == 0) | (on & (least == n_above) & (first == rank))
    order = np.argsort(child, kind="stable")
    ups, count = parent[order], np.bincount(child, minlength=n)
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    r = np.flatnonzero(is_root)
    levels, keys = [(r, r, np.full(len(r), -1))], r * n + r
    for a, d in steps:
        keep = is_root[a] & (a != d)
        x, r = d[keep], a[keep]
        if not len(x):
            break
        row = np.repeat(np.arange(len(x)), count[x])
        p = ups[_ragged(start[x], count[x])]
        want = p * n + r[row]
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        hit = keys[at] == want
        row, p, at = row[hit], p[hit], at[hit]
        by = np.lexsort((rank[p], row))
        one = by[np.unique(row[by], return_index=True)[1]]
        levels.append((x, r, at[one]))
        keys = x * n + r
    return on, below, n_below, levels
