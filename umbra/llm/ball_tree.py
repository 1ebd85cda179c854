"""Ball trees over one block of labelled vectors, searched by branch and bound.

A node is a ball: centre c and radius r.  The inner product of a query q with anything
inside lies between q.c - |q| r and q.c + |q| r.  A node is passed over if all of it
lies above a window, all of it below, or strictly beneath the k-th best found there so
far (what ties with the k-th can still win by its id).
"""

from __future__ import annotations

LEAF = 64


class Forest:
    """One ball tree for each label with LEAF rows or more in the block, one for the rest.

    Nodes stand parents first; ``own`` is the label of all rows of a node, where there is one.
    """

    def __init__(self, labels, vectors, leaf: int = LEAF):
        import numpy as np

        points = vectors.astype(float)
        names, which, sizes = np.unique(labels, return_inverse=True, return_counts=True)
        small = sizes[which] < leaf
        starts = [np.flatnonzero(~small & (which == i)) for i in np.flatnonzero(sizes >= leaf)]
        trees = [(rows, True) for rows in starts] + ([(np.flatnonzero(small), False)] if small.any() else [])
        centres, radii, parents, one, slices, order = [], [], [], [], [], []
        todo = [(rows, -1, pure) for rows, pure in reversed(trees)]
        at = 0
        while todo:
            rows, parent, pure = todo.pop()
            own = points[rows]
            centre = own.mean(axis=0)
            centres.append(centre)
            radii.append(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
            parents.append(parent)
            one.append(pure)
            me = len(parents) - 1
            if len(rows) <= leaf:
                slices.append((me, at, at + len(rows)))
                order.append(rows)
                at += len(rows)
                continue
            # Towards the two rows that lie farthest apart, as far as two steps find them.
            first = own[((own - centre) ** 2).sum(axis=1).argmax()]
            second = own[((own - first) ** 2).sum(axis=1).argmax()]
            side = np.argsort(own @ (second - first), kind="stable")
            half = len(rows) // 2
            todo += [(rows[side[half:]], me, pure), (rows[side[:half]], me, pure)]
        self.order = np.concatenate(order)
        self.labels, self.vectors = labels[self.order], vectors[self.order]
        self.centres, self.radii, self.parents = np.array(centres), np.array(radii), np.array(parents)
        self.depth = self._levels()
        self.leaves = np.array([n for n, _, _ in slices])
        self.starts, self.ends = np.array([a for _, a, _ in slices]), np.array([b for _, _, b in slices])
        leaf_label = np.array([self.labels[a] for _, a, _ in slices])
        self.own, self.leaf_label = np.array(one)[self.leaves], leaf_label

    def _levels(self):
        """Nodes by depth, so that what a parent forbids reaches its children level by level."""
        import numpy as np

        depth = np.zeros(len(self.parents), dtype=np.int64)
        for i, p in enumerate(self.parents):
            depth[i] = 0 if p < 0 else depth[p] + 1
        return [np.flatnonzero(depth == d) for d in range(1, int(depth.max()) + 1)]

    def search(self, ids, q, label, same: bool, low, high, kth, k: int):
        """For each window [low, high] the best ``k`` rows of the label, or of the others: [(places, scores)].

        ids: of the rows in ``order``; ties go to the smaller one.  kth: what a row has
        to reach in each window to be among the best found elsewhere.  Also returns how
        many rows were scored.
        """
        import numpy as np

        middle = self.centres @ q.astype(float)
        norm = float(np.sqrt((q.astype(float) ** 2).sum()))
        slack = 1e-9 * norm * (np.sqrt((self.centres**2).sum(axis=1)) + self.radii) + 1e-9  # rounding never hides a row
        above, below = middle + norm * self.radii + slack, middle - norm * self.radii - slack
        fits = (~self.own) | ((self.leaf_label == label) == same)
        kth = [max(a, b) for a, b in zip(map(int, kth), map(int, low))]  # whole numbers, as scores are
        high = [int(x) for x in high]
        found = [(np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in kth]
        done, scored, step = np.zeros(len(self.leaves), bool), 0, 1
        ranks = np.empty(len(self.leaves), dtype=np.int64)
        ranks[np.argsort(-middle[self.leaves], kind="stable")] = np.arange(len(self.leaves))
        while True:
            open_ = np.zeros(len(above), bool)
            for w in range(len(kth)):
                open_ |= (above >= kth[w]) & (below <= high[w])
            for level in self.depth:
                open_[level] &= open_[self.parents[level]]
            left = open_[self.leaves] & fits & ~done
            if not left.any():
                return found, scored
            chosen = np.flatnonzero(left)
            chosen = chosen[np.argsort(ranks[chosen])][:step]
            done[chosen] = True
            step *= 2
            at = np.concatenate([np.arange(self.starts[i], self.ends[i]) for i in chosen])
            at = at[(self.labels[at] == label) == same]
            if not len(at):
                continue
            s = self.vectors[at] @ q
            scored += len(at)
            for w in range(len(kth)):
                hit = (s >= kth[w]) & (s <= high[w])
                if hit.any():
                    places, scores = np.concatenate([found[w][0], at[hit]]), np.concatenate([found[w][1], s[hit]])
                    keep = np.lexsort((ids[places], -scores))[:k]
                    found[w] = places[keep], scores[keep]
                    if len(keep) == k:
                        kth[w] = max(kth[w], int(scores[keep[-1]]))
