"""One M-tree over a bounded set of vectors, and its best-first search.

A vector x is lifted by the coordinate sqrt(M - |x|^2) (M: the largest squared norm of all vectors), a query by 0. So the
order of inner products is that of Euclidean distances, which are a metric: d(q, x)^2 = |q|^2 + M - 2 q.x.
Every node has a routing object (one of the vectors), the radius that covers all vectors below it, and its distance to the
routing object of its parent; a leaf has its entries' distances to its routing object. A node is split by size until its
entries fit a page.
"""

from __future__ import annotations

import heapq

import numpy as np


class Tree:
    def __init__(self, vectors: np.ndarray, top: float, page_rows: int = 64, fanout: int = 16, wide: bool = False):
        """vectors: n x dim, as floats where all inner products are exact below 2^53, else as 64-bit integers; top: M.
        wide: products with queries may be no 64-bit numbers, so Python's are used."""
        self.top, self.wide = top, wide
        lift = np.sqrt(np.maximum(0.0, top - (vectors.astype(np.float64) ** 2).sum(1)))
        # Breadth first, so that a node's children are consecutive: routing object, parent distance, radius, range, leaf.
        self.pivot, self.parent, self.radius, self.lo, self.hi, self.leaf = [0], [0.0], [0.0], [0], [0], [False]
        order, away, todo, at = [], [], [np.arange(len(vectors))], 0
        while at < len(todo):
            members, pivot = todo[at], self.pivot[at]
            d = self._apart(vectors, lift, members, np.array([pivot]))[:, 0]
            self.radius[at] = float(d.max())
            if len(members) <= page_rows:
                self.lo[at], self.leaf[at] = sum(map(len, order)), True
                order.append(members)
                away.append(d)
                self.hi[at] = self.lo[at] + len(members)
            else:
                self.lo[at] = len(todo)
                for part, chosen in self._split(vectors, lift, members, d, min(fanout, -(-len(members) // page_rows))):
                    todo.append(part)
                    self.pivot.append(chosen)
                    self.parent.append(float(self._apart(vectors, lift, np.array([chosen]), np.array([pivot]))[0, 0]))
                    for a in (self.radius, self.lo, self.hi):
                        a.append(0)
                    self.leaf.append(False)
                self.hi[at] = len(todo)
            at += 1
        self.order = np.concatenate(order)
        self.away = np.concatenate(away)
        self.vectors = vectors[self.order]
        self.pivots = vectors[np.array(self.pivot)]
        self.parent, self.radius, self.leaf = np.array(self.parent), np.array(self.radius), np.array(self.leaf)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _apart(self, vectors: np.ndarray, lift: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances between lifted vectors."""
        dots = vectors[a].astype(np.float64) @ vectors[b].T.astype(np.float64)  # bounds allow for their rounding
        return np.sqrt(np.maximum(0.0, 2 * (self.top - dots - lift[a][:, None] * lift[b])))

    def _split(self, vectors: np.ndarray, lift: np.ndarray, members: np.ndarray, d: np.ndarray, parts: int) -> list[tuple[np.ndarray, int]]:
        """Members by the nearest of `parts` routing objects at even steps of d; where most fall to one, runs of equal size by d."""
        ranked = members[np.argsort(d, kind="stable")]
        chosen = ranked[((np.arange(parts) + 0.5) * len(ranked) / parts).astype(int)]
        near = self._apart(vectors, lift, members, chosen).argmin(1)
        sets = [members[near == k] for k in range(parts)]
        if max(map(len, sets)) > 0.75 * len(members):
            sets = np.array_split(ranked, parts)
            chosen = [int(s[len(s) // 2]) for s in sets]
        return [(s, int(c)) for s, c in zip(sets, chosen, strict=True) if len(s)]

    def search(self, q: np.ndarray, k: int, ids: list[list[int]], own: int | None = None, least: float = -np.inf) -> list[tuple[int, int]]:
        """The k best (score, id), ties to smaller ids, of scores that are at least `least`; own: an id that doesn't count.

        ids: the ids of each vector in the order of the constructor. `visited` and `products` count pages and inner products.
        """
        norm = float((q.astype(np.float64) ** 2).sum())
        slack = 1e-6 * (np.sqrt(norm + self.top) + 1)  # of distances made from squares that nearly cancel

        def reach(score: float) -> float:
            return np.inf if score == -np.inf else float(np.sqrt(max(0.0, norm + self.top - 2.0 * score))) + slack

        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        bound = reach(least)
        self.visited, self.products = 0, 1
        far = q.astype(np.float64)
        d = reach(float(far @ self.pivots[0].astype(np.float64))) - slack
        queue = [(max(0.0, d - self.radius[0]), 0, d)]
        while queue:
            low, node, d = heapq.heappop(queue)
            if low > bound:
                break
            self.visited += 1
            some = slice(self.lo[node], self.hi[node])
            if self.leaf[node]:
                # |d(q, p) - d(x, p)| <= d(q, x): entries that this rules out get no product.
                inside = self.lo[node] + np.flatnonzero(np.abs(d - self.away[some]) <= bound)
                scores = self.vectors[inside].astype(object) @ q.astype(object) if self.wide else self.vectors[inside] @ q
                self.products += len(inside)
                good = np.flatnonzero(scores >= least)
                for i in good[np.argsort(-scores[good], kind="stable")]:
                    score = int(scores[i])
                    if score < least:
                        break
                    for x in ids[self.order[inside[i]]]:
                        if x != own:
                            if len(best) < k:
                                heapq.heappush(best, (score, -x))
                            elif (score, -x) > best[0]:
                                heapq.heapreplace(best, (score, -x))
                    if len(best) == k and best[0][0] > least:
                        least = best[0][0]
                        bound = reach(least)
            else:
                children = self.lo[node] + np.flatnonzero(np.abs(d - self.parent[some]) - self.radius[some] <= bound)
                dots = self.pivots[children].astype(np.float64) @ far
                self.products += len(children)
                away = np.sqrt(np.maximum(0.0, norm + self.top - 2.0 * dots))
                for c, a in zip(children.tolist(), away.tolist(), strict=True):
                    low = max(0.0, a - self.radius[c])
                    if low <= bound:
                        heapq.heappush(queue, (low, c, a))
        return sorted(((s, -x) for s, x in best), key=lambda p: (-p[0], p[1]))
