"""A hierarchical navigable small-world graph over unit vectors, in numpy.

Candidates that tie are any way round; links found through either are verified by cosine. Points and queries go through it a block at a time: each step expands the best open candidates of every query of the block at once.
"""

from __future__ import annotations

import numpy as np

#: Links of a point above the lowest layer (twice as many in it), candidates of a point while building, points inserted together, rows at a time, candidates expanded at a time.
LINKS, BUILD_BEAM, TOGETHER, SLICE, EXPAND = 12, 40, 8192, 128, 4


def _levels(ids: np.ndarray) -> np.ndarray:
    """Geometric levels from a hash of the id, the same each time."""
    x = ids.astype("u8") * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    u = ((x >> np.uint64(11)).astype("f8") + 1) / 2**53
    return np.minimum((-np.log(u) / np.log(LINKS)).astype("i8"), 6)


def _diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) those nearer to the point than to one already kept; then the best of the rest. Their places, -1: none."""
    n, w = cand.shape
    vec = x[np.maximum(cand, 0)]
    between = np.matmul(vec, vec.transpose(0, 2, 1))
    ok, worst, kept = np.zeros((n, w), bool), np.full((n, w), -2.0, "f4"), np.zeros(n, "i8")
    for k in range(w):
        good = (cand[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (kept < keep)
        ok[:, k] = good
        kept += good
        np.maximum(worst, np.where(good[:, None], between[:, k], np.float32(-2.0)), out=worst)
    rank = np.where(ok, 0, np.where(cand >= 0, 1, 2)) * w + np.arange(w)
    order = np.argsort(rank, axis=1)[:, :keep]
    out = np.where(np.take_along_axis(cand, order, 1) >= 0, order, -1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _best(sims: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's ``keep`` largest, in any order; which of equal ones is left open."""
    if sims.shape[1] <= keep:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape), sims
    least = np.partition(sims, sims.shape[1] - keep, axis=1)[:, sims.shape[1] - keep]
    row, col = np.nonzero(sims >= least[:, None])
    # Larger ones first, so that ties with the least are what is left out.
    order = np.lexsort((sims[row, col] == least[row], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(sims)))[row]
    col = col[place < keep].reshape(len(sims), keep)
    return col, np.take_along_axis(sims, col, 1)


class Layer:
    """Neighbours by position; only the layer's own points have any."""

    def __init__(self, n: int, links: int) -> None:
        self.links = links
        self.near = np.full((n, links), -1, "i4")

    def search(self, x: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, floor: float = -np.inf, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best found from ``entry`` (rows of positions, -1: none): positions and cosines, best first.

        Points with a cosine under ``floor`` are found but not expanded, nor are those of ``start``, whose neighbours are in ``entry``.
        """
        b = len(q)
        seen = np.zeros((b, len(x) + 1), bool)  # the last column stands for none
        seen[:, -1] = True
        ids, sims, done = np.full((b, beam), -1, "i4"), np.full((b, beam), -np.inf, "f4"), np.ones((b, beam), bool)
        rows, new = np.arange(b), entry
        expand = max(EXPAND, beam // 32)
        while len(rows):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[rows[:, None], new], -1, new)
            seen[rows[:, None], new] = True
            new = new[:, (new >= 0).any(axis=0)]
            s = np.matmul(x[np.maximum(new, 0)], q[rows][:, :, None])[:, :, 0]
            s[new < 0] = -np.inf
            all_ids, all_sims = np.concatenate([ids[rows], new], axis=1), np.concatenate([sims[rows], s], axis=1)
            shut = (new < 0) | (s < floor)
            if start is not None:
                shut |= new == start[rows][:, None]
            all_done = np.concatenate([done[rows], shut], axis=1)
            top = np.argsort(-all_sims, axis=1)[:, :beam]
            ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
            rows = rows[~done[rows].all(axis=1)]
            if len(rows):
                first = np.argsort(done[rows], axis=1, kind="stable")[:, :expand]
                to = np.where(np.take_along_axis(done[rows], first, 1), -1, np.take_along_axis(ids[rows], first, 1))
                done[rows[:, None], first] = True
                new = np.where(to[:, :, None] >= 0, self.near[np.maximum(to, 0)], -1).reshape(len(rows), -1)
        return ids, sims

    def insert(self, x: np.ndarray, points: np.ndarray) -> None:
        """Link ``points`` to what is there and to each other, in blocks, each three times what is there; a point's candidates are the nearest of all before it."""
        self.sims = np.full(self.near.shape, -np.inf, "f4")
        at, size = 0, 1
        while at < len(points):
            block = points[at : at + size]
            for k in range(0, len(block), SLICE):
                part = block[k : k + SLICE]
                before = points[: at + k + len(part)]
                sims = x[part] @ x[before].T
                here = np.arange(len(part))
                sims[:, at + k :][here[:, None] <= here] = -np.inf  # those before it only
                top, sims = _best(sims, BUILD_BEAM)
                order = np.argsort(-sims, axis=1)
                top, sims = np.take_along_axis(top, order, 1), np.take_along_axis(sims, order, 1)
                self._put(x, part, np.where(np.isfinite(sims), before[top], -1), sims)
            self._back(x, block)
            at += len(block)
            size = min(TOGETHER, 3 * at)
        del self.sims

    def _put(self, x: np.ndarray, of: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        """Set the links of points from candidates, best first."""
        place = _diverse(x, cand, sims, self.links)
        none = place < 0
        self.near[of] = np.where(none, -1, np.take_along_axis(cand, np.maximum(place, 0), 1))
        self.sims[of] = np.where(none, -np.inf, np.take_along_axis(sims, np.maximum(place, 0), 1))

    def _back(self, x: np.ndarray, block: np.ndarray) -> None:
        """Links of a block's points the other way round; of a node's new ones the best ``BUILD_BEAM`` stand beside those that it has."""
        to, new, s = self.near[block].ravel(), np.repeat(block, self.links), self.sims[block].ravel()
        to, new, s = to[to >= 0], new[to >= 0], s[to >= 0]
        if not len(to):
            return
        order = np.lexsort((-s, to))
        to, new, s = to[order], new[order], s[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        row, some = np.repeat(np.arange(len(nodes)), count), place < BUILD_BEAM
        width = min(int(count.max()), BUILD_BEAM)
        extra, extra_s = np.full((len(nodes), width), -1, "i4"), np.full((len(nodes), width), -np.inf, "f4")
        extra[row[some], place[some]], extra_s[row[some], place[some]] = new[some], s[some]
        for k in range(0, len(nodes), SLICE):
            n = nodes[k : k + SLICE]
            cand = np.concatenate([self.near[n], extra[k : k + SLICE]], axis=1)
            sims = np.concatenate([self.sims[n], extra_s[k : k + SLICE]], axis=1)
            top = np.argsort(-sims, axis=1)[:, : max(BUILD_BEAM, self.links)]
            fits = (cand >= 0).sum(axis=1) <= self.links
            cand, sims = np.take_along_axis(cand, top, 1), np.take_along_axis(sims, top, 1)
            wide = min(self.links, cand.shape[1])
            self.near[n[fits], :wide], self.sims[n[fits], :wide] = cand[fits][:, :wide], sims[fits][:, :wide]
            if not fits.all():
                self._put(x, n[~fits], cand[~fits], sims[~fits])


class Graph:
    """All vectors of a shard; ``ids`` only decide on the levels."""

    def __init__(self, x: np.ndarray, ids: np.ndarray) -> None:
        self.x = x
        levels = _levels(ids)
        self.layers: list[Layer] = []  # highest first
        self.top = np.flatnonzero(levels == levels.max())[:1]
        for level in range(int(levels.max()), -1, -1):
            points = np.flatnonzero(levels >= level)
            points = np.concatenate([self.top, points[points != self.top[0]]])
            layer = Layer(len(x), LINKS if level else 2 * LINKS)
            layer.insert(x, points)
            self.layers.append(layer)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.broadcast_to(self.top, (len(q), 1)).astype("i4")
        for layer in self.layers[:-1]:
            entry = layer.search(self.x, q, entry, 4)[0]
        return self.layers[-1].search(self.x, q, entry, min(beam, len(self.x)))

    def around(self, points: np.ndarray, beam: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Like ``search`` for vectors of the graph itself: each starts at its own node, and nodes with a cosine under ``floor`` lead no further.

        A candidate that wasn't linked is nearer to a link than to the point, so what is nearer than ``floor`` is reached over nodes that are.
        """
        lowest = self.layers[-1]
        entry = np.concatenate([points[:, None].astype("i4"), lowest.near[points]], axis=1)
        return lowest.search(self.x, self.x[points], entry, min(beam, len(self.x)), floor, points)
