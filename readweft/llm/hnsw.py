"""A hierarchical navigable small-world graph over unit vectors, kept as flat neighbour arrays.

Many queries walk the graph in step: each step expands the nearest unexpanded node of every query and is a few array
operations, so that Python's cost is shared by the whole block. Inserts work the same way, block by block: a block is
searched in the graph so far, and its rows are also compared with each other.
"""

from __future__ import annotations

import math

import numpy as np

M, M0 = 16, 32
EF_BUILD, EF_SEARCH = 64, 96
BLOCK = 256


class Graph:
    """levels[l]: (nodes, neighbours): the sorted rows on level l, and for each its neighbours (-1: none)."""

    def __init__(self, vectors: np.ndarray, seed: int = 11):
        """vectors: float32 rows of length 1."""
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / math.log(M)).astype(np.int64), 8)
        if n:
            level[0] = max(int(level.max()), 0)  # the first row is the entry on every level
        self.top = int(level.max()) if n else 0
        self.links = [np.full((n, M0), -1, np.int32)] + [np.full((n, M), -1, np.int32) for _ in range(self.top)]
        self.level = level
        start = 1
        while start < n:
            stop = min(n, start + min(BLOCK, max(8, start // 2)))
            self._insert(np.arange(start, stop))
            start = stop

    def flat(self) -> list[np.ndarray]:
        """The neighbour arrays, level by level."""
        return self.links

    @classmethod
    def of(cls, vectors: np.ndarray, links: list[np.ndarray]) -> Graph:
        g = cls.__new__(cls)
        g.x, g.links, g.top = np.ascontiguousarray(vectors, np.float32), links, len(links) - 1
        return g

    def _insert(self, rows: np.ndarray) -> None:
        q = self.x[rows]
        among = q @ q.T
        np.fill_diagonal(among, -2)
        entry = np.zeros((len(rows), 1), np.int64)
        for l in range(self.top, -1, -1):
            on = self.level[rows] >= l
            if not on.any():
                entry = self._search(q, entry, l, 1)[0]
                continue
            near, score = self._search(q, entry, l, EF_BUILD)
            entry = near[:, :1]
            # the block's own rows on this level are candidates too
            mates = np.where(on[None, :], among, -2)
            k = min(M, len(rows))
            own = np.argpartition(-mates, k - 1, axis=1)[:, :k]
            ids = np.concatenate([near, rows[own]], 1)
            score = np.concatenate([score, np.take_along_axis(mates, own, 1)], 1)
            ids = np.where(score > -2, ids, -1)
            self._connect(rows[on], ids[on], score[on], l)

    def _connect(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray, l: int) -> None:
        links, width = self.links[l], self.links[l].shape[1]
        chosen = self._spread(ids, score, M)
        links[rows, :M] = chosen
        src, dst = np.repeat(rows, M), chosen.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, at, count = np.unique(dst, return_index=True, return_counts=True)
        wide = int(count.max()) if len(count) else 0
        if not wide:
            return
        new = np.full((len(targets), wide), -1, np.int64)
        place = np.arange(len(dst)) - np.repeat(at, count)
        new[np.repeat(np.arange(len(targets)), count), place] = src
        both = np.concatenate([links[targets].astype(np.int64), new], 1)
        sim = np.einsum("ijk,ik->ij", self.x[np.maximum(both, 0)], self.x[targets])
        sim[both < 0] = -2
        links[targets] = self._spread(both, sim, width)

    def _spread(self, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        """k of the candidates: near ones first, without those nearer to a chosen one than to the row; then the rest."""
        if len(ids) > 2 * BLOCK:  # the similarities among candidates take candidates ** 2 numbers a row
            return np.concatenate([self._spread(ids[a : a + 2 * BLOCK], score[a : a + 2 * BLOCK], k) for a in range(0, len(ids), 2 * BLOCK)])
        order = np.argsort(-score, axis=1, kind="stable")[:, : 3 * k]
        ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
        v = self.x[np.maximum(ids, 0)]
        sim = v @ v.transpose(0, 2, 1)
        good = score > -2
        chosen = np.zeros(ids.shape, bool)
        for c in range(ids.shape[1]):
            same = (chosen[:, :c] & (ids[:, :c] == ids[:, c : c + 1])).any(1)
            hidden = (chosen[:, :c] & (sim[:, c, :c] > score[:, c : c + 1])).any(1)
            chosen[:, c] = good[:, c] & ~same & ~hidden & (chosen[:, :c].sum(1) < k)
        rest = good & ~chosen
        for c in range(1, ids.shape[1]):
            rest[:, c] &= ~(ids[:, :c] == ids[:, c : c + 1]).any(1)
        rank = np.where(chosen, 0, np.where(rest, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        take = np.argsort(rank, axis=1)[:, :k]
        out = np.where(np.take_along_axis(chosen | rest, take, 1), np.take_along_axis(ids, take, 1), -1)
        return np.pad(out, ((0, 0), (0, k - out.shape[1])), constant_values=-1) if out.shape[1] < k else out

    def _search(self, q: np.ndarray, entry: np.ndarray, l: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, similarities) of the ef nearest found, nearest first; -1 and -2 where there are fewer."""
        links, n_q = self.links[l], len(q)
        seen = np.zeros((n_q, len(self.x)), bool)
        each = np.arange(n_q)[:, None]
        ids = np.full((n_q, ef), -1, np.int64)
        score = np.full((n_q, ef), -2.0, np.float32)
        open_ = np.zeros((n_q, ef), bool)
        w = min(ef, entry.shape[1])
        ids[:, :w] = entry[:, :w]
        score[:, :w] = np.where(ids[:, :w] >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(ids[:, :w], 0)], q), -2)
        open_[:, :w] = ids[:, :w] >= 0
        seen[each, np.maximum(ids[:, :w], 0)] |= ids[:, :w] >= 0
        live = np.arange(n_q)
        while len(live):
            best = np.argmax(np.where(open_[live], score[live], -3), axis=1)
            go = open_[live, best]
            live, best = live[go], best[go]
            if not len(live):
                break
            open_[live, best] = False
            new = links[ids[live, best]].astype(np.int64)
            fresh = (new >= 0) & ~seen[live[:, None], new]
            seen[np.repeat(live, fresh.sum(1)), new[fresh]] = True
            at = np.nonzero(fresh)
            sim = np.full(new.shape, -2.0, np.float32)
            sim[at] = np.einsum("ij,ij->i", self.x[new[at]], q[live[at[0]]])
            fresh &= sim > score[live, -1:]
            some = fresh.any(1)
            if not some.any():
                continue
            r = live[some]
            all_ids = np.concatenate([ids[r], np.where(fresh[some], new[some], -1)], 1)
            all_score = np.concatenate([score[r], np.where(fresh[some], sim[some], -2)], 1)
            all_open = np.concatenate([open_[r], fresh[some]], 1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :ef]
            ids[r], score[r], open_[r] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_score, all_open))
        return ids, score

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """The rows of the k nearest found of each query (unit float32 rows), -1 where there are fewer."""
        out = np.full((len(q), k), -1, np.int64)
        if not len(self.x):
            return out
        for a in range(0, len(q), BLOCK):
            part = np.ascontiguousarray(q[a : a + BLOCK], np.float32)
            entry = np.zeros((len(part), 1), np.int64)
            for l in range(self.top, 0, -1):
                entry = self._search(part, entry, l, 1)[0]
            found = self._search(part, entry, 0, max(ef, k))[0][:, :k]
            out[a : a + BLOCK, : found.shape[1]] = found
        return out
