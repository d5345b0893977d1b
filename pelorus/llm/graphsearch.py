"""Best-first search of proximity graphs, for many queries at once, in numpy."""

from __future__ import annotations

import numpy as np


def beam_search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, expand: int | None = None, chunk: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nodes with the largest inner products found for each query, best first.

    ``graph``: neighbours of each node, -1 where there are fewer. ``entries``:
    first nodes of each query, -1 to skip. Every step opens the ``expand`` best
    nodes of the beam that are still closed (a share of the beam unless given),
    until all of it is open. Missing
    results are node -1 with score -inf.
    """
    beam = min(beam, len(vectors))
    expand = expand or max(4, beam // 16)
    ids = np.full((len(queries), beam), -1, dtype=np.int64)
    scores = np.full((len(queries), beam), -np.inf, dtype=np.float32)
    for lo in range(0, len(queries), chunk):
        hi = min(lo + chunk, len(queries))
        ids[lo:hi], scores[lo:hi] = _search(vectors, graph, queries[lo:hi], entries[lo:hi], beam, expand)
    return ids, scores


def _search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    n, m = len(vectors), len(queries)
    seen = np.zeros((m, n), dtype=bool)
    ids = np.full((m, beam), -1, dtype=np.int64)
    scores = np.full((m, beam), -np.inf, dtype=np.float32)
    opened = np.ones((m, beam), dtype=bool)
    rows = np.arange(m)
    live, fresh = rows, entries
    while len(live):
        # new candidates of the live queries, each node once
        at = np.repeat(live, fresh.shape[1])
        node = fresh.ravel()
        good = node >= 0
        at, node = at[good], node[good]
        new = ~seen[at, node]
        key = np.unique(at[new] * n + node[new])
        at, node = key // n, key % n
        seen[at, node] = True
        score = np.einsum("ij,ij->i", vectors[node], queries[at])
        # lay them out in a matrix beside the beam and keep the best
        count = np.bincount(at, minlength=m)[live]
        width = int(count.max()) if len(count) else 0
        if width:
            place = np.full(m, -1)
            place[live] = np.arange(len(live))
            col = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
            more_i = np.full((len(live), width), -1, dtype=np.int64)
            more_s = np.full((len(live), width), -np.inf, dtype=np.float32)
            more_i[place[at], col], more_s[place[at], col] = node, score
            all_i = np.concatenate([ids[live], more_i], axis=1)
            all_s = np.concatenate([scores[live], more_s], axis=1)
            all_o = np.concatenate([opened[live], more_i < 0], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] if all_s.shape[1] > beam else np.broadcast_to(np.arange(all_s.shape[1]), all_s.shape)
            order = np.argsort(-np.take_along_axis(all_s, best, axis=1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, axis=1)
            ids[live], scores[live], opened[live] = (np.take_along_axis(x, best, axis=1) for x in (all_i, all_s, all_o))
        # open the best closed nodes
        closed = ~opened[live]
        rank = np.cumsum(closed, axis=1)
        pick = closed & (rank <= expand)
        go = pick.any(axis=1)
        live, pick = live[go], pick[go]
        if not len(live):
            break
        r, c = np.nonzero(pick)
        slot = rank[go][r, c] - 1
        chosen = np.full((len(live), expand), -1, dtype=np.int64)
        chosen[r, slot] = ids[live][r, c]
        mask = opened[live]
        mask[r, c] = True
        opened[live] = mask
        fresh = np.where(chosen[:, :, None] >= 0, graph[chosen], -1).reshape(len(live), -1)
    return ids, scores


def reverse_capped(graph: np.ndarray, cap: int) -> np.ndarray:
    """Up to ``cap`` nodes that point at each node, -1 where there are fewer; early positions first."""
    n, k = graph.shape
    src = np.repeat(np.arange(n), k)
    rank = np.tile(np.arange(k), n)
    dst = graph.ravel()
    good = dst >= 0
    src, rank, dst = src[good], rank[good], dst[good]
    order = np.lexsort((src, rank, dst))
    src, dst = src[order], dst[order]
    first = np.searchsorted(dst, np.arange(n))
    col = np.arange(len(dst)) - first[dst]
    out = np.full((n, cap), -1, dtype=np.int64)
    keep = col < cap
    out[dst[keep], col[keep]] = src[keep]
    return out


class Layers:
    """Hierarchical navigable small-world graph over unit vectors, built in batches.

    Every node has a level drawn from its number; upper layers hold fewer
    nodes. A batch is searched in the graph of the nodes before it, links to
    the best by the diversity rule, and is linked back to.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 64, seed: int = 3):
        self.vectors, self.degree = np.ascontiguousarray(vectors, dtype=np.float32), degree
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(degree)).astype(int), 6)
        if n:
            self.level[0] = self.level.max()
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes, graph over positions in nodes
        for lv in range(int(self.level.max(initial=0)), -1, -1):
            nodes = np.flatnonzero(self.level >= lv)
            self.layers.append((nodes, self._build(nodes, beam, 2 * degree if lv == 0 else degree)))

    def _build(self, nodes: np.ndarray, beam: int, width: int) -> np.ndarray:
        n = len(nodes)
        v = self.vectors[nodes]
        graph = np.full((n, width), -1, dtype=np.int64)
        where = np.full(len(self.vectors), -1)
        where[nodes] = np.arange(n)
        done = 0
        while done < n:
            size = n if n <= 2 * width else min(n - done, max(width, done))
            stop = min(n, done + size)
            block = v[done:stop]
            if done == 0:
                near = block @ block.T
                np.fill_diagonal(near, -np.inf)
                k = min(beam, stop - 1)
                cand = np.argsort(-near, axis=1, kind="stable")[:, :k]
                cs = np.take_along_axis(near, cand, axis=1)
            else:
                enter = self._descend(block, where, done)
                cand, cs = beam_search(v[:done], graph[:done], block, enter, min(beam, done))
            chosen = self._diverse(v, block, cand, cs, self.degree)
            graph[done:stop, : chosen.shape[1]] = chosen
            self._link_back(v, graph, np.arange(done, stop), chosen)
            done = stop
        return graph

    def _descend(self, block: np.ndarray, where: np.ndarray, below: int) -> np.ndarray:
        """Entry nodes among the first ``below``: what the upper layers find, and some spread nodes."""
        spread = np.unique(np.linspace(0, below - 1, min(below, 16)).astype(np.int64))
        enter = np.broadcast_to(spread, (len(block), len(spread)))
        if self.layers:
            found = where[self._upper(block, len(self.layers))]
            enter = np.concatenate([enter, np.where((found >= 0) & (found < below), found, -1)], axis=1)
        return enter

    def _upper(self, queries: np.ndarray, layers: int, beam: int = 8) -> np.ndarray:
        """Nodes that the first ``layers`` layers lead to."""
        enter = None
        for nodes, graph in self.layers[:layers]:
            where = np.full(len(self.vectors), -1)
            where[nodes] = np.arange(len(nodes))
            start = np.zeros((len(queries), 1), dtype=np.int64) if enter is None else where[enter]
            ids, _ = beam_search(self.vectors[nodes], graph, queries, start, beam)
            enter = np.where(ids >= 0, nodes[ids], nodes[0])
        return enter

    @staticmethod
    def _diverse(v: np.ndarray, block: np.ndarray, cand: np.ndarray, scores: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours for each row: near ones that are nearer to the row than to those chosen; then the nearest left."""
        k = min(cand.shape[1], 3 * degree)
        cand, scores = cand[:, :k], scores[:, :k]
        out = np.full((len(block), degree), -1, dtype=np.int64)
        for lo in range(0, len(block), 2048):
            c, s = cand[lo : lo + 2048], scores[lo : lo + 2048]
            near = np.einsum("ikd,ild->ikl", v[c], v[c])
            taken = np.zeros(c.shape, dtype=bool)
            for j in range(k):
                worst = np.where(taken, near[:, j, :], -np.inf).max(axis=1)
                taken[:, j] = (worst < s[:, j]) & (taken.sum(axis=1) < degree) & (c[:, j] >= 0)
            rank = np.argsort(np.where(c < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :degree]
            out[lo : lo + 2048, : rank.shape[1]] = np.take_along_axis(c, rank, axis=1)
        return out

    def _link_back(self, v: np.ndarray, graph: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
        src, dst = np.repeat(new, chosen.shape[1]), chosen.ravel()
        good = dst >= 0
        src, dst = src[good], dst[good]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = graph.shape[1]
        for size in np.unique(count):
            pick = count == size
            own, begin = nodes[pick], first[pick]
            for lo in range(0, len(own), 2048):
                o, b = own[lo : lo + 2048], begin[lo : lo + 2048]
                add = src[b[:, None] + np.arange(size)]
                both = np.concatenate([graph[o], add], axis=1)
                if (graph[o] < 0).sum(axis=1).min() >= size:
                    rank = np.argsort(both < 0, axis=1, kind="stable")[:, :width]
                    graph[o] = np.take_along_axis(both, rank, axis=1)
                else:
                    s = np.where(both >= 0, np.einsum("ikd,id->ik", v[both], v[o]), -np.inf)
                    rank = np.argsort(-s, axis=1, kind="stable")
                    both, s = np.take_along_axis(both, rank, axis=1), np.take_along_axis(s, rank, axis=1)
                    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                    best = self._diverse(v, v[o], both, s, min(width, both.shape[1]))
                    graph[o, : best.shape[1]] = best

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and inner products of the ``beam`` nearest found for each query."""
        queries = np.ascontiguousarray(queries, dtype=np.float32)
        if not len(self.vectors):
            return np.full((len(queries), 0), -1, dtype=np.int64), np.zeros((len(queries), 0), dtype=np.float32)
        nodes, graph = self.layers[-1]
        return beam_search(self.vectors[nodes], graph, queries, self._upper(queries, len(self.layers) - 1) if len(self.layers) > 1 else np.zeros((len(queries), 1), dtype=np.int64), beam)


def valid_vector(column: str):
    """Condition: the vector is there, not empty, not zero, and all its components are finite numbers."""
    from pyspark.sql import functions as F

    v = F.col(column)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))
