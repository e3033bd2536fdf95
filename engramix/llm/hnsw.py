"""Hierarchical navigable small-world graph over one shard, in flat neighbour arrays.

All steps work on whole batches of nodes or queries with numpy. While a shard is built, the
candidates of each node are found by blocked matrix products over the shard's earlier nodes,
which for shards of some thousand vectors costs less than a search of the unfinished graph; links are
chosen by the diversity rule. Queries enter at the nearest nodes of a small upper layer and walk the graph from there.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np

#: Links of a node on the upper layers and on the lowest one, candidates while building, and the share that rises a layer.
LINKS, LINKS0, BUILD, RISE = 16, 32, 64, 16
#: Nodes up to which an upper layer is compared whole instead of walked, and entries into the layer below.
SMALL, ENTRIES = 1024, 3


@dataclass
class Graph:
    """``layers[l]`` is (node ids, links): links[i] are the neighbours of node ids[i], -1 where there are fewer."""

    vectors: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def dumps(self) -> bytes:
        """Vectors in two bytes a number, node numbers in as few bytes as they need."""
        small = np.int16 if len(self.vectors) < 1 << 15 else np.int32
        return pickle.dumps((self.vectors.astype(np.float16), [(ids.astype(small), links.astype(small)) for ids, links in self.layers]), protocol=5)

    @classmethod
    def loads(cls, data: bytes) -> "Graph":
        """The graph again; its vectors have length one, as before they were rounded."""
        vectors, layers = pickle.loads(data)
        vectors = vectors.astype(np.float32)
        return cls(vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), [(ids.astype(np.int32), links.astype(np.int32)) for ids, links in layers])


def _choose(own: np.ndarray, sims: np.ndarray, vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of candidates ``ids`` (rows sorted by falling ``sims``, -1 for none) those nearer to the node than to any chosen before."""
    b, c = ids.shape
    there = ids >= 0
    v = vectors[np.where(there, ids, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    kept = np.zeros((b, c), dtype=bool)
    n = np.zeros(b, dtype=np.int64)
    nearest = np.full((b, c), -np.inf, dtype=np.float32)
    for j in range(c):
        ok = there[:, j] & (n < most) & (sims[:, j] > nearest[:, j])
        kept[:, j] = ok
        n += ok
        rows = np.flatnonzero(ok)
        nearest[rows] = np.maximum(nearest[rows], between[rows, j])
    # Where the rule leaves places free, the nearest of the others fill them.
    rank = np.where(kept, 0, np.where(there, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.where(np.take_along_axis(there, order, 1), out, -1)


def _layer(vectors: np.ndarray, most: int, block: int = 512) -> np.ndarray:
    """Links of all nodes of a layer (in the order of insertion): each to earlier nodes, and back."""
    n = len(vectors)
    links = np.full((n, most), -1, dtype=np.int32)
    if n < 2:
        return links
    sources, targets, sims_of = [], [], []
    for a in range(0, n, block):
        b = min(n, a + block)
        sims = vectors[a:b] @ vectors[:b].T
        sims[np.arange(b - a)[:, None] + a <= np.arange(b)[None, :]] = -np.inf
        c = min(BUILD, b - 1)
        ids = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        s = np.take_along_axis(sims, ids, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
        ids = np.where(np.isfinite(s), ids, -1)
        chosen = _choose(vectors[a:b], s, vectors, ids, most)
        links[a:b, : chosen.shape[1]] = chosen
        rows, cols = np.nonzero(chosen >= 0)
        sources.append(rows + a)
        targets.append(chosen[rows, cols])
    # Back links: each node chooses again among its own links and those that came to it.
    src, dst = np.concatenate(sources), np.concatenate(targets)
    both_from, both_to = np.concatenate([dst, src]), np.concatenate([src, dst])
    sim = np.einsum("ij,ij->i", vectors[both_from], vectors[both_to])
    order = np.lexsort((-sim, both_from))
    f, t, s = both_from[order], both_to[order], sim[order]
    start = np.searchsorted(f, np.arange(n + 1))
    place = np.arange(len(f)) - start[f]
    width = min(int(place.max()) + 1, 2 * most)
    ok = place < width
    ids = np.full((n, width), -1, dtype=np.int64)
    sims = np.full((n, width), -np.inf, dtype=np.float32)
    ids[f[ok], place[ok]], sims[f[ok], place[ok]] = t[ok], s[ok]
    for a in range(0, n, block):
        chosen = _choose(vectors[a : a + block], sims[a : a + block], vectors, ids[a : a + block], most)
        links[a : a + block] = -1
        links[a : a + block, : chosen.shape[1]] = chosen
    return links


def build(vectors: np.ndarray, seed: int = 7) -> Graph:
    """Graph over unit vectors (rows); each node rises a layer with probability 1 / RISE."""
    rng = np.random.default_rng(seed)
    n = len(vectors)
    level = np.minimum((-np.log(rng.random(n)) / np.log(RISE)).astype(int), 4)
    order = np.argsort(-level, kind="stable")
    layers = []
    for l in range(int(level.max()) + 1 if n else 0):
        ids = order[level[order] >= l]
        local = _layer(vectors[ids], LINKS0 if l == 0 else LINKS)
        layers.append((ids.astype(np.int32), np.where(local >= 0, ids[local], -1).astype(np.int32)))
    flat = []
    for l, (ids, links) in enumerate(layers):
        at = np.argsort(ids)
        flat.append((ids[at], links[at]))
    return Graph(vectors, flat)


def _walk(vectors: np.ndarray, ids: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, breadth: int, at_once: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of one layer for many queries: (ids, sims) of the ``breadth`` best found, best first."""
    b, n = len(queries), len(vectors)
    row = np.full(n, -1, dtype=np.int64)
    row[ids] = np.arange(len(ids))
    seen = np.zeros((b, n + 1), dtype=bool)
    best = np.full((b, breadth), -1, dtype=np.int64)
    sims = np.full((b, breadth), -np.inf, dtype=np.float32)
    open_ = np.zeros((b, breadth), dtype=bool)
    e = entry.shape[1]
    ent = np.where(entry >= 0, entry, n)
    first = np.einsum("bd,bmd->bm", queries, vectors[np.minimum(ent, n - 1)])
    first[ent == n] = -np.inf
    best[:, :e], sims[:, :e], open_[:, :e] = ent[:, :breadth], first[:, :breadth], ent[:, :breadth] < n
    seen[np.arange(b)[:, None], ent] = True
    live = np.arange(b)
    while len(live):
        s = np.where(open_[live], sims[live], -np.inf)
        pick = np.argpartition(-s, min(at_once, breadth) - 1, axis=1)[:, :at_once]
        chosen = np.take_along_axis(s, pick, 1) > -np.inf
        going = chosen.any(1)
        if not going.all():
            live, pick, chosen = live[going], pick[going], chosen[going]
            if not len(live):
                break
        open_[live[:, None], pick] = False
        nodes = best[live[:, None], pick]
        near = links[row[np.where(chosen, nodes, ids[0])]]
        near = np.where(chosen[:, :, None], near, -1).reshape(len(live), -1).astype(np.int64)
        near[near < 0] = n
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        fresh = ~seen[live[:, None], near] & (near < n)
        seen[live[:, None], near] = True
        r, c = np.nonzero(fresh)
        found = np.full(near.shape, -np.inf, dtype=np.float32)
        found[r, c] = np.einsum("ij,ij->i", queries[live[r]], vectors[near[r, c]])
        all_sims = np.concatenate([sims[live], found], axis=1)
        top = np.argpartition(-all_sims, breadth - 1, axis=1)[:, :breadth]
        sims[live] = np.take_along_axis(all_sims, top, 1)
        best[live] = np.take_along_axis(np.concatenate([best[live], near], axis=1), top, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    best, sims = np.take_along_axis(best, order, 1), np.take_along_axis(sims, order, 1)
    return np.where(np.isfinite(sims), best, -1), sims


def _top(graph: Graph, queries: np.ndarray) -> tuple[np.ndarray, int]:
    """(entries, number of its layer): the nearest nodes of the lowest layer with at most SMALL nodes, which is compared whole."""
    layer = next((l for l, (ids, _) in enumerate(graph.layers) if l and len(ids) <= SMALL), len(graph.layers) - 1)
    ids = graph.layers[layer][0]
    sims = queries @ graph.vectors[ids].T
    m = min(ENTRIES, len(ids))
    return ids[np.argpartition(-sims, m - 1, axis=1)[:, :m]].astype(np.int64), layer


def search(graph: Graph, queries: np.ndarray, k: int, breadth: int, own: np.ndarray | None = None, batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sims) of the ``k`` nearest nodes of each query, -1 where there are fewer.

    ``own`` names the node of a query that is itself in the graph (-1 for the others): its walk of the
    lowest layer begins there.
    """
    n = len(graph.vectors)
    out_ids = np.full((len(queries), k), -1, dtype=np.int64)
    out_sims = np.full((len(queries), k), -np.inf, dtype=np.float32)
    if not n:
        return out_ids, out_sims
    breadth = max(breadth, k)
    for a in range(0, len(queries), batch):
        q = queries[a : a + batch]
        entry = np.full((len(q), 1), -1, dtype=np.int64)
        mine = own[a : a + batch] if own is not None else np.full(len(q), -1)
        far = np.flatnonzero(mine < 0)
        if len(far):
            at, walked = _top(graph, q[far])
            for ids, links in graph.layers[walked - 1 : 0 : -1]:
                at = _walk(graph.vectors, ids, links, q[far], at, 4)[0][:, :2]
            wide = np.full((len(q), at.shape[1]), -1, dtype=np.int64)
            wide[far] = at
            entry = wide
        near = mine >= 0
        entry[near] = -1
        entry[near, 0] = mine[near]
        ids, sims = _walk(graph.vectors, *graph.layers[0], q, entry, breadth)
        out_ids[a : a + batch, :], out_sims[a : a + batch, :] = ids[:, :k], sims[:, :k]
    return out_ids, out_sims
