"""A robust-pruned flat proximity graph over unit vectors, built and searched in numpy for many queries at once."""

from __future__ import annotations

import numpy as np

DEGREE = 20  # neighbours kept by pruning
WIDTH = 32  # neighbours a node may gather before it is pruned again
BEAM = 40
ALPHA = 1.2
BATCH = 256
PASSES = 2


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(0)).argmax())


def beam_search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, start: int, beam: int = BEAM):
    """The best `beam` nodes on the greedy path of each query from `start`: ids (-1: none) and similarities."""
    count = len(queries)
    seen = np.zeros((count, len(vectors)), bool)
    seen[:, start] = True
    ids = np.full((count, beam), -1, np.int32)
    near = np.full((count, beam), -np.inf, np.float32)
    open_ = np.zeros((count, beam), bool)
    ids[:, 0], near[:, 0], open_[:, 0] = start, queries @ vectors[start], True
    alive = np.arange(count)
    while True:
        alive = alive[open_[alive].any(1)]
        if not len(alive):
            return ids, near
        at = open_[alive].argmax(1)  # lists are sorted: the nearest open node
        open_[alive, at] = False
        found = neighbours[ids[alive, at]]
        fresh = (found >= 0) & ~seen[alive[:, None], found]
        seen[alive[:, None], np.where(found >= 0, found, start)] = True
        likeness = np.einsum("qrd,qd->qr", vectors[found], queries[alive])
        all_near = np.concatenate([near[alive], np.where(fresh, likeness, -np.inf)], 1)
        order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[alive] = np.take_along_axis(all_near, order, 1)
        ids[alive] = np.take_along_axis(np.concatenate([ids[alive], np.where(fresh, found, -1)], 1), order, 1)
        open_[alive] = np.take_along_axis(np.concatenate([open_[alive], fresh], 1), order, 1)


def robust_prune(vectors: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Of each node's pool (-1: none) up to `degree` neighbours: the nearest one left is taken, and those nearer to it
    than to the node, by the factor alpha, are let go."""
    pool = np.where(pool == nodes[:, None], -1, pool)
    pool = np.sort(pool, 1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    members = vectors[pool]
    to_node = np.where(pool >= 0, 1 - np.einsum("mcd,md->mc", members, vectors[nodes]), np.inf)
    order = np.argsort(to_node, 1, kind="stable")
    pool, to_node = np.take_along_axis(pool, order, 1), np.take_along_axis(to_node, order, 1)
    members = vectors[pool]
    apart = 1 - members @ members.transpose(0, 2, 1)
    alive = pool >= 0
    out = np.full((len(nodes), WIDTH), -1, np.int32)
    rows = np.arange(len(nodes))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        best = alive.argmax(1)
        out[some, k] = pool[rows, best][some]
        alive &= ~(ALPHA * apart[rows, best] <= to_node)
        alive[rows, best] = False
    return out


def build(vectors: np.ndarray, seed: int = 3) -> np.ndarray:
    """Neighbour lists (n, WIDTH) of a graph over `vectors`: from random lists, every node is searched for and pruned."""
    count = len(vectors)
    random = np.random.default_rng(seed)
    neighbours = np.full((count, WIDTH), -1, np.int32)
    first = min(8, count - 1)
    if first:
        neighbours[:, :first] = (np.arange(count)[:, None] + random.integers(1, count, (count, first))) % count
    start = medoid(vectors)
    batches = max(1, -(-count // BATCH))
    # the first pass searches a graph that is still half random, so every node has a second turn
    for nodes in [part for _ in range(PASSES) for part in np.array_split(random.permutation(count), batches)]:
        reached, _ = beam_search(vectors, neighbours, vectors[nodes], start)
        neighbours[nodes] = robust_prune(vectors, nodes, np.concatenate([reached, neighbours[nodes]], 1))
        _link_back(vectors, neighbours, nodes)
    return neighbours


def _link_back(vectors: np.ndarray, neighbours: np.ndarray, nodes: np.ndarray) -> None:
    """Every node that a batch points to points back; full lists are pruned with what is new."""
    source = np.repeat(nodes, WIDTH)
    target = neighbours[nodes].ravel()
    source, target = source[target >= 0], target[target >= 0]
    known = (neighbours[target] == source[:, None]).any(1)
    source, target = source[~known], target[~known]
    if not len(target):
        return
    order = np.lexsort([-np.einsum("nd,nd->n", vectors[source], vectors[target]), target])
    source, target = source[order], target[order]
    which, begin, counts = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(begin, counts)
    kept = place < WIDTH  # the nearest of them
    added = np.full((len(which), WIDTH), -1, np.int32)
    added[np.repeat(np.arange(len(which)), counts)[kept], place[kept]] = source[kept]
    held = (neighbours[which] >= 0).sum(1)
    fits = held + np.minimum(counts, WIDTH) <= WIDTH
    merged = np.concatenate([neighbours[which], added], 1)
    compact = np.take_along_axis(merged, np.argsort(merged < 0, 1, kind="stable"), 1)
    neighbours[which[fits]] = compact[fits, :WIDTH]
    full = which[~fits]
    if len(full):
        neighbours[full] = robust_prune(vectors, full, merged[~fits])


def both_ways(neighbours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All edges (source, target) of the lists and of their reverse, sorted by source."""
    source, slot = np.nonzero(neighbours >= 0)
    target = neighbours[source, slot].astype(np.int64)
    count = len(neighbours)
    keys = np.unique(np.concatenate([source * count + target, target * count + source]))
    return np.divmod(keys, count)


def range_search(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, own: np.ndarray, least: float, block: int = 512):
    """Pairs (query, node) of similarity at least `least` that the graph reaches: greedy search from the medoid, then
    from everything in range along edges in both directions as long as new nodes are in range. Pruning leaves the
    members of a dense group pointing to its middle, so the way out leads over reversed edges. `own` is the node that
    a query is itself (-1: none), which is in range from the start."""
    start = medoid(vectors)
    count = len(vectors)
    source, target = both_ways(neighbours)
    begins = np.searchsorted(source, np.arange(count + 1))
    out = []
    for begin in range(0, len(queries), block):
        part, self_ = queries[begin : begin + block], own[begin : begin + block]
        ids, near = beam_search(vectors, neighbours, part, start)
        query, slot = np.nonzero(near >= least)
        frontier = query * count + ids[query, slot]
        frontier = np.unique(np.concatenate([frontier, (np.arange(len(part)) * count + self_)[self_ >= 0]]))
        seen = np.zeros(len(part) * count, bool)
        seen[frontier] = True
        hits = [frontier]
        while len(frontier):
            query, node = np.divmod(frontier, count)
            degree = begins[node + 1] - begins[node]
            at = np.repeat(begins[node] - np.cumsum(degree) + degree, degree) + np.arange(degree.sum())
            keys = np.repeat(query, degree) * count + target[at]
            fresh = ~seen[keys]
            seen[keys] = True
            keys = np.unique(keys[fresh])
            query, node = np.divmod(keys, count)
            frontier = keys[np.einsum("nd,nd->n", part[query], vectors[node]) >= least]
            hits.append(frontier)
        query, node = np.divmod(np.concatenate(hits), count)
        out.append((query + begin, node))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
