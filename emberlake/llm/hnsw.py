"""A hierarchical navigable small-world graph in flat arrays, built and searched for groups of near vectors at a time.

Layer 0 holds every vector, each higher one a random LEVEL-th part of the one below. A layer is one array of
neighbour numbers, -1 where a list ends. Vectors are unit length; similarity is the dot product. Queries that
come down to one place walk a layer together: whatever one of them meets is measured for all of them by one
matrix product, and a vector is expanded if it is among the best of any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

DEGREE, BASE_DEGREE = 8, 24
#: Candidates kept of each vector while inserting, of a vector searched from itself, and of one that comes from elsewhere.
BUILD_WIDTH, SEARCH_WIDTH, VISIT_WIDTH = 16, 24, 48
LEVEL = 32
#: Places of the layer above from which a walk begins.
ENTRIES = 8
BATCH, GROUP = 1024, 64
#: A full neighbour list is cut by this part.
SLACK = 4
#: The nearest candidates among which links that lead away are looked for.
DIVERSE = 16


class Graph:
    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    def to_bytes(self) -> tuple[bytes, bytes, int, int, int]:
        return self.vectors.tobytes(), np.concatenate([x.ravel() for x in self.layers]).tobytes(), len(self.vectors), len(self.layers), self.entry

    @classmethod
    def from_bytes(cls, vectors: bytes, links: bytes, n: int, layers: int, entry: int) -> Graph:
        flat = np.frombuffer(links, np.int32)
        ends = np.cumsum([n * BASE_DEGREE] + [n * DEGREE] * (layers - 1))
        parts = [x.reshape(n, -1) for x in np.split(flat, ends[:-1])]
        return cls(np.frombuffer(vectors, np.float32).reshape(n, -1), parts, entry)

    def _walk(self, layer: int, queries: np.ndarray, start: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar vectors that a group of queries meets in one layer, best first, as (numbers, similarities).

        From the distinct numbers ``start``, the neighbours of all that is among the ``width`` best of any query so
        far are met, until nothing new is.
        """
        x, links = self.vectors, self.layers[layer]
        seen = np.zeros(len(x) + 1, bool)
        seen[-1] = seen[start] = True  # the last place takes the padding
        best = np.full((len(queries), width), -np.inf, np.float32)
        new, numbers, sims = start, [], []
        while len(new):
            s = queries @ x[new].T
            best = np.partition(np.concatenate([best, s], 1), s.shape[1], 1)[:, s.shape[1] :]
            good = (s >= best.min(1)[:, None]).any(0)
            front = new[good]
            numbers.append(front)
            sims.append(s[:, good])
            near = links[front].ravel()
            near = near[~seen[near]]
            seen[near] = True
            new = np.unique(near)
        ids, s = np.concatenate(numbers), np.concatenate(sims, 1)
        k = min(k, len(ids))
        pick = np.argpartition(-s, k - 1, 1)[:, :k]
        s = np.take_along_axis(s, pick, 1)
        order = np.argsort(-s, 1, kind="stable")
        return ids[np.take_along_axis(pick, order, 1)], np.take_along_axis(s, order, 1)

    def _entries(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Up to ENTRIES places of the layer above ``to`` that are nearest to each query, best first; repeats pad."""
        at = np.full((len(queries), 1), self.entry, np.int64)
        for layer in range(len(self.layers) - 1, to, -1):
            below = np.empty((len(queries), ENTRIES), np.int64)
            for rows in _groups(at[:, 0], 4 * GROUP):
                ids, _ = self._walk(layer, queries[rows], np.unique(at[rows]), ENTRIES, ENTRIES)
                below[rows] = ids[:, np.minimum(np.arange(ENTRIES), ids.shape[1] - 1)]
            at = below
        return at

    def search(self, queries: np.ndarray, k: int, start: np.ndarray | None = None, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar vectors of each query, best first. ``start``: each query's own number, if it is in the graph."""
        width = max(k, width or (VISIT_WIDTH if start is None else SEARCH_WIDTH))
        ids, sims = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
        at = self._entries(queries, 0)
        for rows in _groups(at[:, 0], GROUP):
            begin = np.unique(at[rows] if start is None else np.concatenate([at[rows, 0], start[rows]]))
            i, s = self._walk(0, queries[rows], begin, width, k)
            ids[rows, : i.shape[1]], sims[rows, : i.shape[1]] = i, s
        return ids, sims


def _groups(place: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The rows of each place, ``most`` at a time."""
    order = np.argsort(place, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
        for a in range(0, len(rows), most):
            yield rows[a : a + most]


def _select(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Of each row's candidates, those nearer to it than to a chosen one first, then the nearest of the rest."""
    order = np.argsort(-sims, 1, kind="stable")[:, : degree + degree // 3]
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    real = sims > -np.inf
    n = min(ids.shape[1], DIVERSE)
    v = x[np.where(real, ids, 0)[:, :n]]
    between = np.matmul(v, v.transpose(0, 2, 1))
    apart = np.zeros(ids.shape, bool)
    nearest = np.full((len(ids), n), -np.inf, np.float32)  # to any chosen one
    for k in range(n):
        apart[:, k] = real[:, k] & (sims[:, k] > nearest[:, k])
        nearest = np.where(apart[:, k, None], np.maximum(nearest, between[:, k]), nearest)
    # A third of the list is kept for links that lead away, the rest for the nearest.
    rank = np.where(apart & (np.cumsum(apart, 1) <= max(2, degree // 3)), 0, np.where(real, 1, 2))
    first = np.argsort(rank, 1, kind="stable")[:, :degree]
    out = np.full((len(ids), degree), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(np.where(real, ids, -1), first, 1)
    return out


def _connect(x: np.ndarray, links: np.ndarray, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
    """Give the ``new`` vectors their neighbours out of the candidates, and those a link back."""
    degree = links.shape[1]
    chosen = _select(x, ids, sims, degree)
    links[new] = chosen
    rows, cols = np.nonzero(chosen >= 0)
    target, source = chosen[rows, cols].astype(np.int64), new[rows]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    hubs, begin, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(begin, count)
    at = np.repeat(np.arange(len(hubs)), count)
    used = (links[hubs] >= 0).sum(1)
    fits = used + count <= degree
    # Where the list has room, append; elsewhere choose anew.
    easy = fits[at]
    links[target[easy], (used[at] + place)[easy]] = source[easy]
    full = np.flatnonzero(~fits)
    if len(full):
        back = np.full((len(full), degree + int(count[full].max())), -1, np.int64)
        back[:, :degree] = links[hubs[full]]
        slot = np.full(len(hubs), -1)
        slot[full] = np.arange(len(full))
        hard = ~easy
        back[slot[at[hard]], degree + place[hard]] = source[hard]
        for a in range(0, len(full), BATCH // 2):
            b = back[a : a + BATCH // 2]
            b = b[:, (b >= 0).any(0)]
            own = x[hubs[full[a : a + BATCH // 2]]]
            s = np.where(b >= 0, np.matmul(x[np.maximum(b, 0)], own[:, :, None])[..., 0], -np.inf)
            # Cut below the full length, so that the next links find room and not every one needs a choice.
            links[hubs[full[a : a + BATCH // 2]]] = -1
            kept = _select(x, b, s, degree - degree // SLACK)
            links[hubs[full[a : a + BATCH // 2]], : kept.shape[1]] = kept


def build(vectors: np.ndarray, seed: int = 0) -> Graph:
    """The graph of unit ``vectors`` (n, d), which go in by batches that grow with the graph."""
    x = np.ascontiguousarray(vectors, np.float32)
    n = len(x)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LEVEL)).astype(int), 5)
    order = rng.permutation(n)
    order = order[np.argsort(-level[order], kind="stable")]  # upper layers first, so that all descend the same ones
    layers = [np.full((n, DEGREE if k else BASE_DEGREE), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
    graph = Graph(x, layers, int(order[0]) if n else 0)
    at = 0
    while at < n:
        new = order[at : at + max(1, min(BATCH, at // 2))]
        q = x[new]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        for layer in range(int(level[new].max()), -1, -1):
            in_layer = np.flatnonzero(level[new] >= layer)
            if at == 0:
                continue
            places = graph._entries(q[in_layer], layer)
            ids, sims = np.full((len(in_layer), BUILD_WIDTH), -1, np.int64), np.full((len(in_layer), BUILD_WIDTH), -np.inf, np.float32)
            order_near = np.argsort(places[:, 0], kind="stable")  # few come down to one place: neighbouring ones walk together
            for a in range(0, len(order_near), GROUP):
                rows = order_near[a : a + GROUP]
                i, s = graph._walk(layer, q[in_layer[rows]], np.unique(places[rows]), BUILD_WIDTH, BUILD_WIDTH)
                ids[rows, : i.shape[1]], sims[rows, : i.shape[1]] = i, s
            # The batch's own members are candidates too.
            mates = own[np.ix_(in_layer, in_layer)]
            k = min(8, mates.shape[1])
            top = np.argpartition(-mates, k - 1, 1)[:, :k]
            ids = np.concatenate([ids, new[in_layer][top]], 1)
            sims = np.concatenate([sims, np.take_along_axis(mates, top, 1)], 1)
            _connect(x, layers[layer], new[in_layer], ids, np.where(ids >= 0, sims, -np.inf))
        at += len(new)
    return graph
