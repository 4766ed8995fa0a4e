"""Density clustering inside one cell, on arrays: what a task does with the points of a cell and those around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Distances that are computed at once.
BLOCK = 2_000_000


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of `n` nodes' component, by the links a[k] to b[k]."""
    up = np.arange(n)
    while len(a):
        low, high = np.minimum(up[a], up[b]), np.maximum(up[a], up[b])
        left = low != high
        a, b, low, high = a[left], b[left], low[left], high[left]
        np.minimum.at(up, high, low)
        while not np.array_equal(further := up[up], up):
            up = further
    return up


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each row of `p` to each of `q`."""
    d = p[:, None, :] - q[None, :, :]
    return np.sqrt((d[:, :, 0] * d[:, :, 0] + d[:, :, 1] * d[:, :, 1]) + d[:, :, 2] * d[:, :, 2])


def any_within(p: np.ndarray, q: np.ndarray, epsilon: float) -> bool:
    """Is a row of `p` closer than `epsilon` to one of `q`?  The larger side is halved until boxes tell or few pairs are left."""
    todo = [(p, q)]
    while todo:
        a, b = todo.pop()
        low, high = np.maximum(a.min(0), b.min(0)), np.minimum(a.max(0), b.max(0))
        gap = np.maximum(low - high, 0.0)
        if (gap * gap).sum() > (epsilon * (1 + 1e-9)) ** 2:
            continue
        reach = np.maximum(a.max(0), b.max(0)) - np.minimum(a.min(0), b.min(0))
        if (reach * reach).sum() < (epsilon * (1 - 1e-9)) ** 2:
            return True
        if len(a) * len(b) <= 10_000:
            if (far(a, b) < epsilon).any():
                return True
            continue
        if len(a) < len(b):
            a, b = b, a
        axis = int(np.argmax(a.max(0) - a.min(0)))
        order = np.argpartition(a[:, axis], len(a) // 2)
        todo += [(a[order[: len(a) // 2]], b), (a[order[len(a) // 2 :]], b)]
    return False


class Fine:
    """Points in fine cells whose diagonal is below epsilon."""

    def __init__(self, xyz: np.ndarray, epsilon: float) -> None:
        side = epsilon / 3**0.5 * (1 - 1e-9)
        places = np.floor(xyz / side).astype(np.int64)
        places -= places.min(0) - 2
        self.shape = places.max(0) + 3
        keys = (places[:, 0] * self.shape[1] + places[:, 1]) * self.shape[2] + places[:, 2]
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.sizes = np.unique(keys[self.order], return_index=True, return_counts=True)
        self.of = np.empty(len(keys), dtype=np.int64)  # each point's fine cell
        self.of[self.order] = np.repeat(np.arange(len(self.keys)), self.sizes)
        around = np.arange(-2, 3)  # points within epsilon are at most two cells apart along each axis
        self.offsets = ((around[:, None, None] * self.shape[1] + around[None, :, None]) * self.shape[2] + around[None, None, :]).ravel()

    def members(self, cell: int) -> np.ndarray:
        return self.order[self.starts[cell] : self.starts[cell] + self.sizes[cell]]

    def beside(self, cells: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (of `cells`, of all) that are near enough, offset by offset; cells are beside themselves."""
        for offset in self.offsets.tolist():
            key = self.keys[cells] + offset
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            yield cells[there], at[there]

    def pairs(self, points: np.ndarray, xyz: np.ndarray, epsilon: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (of `points`, of all others) closer than `epsilon`, in blocks."""
        cells, first = np.unique(self.of[points], return_inverse=True)
        order = np.argsort(first, kind="stable")
        begin = np.searchsorted(first[order], np.arange(len(cells) + 1))
        for own, other in self.beside(cells):
            k = np.searchsorted(cells, own)
            n, m = begin[k + 1] - begin[k], self.sizes[other]
            ends = np.cumsum(n * m)
            done = 0
            while done < len(own):
                stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BLOCK, side="right")))
                if stop == done + 1 and n[done] * m[done] > BLOCK:  # one crowded cell
                    a, b = points[order[begin[k[done]] : begin[k[done] + 1]]], self.members(int(other[done]))
                    rows = max(1, BLOCK // len(b))
                    for r in range(0, len(a), rows):
                        i, j = np.nonzero(far(xyz[a[r : r + rows]], xyz[b]) < epsilon)
                        yield from self._others(a[r : r + rows][i], b[j])
                else:
                    size = (n * m)[done:stop]
                    at = np.repeat(np.arange(done, stop), size)
                    within = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
                    a = points[order[begin[k[at]] + within // m[at]]]
                    b = self.order[self.starts[other[at]] + within % m[at]]
                    d = xyz[a] - xyz[b]
                    near = np.sqrt((d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]) < epsilon
                    yield from self._others(a[near], b[near])
                done = stop

    @staticmethod
    def _others(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        apart = a != b
        if apart.any():
            yield a[apart], b[apart]


def cluster_cell(xyz: np.ndarray, ring: np.ndarray, was: np.ndarray, epsilon: float, min_points: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """(core, root, edges) of a cell's points: is each of ring 0 and 1 core, a member that stands for its component here, and (point of ring 0 that isn't core, root, how many cores of that component are near).

    Points are those of the cell (ring 0), others within epsilon of it (1) and
    within twice epsilon (2), so all neighbours of rings 0 and 1 are here; `was`
    are known to be core.  All points of a fine cell with more than
    `min_points` + 1 are core and linked without a pair; only the others are
    paired, and crowds linked as any_within() finds.  Links are true ones, so
    cells may be joined by the cores that several of them hold.
    """
    n = len(xyz)
    fine = Fine(xyz, epsilon)
    full = fine.sizes > min_points + 1
    crowded = full[fine.of]
    asked = np.flatnonzero(~crowded & (ring < 2))
    counts = np.zeros(n, dtype=np.int64)
    near_a, near_b = [], []
    for a, b in fine.pairs(asked, xyz, epsilon):
        counts += np.bincount(a, minlength=n)
        inner = ring[b] < 2
        near_a.append(a[inner])
        near_b.append(b[inner])
    core = (crowded | (counts > min_points) | was) & (ring < 2)
    a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (near_a, near_b))
    both = core[a] & core[b]
    links = [(a[both], b[both])]
    # a fine cell's cores are within epsilon of each other; those of full ones stand together
    inner = np.flatnonzero(core)
    cells, at = np.unique(fine.of[inner], return_index=True)
    first = np.full(len(fine.keys), -1)
    first[cells] = inner[at]
    links.append((inner, first[fine.of[inner]]))
    crowds = np.flatnonzero(full & (first >= 0))
    own = {int(c): xyz[m[core[m]]] for c in crowds for m in [fine.members(int(c))]}
    for x, y in fine.beside(crowds):
        later = (x < y) & full[y] & (first[y] >= 0)
        near = [(int(first[c]), int(first[d])) for c, d in zip(x[later].tolist(), y[later].tolist(), strict=True) if any_within(own[c], own[d], epsilon)]
        if near:
            links.append(tuple(np.array(near, dtype=np.int64).T))
    root = components(n, *(np.concatenate(x) for x in zip(*links, strict=True)))
    border = ~core[a] & core[b] & (ring[a] == 0)
    pairs, times = np.unique(np.stack([a[border], root[b[border]]]), axis=1, return_counts=True) if border.any() else (np.zeros((2, 0), dtype=np.int64), np.zeros(0, dtype=np.int64))
    return core, root, list(zip(pairs[0].tolist(), pairs[1].tolist(), times.tolist(), strict=True))


def clustered_cells(batches: Iterator[pa.RecordBatch], epsilon: float, min_points: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (kind, a, rep, n) from rows (cell, obj_id, x, y, z, ring, was) that come cell by cell.

    Kinds: `core`, a core of the cell; `halo`, a core around it; `edge`, a
    point of the cell that isn't core and `n` cores near it.  `rep` is the
    smallest core of the component that the cell knows.
    """
    held: list[pa.RecordBatch] = []

    def done() -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        ids = whole.column("obj_id").to_pylist()
        xyz = np.stack([whole.column(c).to_numpy() for c in "xyz"], axis=1)
        ring, was = whole.column("ring").to_numpy(), whole.column("was").to_numpy()
        core, root, edges = cluster_cell(xyz, ring, was, epsilon, min_points)
        low: dict[int, str] = {}
        cores = np.flatnonzero(core).tolist()
        for k in cores:
            r = int(root[k])
            low[r] = min(low.get(r, ids[k]), ids[k])
        rows = [("core" if ring[k] == 0 else "halo", ids[k], low[int(root[k])], None) for k in cores]
        rows += [("edge", ids[a], low[r], n) for a, r, n in edges]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    now = None
    for batch in batches:
        cells = batch.column("cell").to_pylist()
        begin = 0
        for k, cell in enumerate(cells):
            if cell != now:
                if k > begin:
                    held.append(batch.slice(begin, k - begin))
                if held:
                    yield from done()
                held, now, begin = [], cell, k
        held.append(batch.slice(begin))
    if held:
        yield from done()
