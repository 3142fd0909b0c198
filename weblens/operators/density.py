"""Density clusters: a minimum spanning tree over mutual reachability, condensed to clusters that last.

The distance of two rows is the greatest of their distance and of how far each has its k-th neighbour. The rows to be fitted
are a sample of bounded size. They lie in blocks, and each pair of blocks is a task of its own, which finds the spanning tree
of the pair's rows. The tree of all rows is among those edges: an edge that is the longest of a cycle within a pair is no
edge of it. Tasks join the trees of their pairs and the driver joins theirs, by Borůvka's rounds: each component takes the
least edge that leaves it. Edges of equal length are ordered by their rows, so that a round cannot close a cycle.

Read from the longest edge down, the tree falls apart. A part of fewer than ``least`` rows leaves its cluster; where two or
more parts have as many, the cluster ends and they begin. Edges of one length go together, so no order of ties counts. A
cluster's stability sums, over its rows, how much denser (1 / distance) it became before they left; of a cluster and those
that it fell into the more stable stay. All rows together are never a cluster. Copies count as 1e-9 apart, so that density
has a bound.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of a block; a task holds two.
BLOCK = 1024
#: Tasks that join the trees of their pairs of blocks before the driver joins theirs.
TASKS = 64
NEAR = 1e-9


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        out += (a[:, f, None] - b[None, :, f]) ** 2
    return np.sqrt(out)


def tree_of(ids: np.ndarray, x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of the minimum spanning tree of some rows (ascending ids), grown from the first of them."""
    n = len(ids)
    inside = np.zeros(n, bool)
    best, low, high = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        best[at] = np.inf
        d = np.maximum(np.maximum(distances(x[at : at + 1], x)[0], core), max(core[at], NEAR))
        a, b = np.minimum(ids, ids[at]), np.maximum(ids, ids[at])
        nearer = ~inside & ((d < best) | ((d == best) & ((a < low) | ((a == low) & (b < high)))))
        best[nearer], low[nearer], high[nearer] = d[nearer], a[nearer], b[nearer]
        ties = np.flatnonzero(best == best.min())
        at = int(ties[np.lexsort((high[ties], low[ties]))[0]])
        edges.append((low[at], high[at], best[at]))
    a, b, d = zip(*edges, strict=True) if edges else ((), (), ())
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d, float)


def forest_of(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which edges a minimum spanning forest keeps, by Borůvka's rounds; of one edge given twice it keeps one."""
    if not len(a):
        return np.zeros(0, bool)
    nodes = np.unique(np.concatenate([a, b]))
    ends = np.searchsorted(nodes, np.stack([a, b]))
    rank = np.empty(len(a), np.int64)
    order = np.lexsort((b, a, d))
    rank[order] = np.arange(len(a))
    label, kept = np.arange(len(nodes)), np.zeros(len(a), bool)
    while True:
        one, two = label[ends]
        leaving = np.flatnonzero(one != two)
        if not len(leaving):
            return kept
        least = np.full(len(nodes), len(a))
        np.minimum.at(least, one[leaving], rank[leaving])
        np.minimum.at(least, two[leaving], rank[leaving])
        roots = np.flatnonzero(least < len(a))
        edge = order[least[roots]]
        kept[edge] = True
        to = np.arange(len(nodes))
        to[roots] = np.where(one[edge] == roots, two[edge], one[edge])
        # Two components that chose each other meet in the smaller one.
        both = (to[to] == np.arange(len(nodes))) & (np.arange(len(nodes)) < to)
        to[both] = np.flatnonzero(both)
        while (to[to] != to).any():
            to = to[to]
        label = to[label]


def core_distances(spark: SparkSession, x: np.ndarray, k: int, block: int = BLOCK) -> np.ndarray:
    """How far each row has its k-th other."""
    shared, n = spark.sparkContext.broadcast(x), len(x)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for b in batches for i in b.column("id").to_pylist()):
            ids = np.arange(i * block, min(n, (i + 1) * block))
            d = distances(shared.value[ids], shared.value)
            d[np.arange(len(ids)), ids] = np.inf
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.partition(d, min(k, n - 1) - 1, axis=1)[:, min(k, n - 1) - 1] if n > 1 else np.zeros(n))], names=["id", "core"])

    out = np.zeros(n)
    blocks = -(-n // block)
    for r in spark.range(0, blocks, 1, blocks).mapInArrow(near, "id long, core double").collect():  # a row a fitted row
        out[r.id] = r.core
    return out


def spanning_tree(spark: SparkSession, x: np.ndarray, core: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance) of all rows' minimum spanning tree, from those of all pairs of blocks."""
    shared, n = spark.sparkContext.broadcast((x, core)), len(x)
    blocks = -(-n // block)
    pairs = [(i, j) for i in range(blocks) for j in range(i + (blocks > 1), blocks)]

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, cores = shared.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for p in (p for b in batches for p in b.column("id").to_pylist()):
            ids = np.unique(np.concatenate([np.arange(i * block, min(n, (i + 1) * block)) for i in pairs[p]]))
            held = [np.concatenate(v) for v in zip(held, tree_of(ids, rows[ids], cores[ids]), strict=True)]
            kept = forest_of(*held)
            held = [v[kept] for v in held]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], names=["a", "b", "d"])

    got = spark.range(0, len(pairs), 1, max(1, min(TASKS, len(pairs)))).mapInArrow(trees, "a long, b long, d double").distinct().collect()  # a tree a task
    a, b, d = (np.array(v, t) for v, t in zip(zip(*got, strict=True), (np.int64, np.int64, float), strict=True)) if got else (np.zeros(0, np.int64),) * 3
    kept = forest_of(a, b, d)
    return a[kept], b[kept], d[kept]


@dataclass
class Clusters:
    """For each row its cluster (-1: none) and its density on leaving; for each cluster the densities of its birth and of its last row."""

    label: np.ndarray
    left: np.ndarray
    born: np.ndarray
    last: np.ndarray


def dendrogram(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[list[list[int]], list[float]]:
    """Children and height of each inner node, numbered from n; edges of one length make one node of many children."""
    root, node = list(range(n)), list(range(n))
    children: list[list[int]] = []
    heights: list[float] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = np.argsort(d, kind="stable")
    for height, group in groupby(order.tolist(), key=lambda i: d[i]):
        joined: dict[int, list[int]] = {}
        for e in group:
            one, two = find(int(a[e])), find(int(b[e]))
            if one != two:
                root[two] = one
                joined[one] = joined.pop(one, [node[one]]) + joined.pop(two, [node[two]])
        for at, parts in joined.items():
            node[at] = n + len(children)
            children.append(parts)
            heights.append(float(height))
    return children, heights


def condensed(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, least: int) -> Clusters:
    """The clusters of a spanning tree."""
    label, left = np.full(n, -1), np.zeros(n)
    if n < 2:
        return Clusters(label, left, np.zeros(0), np.zeros(0))
    children, heights = dendrogram(n, a, b, d)
    size = [1] * n
    for parts in children:
        size.append(sum(size[c] for c in parts))

    def rows(top: int) -> list[int]:
        out, stack = [], [top]
        while stack:
            at = stack.pop()
            if at < n:
                out.append(at)
            else:
                stack.extend(children[at - n])
        return out

    born, above, stable = [0.0], [-1], [0.0]
    fell = np.zeros(n, np.int64)
    stack = [(n + len(children) - 1, 0)]
    while stack:
        at, cluster = stack.pop()
        dense = 1.0 / heights[at - n]
        big = [c for c in children[at - n] if size[c] >= least]
        for c in children[at - n]:
            if size[c] < least:
                gone = rows(c)
                fell[gone], left[gone] = cluster, dense
        staying = size[big[0]] if len(big) == 1 else 0
        stable[cluster] += (size[at] - staying) * (dense - born[cluster])
        if len(big) == 1:
            stack.append((big[0], cluster))
        elif big:
            for c in big:
                born.append(dense)
                above.append(cluster)
                stable.append(0.0)
                stack.append((c, len(born) - 1))
    chosen, best, inner = [False] * len(born), list(stable), [0.0] * len(born)
    for c in range(len(born) - 1, 0, -1):
        chosen[c] = stable[c] >= inner[c]
        best[c] = max(stable[c], inner[c])
        inner[above[c]] += best[c]
    top = [-1] * len(born)
    for c in range(1, len(born)):  # clusters come after those that they fell from
        top[c] = top[above[c]] if top[above[c]] >= 0 else c if chosen[c] else -1
    names = sorted({t for t in top if t >= 0})
    at = np.array([names.index(t) if t >= 0 else -1 for t in top])
    label = at[fell]
    last = np.array([left[label == i].max() for i in range(len(names))])
    return Clusters(label, left, np.array([born[c] for c in names]), last)


def nearest_by_reach(x: np.ndarray, rows: np.ndarray, core: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of x the fitted row that it reaches best, and its density there; of equal ones the nearer, then the first."""
    d = distances(x, rows)
    own = np.partition(d, min(k, len(rows)) - 1, axis=1)[:, min(k, len(rows)) - 1]
    reach = np.maximum(np.maximum(d, core[None]), np.maximum(own, NEAR)[:, None])
    tied = reach == reach.min(axis=1)[:, None]
    at = np.where(tied, d, np.inf).argmin(axis=1)
    return at, 1.0 / reach[np.arange(len(x)), at]
