"""One clustering step, and the recursion, over a group that fits into one task: the same steps as on the cluster, on arrays.

A level of the recursion has many small groups; each is one group of a single grouped job instead of a chain of jobs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from obsmat.operators import community, hvg, knn, merging, pca
from obsmat.operators.de import Stats


@dataclass
class Group:
    """Rows (ids, sorted), and the non-zeros of their matrix: row, gene (numbers), x. sample: the rows' places in a seeded
    order. latent: one vector a row, or None."""

    ids: np.ndarray
    genes: list
    row: np.ndarray
    gene: np.ndarray
    x: np.ndarray
    sample: np.ndarray
    latent: np.ndarray | None = None

    def part(self, rows: np.ndarray) -> Group:
        """The group of some rows; genes that none of them has go."""
        to = np.full(len(self.ids), -1)
        to[rows] = np.arange(len(rows))
        at = np.flatnonzero(to[self.row] >= 0)
        left, gene = np.unique(self.gene[at], return_inverse=True)
        return Group(self.ids[rows], [self.genes[g] for g in left], to[self.row[at]], gene, self.x[at], self.sample[rows], None if self.latent is None else self.latent[rows])


def _totals(key: np.ndarray, n: int, *values: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(key, minlength=n).astype(float), *(np.bincount(key, v, n) for v in values)]


def _moments(g: Group, key: np.ndarray, n_keys: int, rows: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample variance) of y by key over `rows` rows each, those without an entry being 0."""
    k, total = _totals(key, n_keys, y)
    m = total / np.maximum(k, 1)
    (_, squares) = _totals(key, n_keys, (y - m[key]) ** 2)
    mean = total / rows
    m2 = squares + k * (m - mean) ** 2 + (rows - k) * mean**2
    return mean, np.where(rows > 1, m2 / np.maximum(rows - 1, 1), 0.0)


def stats(g: Group, label: np.ndarray, low: float) -> Stats:
    """Statistics of clusters by gene, as moments.cluster_stats."""
    labels, at = np.unique(label, return_inverse=True)
    n, width = np.bincount(at).astype(float), len(g.genes)
    key = at[g.row] * width + g.gene
    rows = np.repeat(n, width)
    mean, var = _moments(g, key, len(labels) * width, rows, g.x)
    above = np.bincount(key, g.x > low, len(labels) * width) / rows
    shape = (len(labels), width)
    return Stats(labels.tolist(), g.genes, n, mean.reshape(shape), above.reshape(shape), var.reshape(shape))


def vector_stats(x: np.ndarray, label: np.ndarray, low: float) -> Stats:
    """The same of dense vectors."""
    n, width = x.shape
    whole = Group(np.arange(n), list(range(width)), np.repeat(np.arange(n), width), np.tile(np.arange(width), n), x.ravel(), np.arange(n))
    return stats(whole, label, low)


def vectors(g: Group, o) -> np.ndarray | None:
    """Each row in the space of the kept components, or None where there is nothing to tell rows apart by."""
    n = len(g.ids)
    y = np.expm1(g.x)
    mean, var = _moments(g, g.gene, len(g.genes), np.full(len(g.genes), float(n)), y)
    present = np.bincount(g.gene, g.x > o.low, len(g.genes)).astype(int)
    top = hvg.variable_genes(g.genes, present, np.log1p(mean), np.log1p(var / (mean + 1e-10)), o.min_cells, o.max_genes)[2]
    names = sorted(top)
    if len(names) < 2 or n < 3:
        return None
    column = np.full(len(g.genes), -1)
    column[[g.genes.index(name) for name in names]] = np.arange(len(names))
    at = np.flatnonzero(column[g.gene] >= 0)
    dense = np.zeros((n, len(names)))
    dense[g.row[at], column[g.gene[at]]] = g.x[at]
    seen = dense if o.pca_cells is None else dense[np.argsort(g.sample, kind="stable")[: o.pca_cells]]
    from obsmat.plans.clustering import kept_components

    loadings, ev, evr, center = pca.components(len(seen), seen.sum(0), seen.T @ seen, o.n_comps)
    keep = kept_components(ev, evr, o)
    return (dense - center) @ loadings[:, keep] if keep else None


def edges(x: np.ndarray, k: int, o) -> list[tuple[int, int, float]]:
    """Sorted undirected edges (row numbers) of the neighbour graph."""
    near = knn.nearest_rows(x, x, k, o.metric)[0].reshape(len(x), -1)
    k = near.shape[1]
    src, dst = np.repeat(np.arange(len(x)), k), near.ravel()
    if o.weighting == "jaccard":
        member = np.sort(src * len(x) + dst)
        shared = np.zeros(len(src))
        for j in range(k):  # whether the j-th neighbour of src is one of dst's
            want = dst * len(x) + near[src, j]
            shared += member[np.minimum(np.searchsorted(member, want), len(member) - 1)] == want
        w = shared / (2 * k - shared)
    else:
        w = np.ones(len(src))
    out: dict = {}
    for a, b, v in zip(np.minimum(src, dst).tolist(), np.maximum(src, dst).tolist(), w.tolist(), strict=True):
        out[a, b] = (max(out[a, b], v) if o.community == "louvain" else out[a, b] + v) if (a, b) in out else v
    return sorted((a, b, v) for (a, b), v in out.items())


def onestep(g: Group, o) -> tuple[np.ndarray, set]:
    """(cluster of each row, markers), as clustering.onestep."""
    none = np.zeros(len(g.ids), np.int64), set()
    x = vectors(g, o) if g.latent is None else g.latent
    if x is None or not len(x) or not x.shape[1]:
        return none
    pairs = edges(x, min(o.k, x.shape[1]) if g.latent is None else o.k, o)
    found = community.local_communities(pairs, list(range(len(x))), o.resolution if o.community == "louvain" else 1.0, o.seed, o.community == "leiden")
    label = np.array([found[i] for i in range(len(x))])
    first = vector_stats(x, label, o.low)
    if len(first.labels) < 2:
        return label, set()
    moved = lambda into: np.array([into[c] for c in label.tolist()])
    label = moved(merging.merge_small(first.labels, first.mean, dict(zip(first.labels, first.n, strict=True)), o.thresholds.cluster_size or 0))
    full = stats(g, label, o.thresholds.low)
    label = moved(merging.merge_by_de(full, vector_stats(x, label, o.low), o.thresholds, k=o.nearest, method=o.de_method))
    return label, merging.pair_markers(full, o)


def iterate(g: Group, path: str, o, min_samples: int) -> tuple[list[str], set]:
    """(the path of each row, markers): the recursion below `path` to its end."""
    paths, found, todo = [path] * len(g.ids), set(), [(path, np.arange(len(g.ids)), g)]
    while todo:
        name, rows, inside = todo.pop()
        if len(rows) < min_samples:
            continue
        label, markers = onestep(inside, o)
        clusters = sorted(set(label.tolist()))
        if len(clusters) < 2:
            continue
        found |= markers
        for c in clusters:
            mine = np.flatnonzero(label == c)
            for r in rows[mine].tolist():
                paths[r] = f"{name}.{c}"
            todo.append((f"{name}.{c}", rows[mine], inside.part(mine)))
    return paths, found
