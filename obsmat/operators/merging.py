"""Similarity of clusters, merging of small and of alike ones, and the dendrogram of cluster means."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.operators.de import DEThresholds, Stats
from obsmat.operators.pca import pearson


def similarity(means: DataFrame) -> DataFrame:
    """means: cluster, gene, mean for all clusters x genes. src, dst, sim for src != dst: Pearson over more than two genes,
    else one less the share of the largest distance. Clusters are few; genes are summed over."""
    n_genes = means.select("gene").distinct().count()
    a, b = means.select(F.col("cluster").alias("src"), "gene", F.col("mean").alias("x")), means.select(F.col("cluster").alias("dst"), "gene", F.col("mean").alias("y"))
    both = a.join(b, "gene")
    if n_genes > 2:
        return both.groupBy("src", "dst").agg(pearson("x", "y").alias("sim")).where("src != dst")
    return normalized_distance(both).where("src != dst")


def normalized_distance(both: DataFrame) -> DataFrame:
    """1 - distance / largest distance over the whole block of src x dst."""
    d = both.groupBy("src", "dst").agg(F.sqrt(F.sum((F.col("x") - F.col("y")) * (F.col("x") - F.col("y")))).alias("d"))
    top = F.col("_top")
    d = d.crossJoin(F.broadcast(d.agg(F.max("d").alias("_top"))))  # one row
    return d.select("src", "dst", F.when(top > 0, 1 - F.col("d") / F.when(top > 0, top)).otherwise(1e0).alias("sim"))


def centroid_distances(means: DataFrame) -> DataFrame:
    """means: cluster, gene, mean for all clusters x genes. a, b, dist (euclidean) of each pair a < b; null means are an error of the
    caller, an empty table gives an empty one."""
    a, b = means.select(F.col("cluster").alias("a"), "gene", F.col("mean").alias("x")), means.select(F.col("cluster").alias("b"), "gene", F.col("mean").alias("y"))
    gap = F.col("x") - F.col("y")
    return a.join(b, "gene").where("a < b").groupBy("a", "b").agg(F.sqrt(F.sum(gap * gap)).alias("dist"))


def most_similar(sim: DataFrame) -> DataFrame:
    return sim.where("sim is not null").orderBy(F.desc("sim"), "src", "dst").limit(1)


def nearest_pairs(sim: DataFrame, k: int = 2) -> DataFrame:
    """Distinct (a, b), a < b, of each cluster with its k most similar others."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    near = sim.where("sim is not null").withColumn("r", rank).where(F.col("r") <= k)
    return near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def similarity_array(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    if rows.shape[1] > 2:
        with np.errstate(divide="ignore", invalid="ignore"):
            norm = lambda x: (x - x.mean(1, keepdims=True)) / np.linalg.norm(x - x.mean(1, keepdims=True), axis=1, keepdims=True)
            return norm(rows) @ norm(cols).T
    d = np.sqrt(((rows[:, None, :] - cols[None, :, :]) ** 2).sum(2))
    return 1 - d / d.max() if d.max() > 0 else np.ones_like(d)


def order_pair(a, b):
    return (a, b) if a < b else (b, a)


def nearest_pairs_local(labels: list, means: np.ndarray, of: list | None = None, k: int = 2) -> list[tuple]:
    of = labels if of is None else of
    at = [labels.index(x) for x in of]
    sim = similarity_array(means[at], means)
    for r, i in enumerate(at):
        sim[r, i] = np.nan
    out = []
    for r, x in enumerate(of):
        value = np.where(np.isnan(sim[r]), -np.inf, sim[r])
        for j in np.argsort(-value, kind="stable")[: min(k, len(labels) - 1)]:
            if np.isfinite(value[j]) and (p := order_pair(x, labels[j])) not in out:
                out.append(p)
    return out


def merge_small(labels: list, means: np.ndarray, sizes: dict, min_size: int) -> dict:
    """label -> label after merging clusters under min_size, the most similar pair first, means following."""
    labels, means, sizes, into = list(labels), np.array(means, float), dict(sizes), {x: x for x in labels}
    while len(labels) > 1 and (small := [x for x in labels if sizes[x] < min_size]):
        rows = [labels.index(x) for x in small]
        sim = similarity_array(means[rows], means)
        for r, i in enumerate(rows):
            sim[r, i] = np.nan
        sim = np.where(np.isnan(sim), -np.inf, sim)
        r, j = np.unravel_index(int(np.argmax(sim)), sim.shape)
        i = rows[r]
        if not np.isfinite(sim[r, j]):
            j = 0 if i else 1
        src, dst = labels[i], labels[j]
        means[j] = (means[i] * sizes[src] + means[j] * sizes[dst]) / (sizes[src] + sizes[dst])
        sizes[dst] += sizes.pop(src)
        into = {k: dst if v == src else v for k, v in into.items()}
        labels.pop(i)
        means = np.delete(means, i, axis=0)
    return into


def merge_by_de(stats: Stats, reduced: Stats, thresholds: DEThresholds, *, k: int = 2, method: str = "ebayes", variance_merge: str = "exact") -> dict:
    """label -> label after merging pairs of near clusters whose score is too low, lowest first. stats and reduced change."""
    into = {x: x for x in stats.labels}
    of = None
    while len(stats.labels) > 1:
        pairs = nearest_pairs_local(reduced.labels, reduced.mean, of, k)
        if not pairs:
            break
        scored = sorted(stats.de(pairs, thresholds, method), key=lambda d: (d["score"], d["a"], d["b"]))
        if scored[0]["score"] >= thresholds.score:
            break
        touched: set = set()
        for d in scored:
            if d["score"] >= thresholds.score and d["num"] > thresholds.min_genes:
                break
            dst, src = d["a"], d["b"]
            if d["score"] >= thresholds.score or {dst, src} & touched:
                continue
            stats.merge(src, dst, variance_merge)
            reduced.merge(src, dst, variance_merge)
            into = {x: dst if v == src else v for x, v in into.items()}
            touched |= {dst, src}
        of = [x for x in stats.labels if x in touched]
        if not of:
            break
    return into


def pair_markers(stats: Stats, o) -> set:
    """The first n_markers up and down genes of all pairs of clusters."""
    return stats.first_genes(o.thresholds, o.de_method, o.n_markers) if o.n_markers and len(stats.labels) > 1 else set()


def relabel(assign: DataFrame, into: dict) -> DataFrame:
    kind = dict(assign.dtypes)["cluster"]
    m = assign.sparkSession.createDataFrame([(k, v) for k, v in into.items()] or [], f"cluster {kind}, _into {kind}")
    return assign.join(m, "cluster", "left").select("obs_id", F.coalesce("_into", "cluster").alias("cluster"))


def linkage(means: np.ndarray) -> np.ndarray:
    """Average linkage of the rows: left, right, distance, size a step; new clusters are numbered from len(means).

    By chains of nearest neighbours: a chain is followed until two are each other's nearest, which are joined whatever else
    there is; so each step costs a row of distances, the whole the square of their number. Steps are then sorted by distance."""
    n = len(means)
    if n < 2:
        raise ValueError("fewer than two clusters")
    x = means - means.mean(0)
    if n <= 512:
        d = np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in x])
    else:
        square = (x * x).sum(1)
        d = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * x @ x.T))
    np.fill_diagonal(d, np.inf)
    size, live, chain, steps = np.ones(n), np.ones(n, bool), [], []
    while len(steps) < n - 1:
        if not chain:
            chain = [int(live.argmax())]
        while True:
            here = chain[-1]
            near = int(d[here].argmin())
            if len(chain) > 1 and d[here, chain[-2]] <= d[here, near]:
                break
            chain.append(near)
        i, j = sorted((chain.pop(), chain.pop()))
        steps.append((d[i, j], i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = row[j] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        live[j] = False
    up, leaves, out = list(range(2 * n - 1)), [1] * (2 * n - 1), []
    for step, (far, i, j) in enumerate(sorted(steps, key=lambda s: s[0])):
        a, b = (_top(up, v) for v in (i, j))
        up[a] = up[b] = n + step
        leaves[n + step] = leaves[a] + leaves[b]
        out.append((*sorted((a, b)), far, leaves[n + step]))
    return np.array(out, float)


def _top(up: list[int], v: int) -> int:
    """The cluster that v has come to be part of; ways are shortened as they are walked."""
    while up[v] != v:
        up[v] = up[up[v]]
        v = up[v]
    return v


def cut(tree: np.ndarray, height: float) -> list[int]:
    """The group (0, 1, ... by smallest leaf) of each leaf after all steps of at most this height."""
    n = len(tree) + 1
    up = list(range(n + len(tree)))
    for step, (a, b, far, _) in enumerate(tree):
        if far <= height:
            up[int(a)] = up[int(b)] = n + step
    tops = [_top(up, v) for v in range(n)]
    first = {t: k for k, t in enumerate(dict.fromkeys(tops))}
    return [first[t] for t in tops]


def hclust(stats: DataFrame) -> DataFrame:
    """step, left, right, dist, size of the clusters' means (a few thousand at most; they are collected), leaves in label order."""
    s = Stats.collect(stats)
    rows = [(i, int(a), int(b), float(d), int(n)) for i, (a, b, d, n) in enumerate(linkage(s.mean))]
    return stats.sparkSession.createDataFrame(rows, "step int, left int, right int, dist double, size int")
