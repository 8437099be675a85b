"""Communities of weighted graphs by modularity: moves and contraction on the cluster until the graph has a bounded number of
edges, then level by level in one task."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.operators import knn as nn
from obsmat.sources.scratch import kept, numbered


def _level(adj: list[dict[int, float]], loops: np.ndarray, resolution: float, rng: np.random.Generator) -> list[int]:
    """One round of local moves; returns the community of each node."""
    n = len(adj)
    degree = [sum(a.values()) + 2 * loop for a, loop in zip(adj, loops.tolist(), strict=True)]
    m2 = sum(degree)
    comm, total = list(range(n)), list(degree)
    if m2 == 0:
        return comm
    near, share = [list(a.items()) for a in adj], resolution / m2
    moved = True
    while moved:
        moved = False
        for i in rng.permutation(n).tolist():
            own, d = comm[i], degree[i]
            to = {own: 0.0}
            for j, w in near[i]:
                c = comm[j]
                to[c] = to.get(c, 0.0) + w
            total[own] -= d
            best, gain, pull = own, to[own] - share * d * total[own], share * d
            for c, w in to.items():
                g = w - pull * total[c]
                if g > gain + 1e-12 or (c < best != own and g > gain - 1e-12):
                    best, gain = c, g
            total[best] += d
            if best != own:
                comm[i], moved = best, True
    return comm


def _connected(adj: list[dict[int, float]], comm: list[int]) -> list[int]:
    """Communities split into their connected parts."""
    out, nxt = [-1] * len(adj), 0
    for i in range(len(adj)):
        if out[i] < 0:
            stack, out[i] = [i], nxt
            while stack:
                u = stack.pop()
                for v in adj[u]:
                    if out[v] < 0 and comm[v] == comm[i]:
                        out[v] = nxt
                        stack.append(v)
            nxt += 1
    return out


def local_communities(edges: list[tuple], nodes: list, resolution: float = 1.0, seed: int | None = None, refine: bool = False) -> dict:
    """node -> community (0, 1, ... in order of nodes). refine: communities are always connected."""
    at = {v: i for i, v in enumerate(nodes)}
    adj: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    loops = np.zeros(len(nodes))
    for a, b, w in edges:
        i, j = at[a], at[b]
        if i == j:
            loops[i] += w
        else:
            adj[i][j] += w
            adj[j][i] += w
    rng, where = np.random.default_rng(0 if seed is None else seed), list(range(len(nodes)))
    while True:
        comm = _level(adj, loops, resolution, rng)
        if refine:
            comm = _connected(adj, comm)
        names = {c: k for k, c in enumerate(dict.fromkeys(comm))}
        comm = [names[c] for c in comm]
        where = [comm[x] for x in where]
        if len(names) == len(adj):
            break
        new: list[dict[int, float]] = [defaultdict(float) for _ in names]
        fresh = np.zeros(len(names))
        for i, a in enumerate(adj):
            fresh[comm[i]] += loops[i]
            for j, w in a.items():
                if comm[i] == comm[j]:
                    fresh[comm[i]] += w / 2
                else:
                    new[comm[i]][comm[j]] += w
        adj, loops = new, fresh
    first = {c: k for k, c in enumerate(dict.fromkeys(where))}
    return {v: first[where[i]] for v, i in at.items()}


def _dealt(labels: DataFrame) -> DataFrame:
    """labels to be joined by shuffles: their number grows with the graph, so round after round would pass them through the driver
    wherever one table is small enough to be broadcast."""
    return labels.hint("merge")


def spread_labels(graph: DataFrame, resolution: float = 1.0, *, start: DataFrame | None = None, rounds: int = 40, least_gain: float = 1e-4) -> DataFrame:
    """node, community by parallel moves on the cluster: in each round half of the nodes, another half each time, may go to the
    neighbouring community that raises modularity most. start: node, community of each node to begin with, instead of each by itself.

    Each round is joins of edges with labels and sums by (node, community), checkpointed. It stops where nothing moves any more
    or where two rounds have raised modularity by less than least_gain, and gives the labels of the best round.
    """
    ends = [graph.where("a != b").select(F.col(u).alias("u"), F.col(v).alias("v"), "w") for u, v in (("a", "b"), ("b", "a"))]
    arcs = ends[0].unionByName(ends[1]).transform(kept)
    sides = graph.select(F.col("a").alias("node"), "w").unionByName(graph.select(F.col("b").alias("node"), "w"))
    degree = sides.groupBy("node").agg(F.sum("w").alias("degree")).transform(kept)
    two_m = degree.agg(F.sum("degree")).first()[0] or 1.0
    loops = 2 * (graph.where("a = b").agg(F.sum("w")).first()[0] or 0.0)
    lab = degree.select("node", "degree", F.col("node").alias("community")) if start is None else degree.join(start.transform(_dealt), "node").select("node", "degree", "community")
    best, best_q, idle = lab, -1.0, 0
    for r in range(rounds):
        totals = lab.groupBy("community").agg(F.sum("degree").alias("total"))
        to = arcs.join(lab.select(F.col("node").alias("v"), "community").transform(_dealt), "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("w"))
        to = to.unionByName(lab.select("node", "community", F.lit(0e0).alias("w"))).groupBy("node", "community").agg(F.sum("w").alias("w"))
        seen = to.join(totals.transform(_dealt), "community").join(lab.withColumnRenamed("community", "own").transform(_dealt), "node")
        stay = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("degree") * (F.col("total") - F.when(stay, F.col("degree")).otherwise(0e0)) / two_m
        each = seen.groupBy("node", "degree", "own").agg(F.max(F.struct(gain.alias("g"), stay.alias("stay"), F.col("community").alias("c"))).alias("b"), F.sum(F.when(stay, F.col("w")).otherwise(0e0)).alias("inside"))
        turn = F.pmod(F.xxhash64("node", F.lit(r)), F.lit(2)) == 0
        step = each.select("node", "degree", "own", "inside", F.when(turn, F.col("b.c")).otherwise(F.col("own")).alias("community"), (F.col("b.c") != F.col("own")).alias("could")).transform(kept)
        sums = step.groupBy("own").agg(F.sum("inside").alias("i"), F.sum("degree").alias("t"), F.max("could").alias("could"))
        told = sums.agg(F.sum("i").alias("i"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.max("could").alias("could")).first()
        q = ((told.i or 0.0) + loops) / two_m - resolution * (told.tt or 0.0) / (two_m * two_m)  # of the labels that this round started with
        idle = idle + 1 if q < best_q + least_gain else 0
        if q > best_q:
            best, best_q = step.select("node", F.col("own").alias("community")), q
        if not told.could or idle >= 2:
            break
        lab = step.select("node", "degree", "community")
    return best.select("node", "community")


def united(graph: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """node, community after one round in which nodes unite with the neighbour that raises modularity most, if any does.

    Two nodes that name each other are a pair, named by the smaller one; others whose neighbour is in a pair follow it. Of the rest half,
    by a seeded hash, go to their neighbour where that is of the other half; so a fixed share of the nodes that can unite does, however
    long the chains of best neighbours are. Communities are connected, as all unite along edges.
    """
    sides = graph.select(F.col("a").alias("node"), "w").unionByName(graph.select(F.col("b").alias("node"), "w"))
    degree = sides.groupBy("node").agg(F.sum("w").alias("degree")).transform(kept)
    two_m = degree.agg(F.sum("degree")).first()[0] or 1.0
    da, db = (degree.select(F.col("node").alias(s), F.col("degree").alias(f"d{s}")).transform(_dealt) for s in ("a", "b"))
    gain = F.col("w") - resolution * F.col("da") * F.col("db") / two_m  # the same from both ends
    told = graph.where("a != b").join(da, "a").join(db, "b").select("a", "b", gain.alias("g"), F.xxhash64("a", "b").alias("h")).where("g > 1e-12")
    ends = [told.select(F.col(u).alias("node"), F.struct("g", "h", F.col(v).alias("to")).alias("k")) for u, v in (("a", "b"), ("b", "a"))]
    best = ends[0].unionByName(ends[1]).groupBy("node").agg(F.max("k").alias("k")).select("node", F.col("k.to").alias("to")).transform(kept)
    back = best.select(F.col("node").alias("to"), F.col("to").alias("back"))
    both = best.join(back.transform(_dealt), "to").select("node", "to", (F.col("back") == F.col("node")).alias("pair")).transform(kept)
    of = both.select(F.col("node").alias("to"), F.col("pair").alias("of_pair"), F.col("to").alias("other"))
    away = lambda c: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(2)) == 0
    pair = F.when(F.col("pair"), F.least("node", "to")).when(F.col("of_pair"), F.least("to", "other"))
    moved = both.join(of.transform(_dealt), "to").select("node", F.coalesce(pair, F.when(away("node") & ~away("to"), F.col("to"))).alias("community"))
    return degree.select("node").join(moved.transform(_dealt), "node", "left").select("node", F.coalesce("community", "node").alias("community")).transform(kept)


def connected_parts(graph: DataFrame, lab: DataFrame, rounds: int = 100) -> DataFrame:
    """node, community with communities split into their connected parts, each named by its smallest node: passes of the smallest name
    over the edges inside communities, with jumps to the name's own name, until none changes."""
    a, b = (lab.select(F.col("node").alias(s), F.col("community").alias(f"c{s}")) for s in ("a", "b"))
    inside = graph.where("a != b").join(a.transform(_dealt), "a").join(b.transform(_dealt), "b").where("ca = cb")
    arcs = inside.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(inside.select(F.col("b").alias("u"), F.col("a").alias("v"))).transform(kept)
    part = lab.select("node", F.col("node").alias("part"))
    for _ in range(rounds):
        near = arcs.join(part.select(F.col("node").alias("v"), "part").transform(_dealt), "v").groupBy(F.col("u").alias("node")).agg(F.min("part").alias("near"))
        step = part.join(near.transform(_dealt), "node", "left").select("node", F.col("part").alias("old"), F.least("part", F.coalesce("near", "part")).alias("part")).transform(kept)
        jump = step.select(F.col("node").alias("part"), F.col("part").alias("far"))
        new = step.join(jump.transform(_dealt), "part").select("node", F.col("far").alias("part"), (F.col("far") != F.col("old")).alias("moved")).transform(kept)
        part = new.select("node", "part")
        if not new.agg(F.max("moved")).first()[0]:
            return part.withColumnRenamed("part", "community")
    raise RuntimeError("connected parts did not settle")


def _in_one_task(graph: DataFrame, kind: str, resolution: float, seed: int | None, refine: bool) -> DataFrame:
    """node, community of a graph whose size has been checked, worked in a task."""

    def work(t: pa.Table) -> pa.Table:
        pairs = sorted(zip(*(t.column(c).to_pylist() for c in ("a", "b", "w")), strict=True))
        nodes = sorted({x for a, b, _ in pairs for x in (a, b)})
        found = local_communities(pairs, nodes, resolution, seed, refine)
        return pa.table({"node": pa.array(list(found), t.schema.field("a").type), "community": pa.array(list(found.values()), pa.int32())})

    return graph.select("a", "b", "w", F.lit(0).alias("_all")).groupBy("_all").applyInArrow(work, f"node {kind}, community int")


def communities(edges: DataFrame, method: str = "louvain", *, resolution: float = 1.0, seed: int | None = None, local_edges: int = 1_000_000) -> DataFrame:
    """node, community (int) of directed weighted edges (src, dst, w).

    louvain: an edge and its reverse are one; leiden: they add up, the resolution is 1, and every community is connected, at
    any size of the graph. While a graph has more than local_edges edges its nodes unite in parallel on the cluster with their best neighbours
    and become the nodes of a smaller graph, and so on until nothing is united any more or the graph is small enough for one task. Where
    that was done, nodes of the first graph then move between the communities found, a few rounds; with leiden, communities are split into
    their connected parts; and what that leaves is united in the same way again, if that is worth it.
    Nodes and edges never pass through the driver. Isolated nodes are not in the edges and have no community; edges with null ends
    or weights are ignored, repeated ones count as `undirected` says; an empty graph gives an empty table.
    """
    if method not in ("louvain", "leiden"):
        raise ValueError(f"unknown method {method}")
    graph = nn.undirected(edges.where("src is not null and dst is not null and w is not null"), "collapse" if method == "louvain" else "sum").transform(kept)
    resolution = resolution if method == "louvain" else 1.0
    kind, refine = dict(edges.dtypes)["src"], method == "leiden"
    found, in_one_task = _united_to_the_end(graph, None, kind, resolution, seed, refine, local_edges)
    if in_one_task:
        return found
    found = found.transform(kept)
    names = found.groupBy("community").agg(F.min("node").alias("name"))
    lab = spread_labels(graph, resolution, start=found.join(names.transform(_dealt), "community").select("node", F.col("name").alias("community")), rounds=8, least_gain=1e-3)
    if refine:
        lab = connected_parts(graph, lab)
    lab = lab.transform(kept)
    return _united_to_the_end(_contracted(graph, lab), lab, kind, resolution, seed, refine, local_edges)[0]


def _contracted(graph: DataFrame, lab: DataFrame) -> DataFrame:
    """The graph of the communities."""
    a, b = (lab.select(F.col("node").alias(s), F.col("community").alias(f"c{s}")) for s in ("a", "b"))
    return graph.join(a.transform(_dealt), "a").join(b.transform(_dealt), "b").groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")).transform(kept)


def _united_to_the_end(graph: DataFrame, whole: DataFrame | None, kind: str, resolution: float, seed: int | None, refine: bool, local_edges: int) -> tuple[DataFrame, bool]:
    """(node, community (int); whether one task has done it all) of the nodes of `whole` (node, community: a node of graph), or of graph."""
    into = lambda w, lab: lab if w is None else w.join(lab.select(F.col("node").alias("community"), F.col("community").alias("_to")).transform(_dealt), "community").select("node", F.col("_to").alias("community"))
    level, size = 0, graph.count()
    while size > local_edges:
        lab, level = united(graph, resolution, level), level + 1
        if lab.where("node != community").limit(1).count() == 0:
            names = numbered(lab.select("community").distinct(), "community").select(F.col("community").alias("node"), F.col("_n").cast("int").alias("community"))
            return into(lab if whole is None else whole, names), False
        whole = into(whole, lab).transform(kept)
        graph = _contracted(graph, lab)
        size = graph.count()
    return into(whole, _in_one_task(graph, kind, resolution, seed, refine).transform(kept)), level == 0


def split_outliers(labels: DataFrame, order: str = "pos", label: str = "label") -> DataFrame:
    """Each label -1 becomes a label of its own: largest + 1, + 2, ... in order. Null labels stay as they are."""
    top = labels.agg(F.max(label)).first()[0]
    new = numbered(labels.where(F.col(label) == -1), order)
    new = new.withColumn(label, (F.lit(top or 0) + 1 + F.col("_n")).cast(labels.schema[label].dataType)).drop("_n")
    return labels.where(F.col(label).isNull() | (F.col(label) != -1)).unionByName(new)


def phenograph(vectors: DataFrame, k: int = 15, *, metric: str = "euclidean", prune: bool = False, min_size: int = 10, resolution: float = 1.0, seed: int | None = None, neighbours: str = "approximate", local_edges: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs_id, cluster; the graph a, b, w; its modularity q) of the rows of vectors, in the manner of phenograph.

    Edges lead to the k nearest other rows, weighted by the Jaccard similarity of the two neighbour sets. An edge and its
    reverse are averaged, one of them missing counting 0; prune keeps only mutual ones, as the product. Communities of that graph are numbered by size,
    the largest 0, ties by smallest obs_id. Rows of communities of at most min_size rows, and rows without an edge, are outliers:
    each gets a cluster of its own, numbered on in the order of obs_id. Repeated obs_ids are an error of the caller; an empty table gives empty ones.
    """
    if neighbours not in nn.NEIGHBOURS:
        raise ValueError(f"unknown neighbours {neighbours}")
    near = nn.NEIGHBOURS[neighbours](vectors, k + 1, metric).where("src != dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).transform(kept)  # k + 1 rows a node
    ways = nn.jaccard_edges(near, k).where("w > 0")
    both = ways.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count("*").alias("n"))
    graph = (both.where("n = 2").select("a", "b", F.col("p").alias("w")) if prune else both.select("a", "b", (F.col("s") / 2).alias("w"))).transform(kept)
    found = communities(graph.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), "louvain", resolution=resolution, seed=seed, local_edges=local_edges).transform(kept)
    sizes = found.groupBy("community").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    order = numbered(sizes.where(F.col("n") > min_size), F.desc("n"), "first").select("community", F.col("_n").cast("int").alias("label"))
    labels = vectors.select("obs_id").join(found, F.col("obs_id") == F.col("node"), "left").join(order, "community", "left").select("obs_id", F.coalesce("label", F.lit(-1)).alias("label"))
    whole = split_outliers(labels.transform(kept), "obs_id").select("obs_id", F.col("label").alias("cluster"))
    return whole, graph, nn.modularity(graph, found, resolution)


def cluster_graph(vectors: DataFrame, k: int = 15, *, metric: str = "euclidean", weighting: str = "jaccard", method: str = "louvain", resolution: float = 1.0, seed: int | None = None, neighbours: str = "approximate") -> tuple[DataFrame, DataFrame]:
    """(obs_id, cluster) and the weighted edges of the rows of vectors; neighbours: approximate or exact."""
    if neighbours not in nn.NEIGHBOURS:
        raise ValueError(f"unknown neighbours {neighbours}")
    edges = nn.weighted(nn.NEIGHBOURS[neighbours](vectors, k, metric), weighting).transform(kept)
    return communities(edges, method, resolution=resolution, seed=seed).select(F.col("node").alias("obs_id"), F.col("community").alias("cluster")), edges
