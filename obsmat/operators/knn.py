"""Nearest neighbours by blocks, and the weighted graphs made of them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("euclidean", "angular", "manhattan", "hamming", "dot")


def distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Rows of q against rows of p; smaller is nearer (dot: the negative product)."""
    if metric == "euclidean":
        return np.sqrt(np.maximum(0, (q * q).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * q @ p.T))
    if metric == "dot":
        return -(q @ p.T)
    if metric == "angular":
        norm = lambda x: x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None]
        return np.sqrt(np.maximum(0, 2 - 2 * norm(q) @ norm(p).T))
    out = np.zeros((len(q), len(p)))
    for k in range(q.shape[1]):
        gap = q[:, k, None] - p[None, :, k]
        out += np.abs(gap) if metric == "manhattan" else gap != 0
    return out


def exact_distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Row by row, from differences: near rows lose no digits, and a pair's distance doesn't depend on its batch."""
    if metric == "angular":
        q, p = (x / np.maximum(1e-300, np.linalg.norm(x, axis=-1, keepdims=True)) for x in (q, p))
    if metric == "dot":
        return -(q * p).sum(-1)
    gap = q - p
    return np.abs(gap).sum(-1) if metric == "manhattan" else (gap != 0).sum(-1).astype(float) if metric == "hamming" else np.sqrt((gap * gap).sum(-1))


class _Bounds:
    """Lower bounds of the distances between rows of q and of p, cheap to work out for a block of pairs: `below` gives the
    pairs that may be nearer than each query's limit. A bound allows for its own rounding, so no nearer pair is left out."""

    def __init__(self, q: np.ndarray, p: np.ndarray, metric: str):
        self.metric, width = metric, q.shape[1]
        if metric == "manhattan":  # whole steps, whose sum fits 16 bits (32 in more dimensions); cutting off far values only lowers a bound
            kind = np.uint16 if width <= 512 else np.uint32
            self.most = np.iinfo(kind).max
            levels = self.most // max(1, width)
            low, mid, high = np.quantile(p, [0.001, 0.5, 0.999], axis=0)
            low, high = mid - 2 * (mid - low), mid + 2 * (high - mid)
            self.step = max(1e-300, float((high - low).max(initial=0.0)) / levels)
            steps = lambda x: np.ascontiguousarray(np.rint(np.clip((np.clip(x, low, high) - low) / self.step, 0, levels)).astype(kind).T)
            self.q, self.p, self.shape, self.width = steps(q), steps(p), (64, 1024), width
            self.sums = self.q.sum(0, dtype=kind), self.p.sum(0, dtype=kind)
        elif metric == "hamming":
            self.q, self.p, self.shape = np.ascontiguousarray(q.T), np.ascontiguousarray(p.T), (64, 1024)
        else:
            if metric == "angular":
                q, p = (x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None] for x in (q, p))
            middle = p.mean(0) if metric == "euclidean" else np.zeros(width)  # far from the origin, squares would lose digits
            self.q, self.p = (x - middle for x in (q, p))
            self.qq, self.pp = ((x * x).sum(1) for x in (self.q, self.p))
            self.q, self.p, self.shape = self.q.astype(np.float32), self.p.astype(np.float32), (256, 2048)
            self.slack = 4 * (width + 16) * np.finfo(np.float32).eps * (self.qq + self.pp.max(initial=0.0))

    def block(self, i: slice, j: slice) -> np.ndarray:
        """Numbers in the order of the bounds, for the queries i and the points j."""
        if self.metric == "hamming":
            out = np.zeros((len(self.q[0, i]), len(self.p[0, j])), np.int32)
            for x, y in zip(self.q[:, i], self.p[:, j], strict=True):
                out += x[:, None] != y[None, :]
            return out
        if self.metric == "manhattan":  # |x - y| is twice the larger less both; sums of that wrap round to the right number
            q, p = self.q[:, i], self.p[:, j]
            out, larger = (np.zeros((q.shape[1], p.shape[1]), q.dtype) for _ in range(2))
            for x, y in zip(q, p, strict=True):
                np.maximum(x[:, None], y[None, :], out=larger)
                np.add(out, larger, out=out)
            return out + out - self.sums[0][i, None] - self.sums[1][None, j]
        product = self.q[i] @ self.p[j].T
        return -product if self.metric == "dot" else self.pp[j].astype(np.float32)[None, :] - 2 * product

    def limit(self, i: slice, far: np.ndarray) -> np.ndarray:
        """The least number of `block` from which on a pair of query i isn't nearer than far, for each query."""
        if self.metric == "manhattan":
            return np.minimum(np.floor(far / self.step * (1 + 1e-9)) + self.width + 1, self.most).astype(self.q.dtype)
        if self.metric == "hamming":
            return far
        far = far + self.slack[i] if self.metric == "dot" else far * far * (1 + 1e-9) - self.qq[i] + self.slack[i]
        return np.nextafter(far.astype(np.float32), np.float32(np.inf))


def nearest_rows(q: np.ndarray, p: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of p, distances, neighbours each) of each row of q, flat, by distance and then by row number.

    Points pass by in blocks. Of a block's pairs only those whose lower bound is below the query's k-th distance so far are worked
    out exactly. Of equal points only the first k can be among the nearest, so others are left out before.
    """
    n = min(k, len(p))
    at = _first_copies(p, n)
    p = p[at]
    far_, to_ = np.full((len(q), n), np.inf), np.full((len(q), n), len(at))
    if metric == "manhattan" and q.shape[1] > np.iinfo(np.uint16).max or not (np.abs(q).max(initial=0.0) < 1e15 and np.abs(p).max(initial=0.0) < 1e15):
        for i in range(len(q)):  # infinite, missing or huge numbers have no bounds
            d = exact_distances(q[i], p, metric)
            to_[i] = np.argsort(d, kind="stable")[:n]
            far_[i] = d[to_[i]]
        return at[to_.ravel()], far_.ravel(), n
    bounds = _Bounds(q, p, metric)
    rows, wide = bounds.shape
    for i in range(0, len(q), rows):
        far, to, mine = far_[i : i + rows], to_[i : i + rows], slice(i, i + rows)
        for j in range(0, len(p), wide):
            b = bounds.block(mine, slice(j, j + wide))
            if j == 0 and n < b.shape[1]:  # the distances of any n points are limits
                some = np.argpartition(b, n - 1, axis=1)[:, :n]
                most = exact_distances(q[mine][:, None, :], p[some], metric).max(1)
            else:
                most = far[:, -1] - (metric == "hamming")  # whole numbers; equally far points come later in the order
            r, c = np.divmod(np.flatnonzero(b <= bounds.limit(mine, most)[:, None]), b.shape[1])
            if not len(r):
                continue
            d = np.concatenate([exact_distances(q[i + r[s : s + 16384]], p[j + c[s : s + 16384]], metric) for s in range(0, len(r), 16384)])
            good = d < far[r, -1]
            r, c, d = r[good], c[good] + j, d[good]
            if not len(r):
                continue
            open_ = np.unique(r)
            row, dist, col = np.concatenate([np.repeat(open_, n), r]), np.concatenate([far[open_].ravel(), d]), np.concatenate([to[open_].ravel(), c])
            order = np.lexsort((col, dist, row))
            start = np.searchsorted(row[order], open_)
            best = order[start[:, None] + np.arange(n)]
            far[open_], to[open_] = dist[best], col[best]
    return at[to_.ravel()], far_.ravel(), n


def _first_copies(p: np.ndarray, n: int) -> np.ndarray:
    """The rows of p, in order, of which fewer than n rows before are the same."""
    if not len(p) or not p.shape[1]:
        return np.arange(min(n, len(p)))
    whole = np.ascontiguousarray(p + 0.0).view(np.dtype((np.void, p.shape[1] * p.itemsize))).ravel()
    order = np.argsort(whole, kind="stable")
    new = np.append(True, whole[order][1:] != whole[order][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))
    return np.sort(order[np.arange(len(p)) - first < n])


def nearest(left: pa.Table, right: pa.Table, k: int, metric: str) -> tuple:
    """(src, dst, distance, neighbours each) of each row of left, flat, by distance and dst, among the rows of right (obs_id, features)."""
    q, p = (np.stack([np.asarray(v, float) for v in t.column("features").to_numpy()]) for t in (left, right))
    order = np.argsort(right.column("obs_id").to_numpy(zero_copy_only=False), kind="stable")
    ids = right.column("obs_id").combine_chunks().take(pa.array(order))
    to, far, n = nearest_rows(q, p[order], k, metric)
    return left.column("obs_id").combine_chunks(), ids.take(pa.array(to)), far, n


def block_count(n: int, width: int, block_rows: int, block_mb: int) -> int:
    """Blocks of n rows: of block_rows rows, or larger, up to block_mb, where that would be more than eight."""
    most = (block_mb << 20) // (8 * max(1, width))
    return max(1, math.ceil(n / max(block_rows, min(math.ceil(n / 8), most))))


def knn(vectors: DataFrame, k: int, metric: str = "euclidean", *, block_rows: int = 4096, block_mb: int = 64, n_rows: int | None = None) -> DataFrame:
    """src, dst, rank (from 1), distance: the k nearest rows of each row, itself included; ties by dst.

    Exact. Rows are dealt into blocks; each two blocks are one task, where the rows of either find their best k in the other, and a row's
    best of all blocks are ranked again. The shuffle is rows x blocks, once for both ways, the memory two blocks. There are eight blocks
    (fewer of less than 1,024 rows) until one would have both more than block_rows rows and more than block_mb; so up to there the shuffle grows as
    the rows do. Numbers that are floats travel as such. For very many rows use approximate_knn.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    x = F.col("features")
    floats = F.min(x.cast("array<float>").cast("array<double>") == x) if vectors.schema["features"].dataType.simpleString() == "array<double>" else F.lit(False)
    told = vectors.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width"), floats.alias("floats")).first()
    n = told.n if n_rows is None else n_rows
    blocks = max(block_count(n, told.width or 1, block_rows, block_mb), min(8, math.ceil(n / 1024)))
    mixed = blocks * (blocks - 1) // 2  # pairs of two blocks come first, as they take twice as long
    kind = vectors.schema["obs_id"].dataType.simpleString()
    dealt = vectors.select("obs_id", (x.cast("array<float>") if told.floats else x).alias("features"), F.pmod(F.xxhash64("obs_id"), F.lit(blocks)).cast("int").alias("block"))
    both = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    pair = F.when(low == high, low + F.lit(mixed)).otherwise((high * (high - 1) / 2).cast("int") + low)
    sides = both.select(pair.alias("pair"), (F.col("block") < F.col("other")).alias("lower"), "obs_id", "features").repartitionById(mixed + blocks, "pair")

    def best(key: tuple, t: pa.Table) -> pa.Table:
        item = t.schema.field("obs_id").type
        schema = pa.schema([("src", item), ("dst", pa.list_(item)), ("distance", pa.list_(pa.float64()))])
        a, b = t.filter(t.column("lower")), t.filter(pc.invert(t.column("lower")))
        out = []
        for left, right in [(t, t)] if key[0].as_py() >= mixed else [(a, b), (b, a)]:
            if left.num_rows and right.num_rows:
                src, dst, far, n = nearest(left, right, k, metric)
                at = pa.array(np.arange(left.num_rows + 1) * n, pa.int32())
                out.append(pa.table([src, pa.ListArray.from_arrays(at, dst), pa.ListArray.from_arrays(at, pa.array(far))], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    found = sides.groupBy("pair").applyInArrow(best, f"src {kind}, dst array<{kind}>, distance array<double>")
    parts = found.groupBy("src").agg(F.collect_list(F.struct("distance", "dst")).alias("parts"))  # a row for each block
    near = F.flatten(F.transform("parts", lambda p: F.arrays_zip(p["distance"].alias("distance"), p["dst"].alias("dst"))))
    whole = parts.select("src", F.posexplode(F.slice(F.sort_array(near), 1, k)).alias("rank", "one"))
    return whole.select("src", "one.dst", "one.distance", (F.col("rank") + 1).alias("rank"))


def prepared(x: np.ndarray, metric: str, longest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(queries, points) of the rows as a tree splits them, so that near means near in a straight line: angular rows have length
    1; for products points get one more number that makes all of them `longest` long, queries get 0."""
    if metric == "angular":
        x = x / np.maximum(1e-300, np.linalg.norm(x, axis=1))[:, None]
    if metric != "dot":
        return x, x
    rest = np.sqrt(np.maximum(0.0, longest * longest - (x * x).sum(1)))
    return np.hstack([x, np.zeros((len(x), 1))]), np.hstack([x, rest[:, None]])


class Forest:
    """Random-projection trees, each complete and of the same depth: node i has the children 2i + 1 and 2i + 2, and the hyperplane
    that halves the sample's points at it, across the line between two of their means."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        self.depth, n = depth, (1 << depth) - 1
        self.normals = np.zeros((trees, n, sample.shape[1]), np.float32)
        self.middles = np.zeros((trees, n), np.float32)
        for t in range(trees):
            rng, level = np.random.default_rng((seed, t)), [sample]
            for i in range(n):
                points = level[i]
                level[i] = None
                across = self._across(points, rng)
                self.normals[t, i] = across / max(1e-30, np.linalg.norm(across))
                along = points.astype(np.float32) @ self.normals[t, i]
                self.middles[t, i] = np.median(along) if len(along) else 0
                tied = np.abs(along - self.middles[t, i]) <= 1e-5 * np.linalg.norm(points, axis=1)
                right = np.where(tied, rng.random(len(points)) < 0.5, along > self.middles[t, i])
                level += [points[~right], points[right]]

    @staticmethod
    def _across(points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        if len(points) < 2:
            return rng.normal(size=points.shape[1])
        seen = points[rng.integers(0, len(points), min(len(points), 256))]
        a, b = seen[rng.integers(0, len(seen), 2)]
        for _ in range(4):
            near = ((seen - a) ** 2).sum(1) < ((seen - b) ** 2).sum(1)
            if near.all() or not near.any():
                return rng.normal(size=points.shape[1])
            a, b = seen[near].mean(0), seen[~near].mean(0)
        return a - b

    def _down(self, t: int, x: np.ndarray, node: np.ndarray, coin: np.ndarray, margins: np.ndarray | None = None) -> np.ndarray:
        """The leaf (from 0) of each row that starts at its node. A row on the hyperplane itself, as copies that a median falls
        on are, goes where its coin says; so copies spread."""
        node, first = node.copy(), (1 << self.depth) - 1
        none = 1e-5 * np.linalg.norm(x, axis=1)
        for level in range(self.depth):
            open_ = node < first
            at = np.where(open_, node, 0)
            margin = np.einsum("ij,ij->i", x, self.normals[t, at]) - self.middles[t, at]
            side = np.where(np.abs(margin) <= none, coin >> level & 1, margin > 0)
            if margins is not None:
                margins[:, level] = np.abs(margin)
            node = np.where(open_, 2 * node + 1 + side, node)
        return node - first

    def leaves(self, x: np.ndarray, coin: np.ndarray, probes: int = 1):
        """(tree, leaf of each row) for each tree and probe. The first probe is the row's own leaf, the others turn the
        decisions with the least margins."""
        x, root = x.astype(np.float32), np.zeros(len(x), np.int64)
        for t in range(len(self.normals)):
            margins = np.zeros((len(x), self.depth))
            home = self._down(t, x, root, coin, margins)
            yield t, home
            order = np.argsort(margins, axis=1, kind="stable")
            for p in range(min(probes - 1, self.depth)):
                level = order[:, p]
                up = self.depth - level - 1  # from a leaf to the child of the decision
                child = ((home + (1 << self.depth)) >> up) - 1
                yield t, self._down(t, x, np.where(child % 2 == 0, child - 1, child + 1), coin)


def approximate_knn(vectors: DataFrame, k: int, metric: str = "euclidean", *, trees: int = 6, probes: int = 4, shard_rows: int = 4096, sample_rows: int = 1 << 18, index_mb: int = 256, seed: int = 1, n_rows: int | None = None) -> DataFrame:
    """As knn, over the rows that share a leaf of a forest of random-projection trees; exact where one leaf holds all rows.

    The trees are built on a seeded sample of sample_rows rows at most (16 for each leaf where that is fewer) and every row is put into a leaf of
    each tree. A row's neighbours are sought in its own leaf and in the probes - 1 leaves on the other side of its least certain
    decisions, exactly within each. So the shuffle is rows x trees x (1 + probes), whatever their number. Trees are broadcast: their
    depth is bounded by index_mb; beyond it leaves grow instead. Copies of one vector spread over leaves.
    Hamming and manhattan split as euclidean does. Null vectors are an error as in knn; an empty table gives an empty one.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    n = vectors.count() if n_rows is None else n_rows
    kind = vectors.schema["obs_id"].dataType.simpleString()
    depth = max(0, math.ceil(math.log2(max(1, n) / shard_rows)))
    order = vectors.select("features", F.xxhash64(F.lit(seed), "obs_id").alias("_o")).orderBy("_o")
    longest = 0.0
    if metric == "dot" and n:
        square = F.aggregate("features", F.lit(0e0), lambda a, v: a + v * v)
        longest = math.sqrt(vectors.agg(F.max(square)).first()[0] or 0.0)
    seen = [r.features for r in order.limit(max(1, min(sample_rows, 16 << depth))).select("features").collect()] if n else []
    width = len(seen[0]) + (metric == "dot") if seen else 1
    depth = min(depth, max(0, int(math.log2(max(1, (index_mb << 20) // (4 * trees * width))))))
    forest = Forest(prepared(np.array(seen, float).reshape(len(seen), -1), metric, longest)[1] if seen else np.zeros((0, 1)), trees if depth else 1, depth, seed)
    shared = vectors.sparkSession.sparkContext.broadcast(forest)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v) for v in b.column(1).to_numpy(zero_copy_only=False)])
            coin = b.column(2).to_numpy(zero_copy_only=False)
            queries, points = prepared(x, metric, longest)
            home = np.ones(len(x), bool)
            ways = [(t, leaf, home) for t, leaf in shared.value.leaves(points, coin)] + [(t, leaf, ~home) for t, leaf in shared.value.leaves(queries, coin, probes)]
            for t, leaf, is_home in ways:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(leaf), pa.array(is_home), b.column(0), b.column(1)], ["tree", "leaf", "home", "obs_id", "features"])

    def best(t: pa.Table) -> pa.Table:
        out = pa.schema([("src", t.schema.field("obs_id").type), ("near", pa.list_(pa.struct([("distance", pa.float64()), ("dst", t.schema.field("obs_id").type)])))])
        home = t.column("home").to_numpy(zero_copy_only=False)
        left, right = t.filter(pa.array(~home)), t.filter(pa.array(home))
        if not left.num_rows or not right.num_rows:
            return out.empty_table()
        src, dst, far, n = nearest(left, right, k, metric)
        near = pa.StructArray.from_arrays([pa.array(far), dst.cast(out.field("near").type.value_type[1].type)], ["distance", "dst"])
        return pa.table([src, pa.ListArray.from_arrays(pa.array(np.arange(left.num_rows + 1) * n, pa.int32()), near)], schema=out)

    rows = vectors.select("obs_id", "features", F.xxhash64("obs_id", F.lit(seed)).alias("coin"))
    dealt = rows.mapInArrow(deal, f"tree int, leaf long, home boolean, obs_id {kind}, features array<double>")
    found = dealt.groupBy("tree", "leaf").applyInArrow(best, f"src {kind}, near array<struct<distance: double, dst: {kind}>>")
    whole = found.groupBy("src").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))  # a row for each tree and probe
    return whole.select("src", F.posexplode("near").alias("rank", "one")).select("src", "one.dst", "one.distance", (F.col("rank") + 1).alias("rank"))


NEIGHBOURS = {"exact": knn, "approximate": approximate_knn}


def uniform_edges(neighbours: DataFrame) -> DataFrame:
    return neighbours.select("src", "dst", F.lit(1e0).alias("w"))


def jaccard_edges(neighbours: DataFrame, k: int | None = None) -> DataFrame:
    """src, dst, w = shared / (2k - shared) of the neighbour sets. A set has k members, so the joins carry k ids a row."""
    sets = neighbours.groupBy("src").agg(F.collect_set("dst").alias("set"))
    a, b = sets.select("src", F.col("set").alias("sa")), sets.select(F.col("src").alias("dst"), F.col("set").alias("sb"))
    both = neighbours.select("src", "dst").join(a, "src").join(b, "dst", "left")
    shared = F.coalesce(F.size(F.array_intersect("sa", "sb")), F.lit(0))
    return both.select("src", "dst", (shared / (F.lit(2 * k) - shared if k else F.size("sa") + F.coalesce(F.size("sb"), F.lit(0)) - shared)).alias("w"))


WEIGHTS = {"jaccard": jaccard_edges, "uniform": uniform_edges}


def weighted(neighbours: DataFrame, method: str) -> DataFrame:
    if method not in WEIGHTS:
        raise ValueError(f"unknown weighting {method}")
    return WEIGHTS[method](neighbours)


def undirected(edges: DataFrame, reciprocal: str = "collapse") -> DataFrame:
    """a <= b, w: an edge and its reverse are one (collapse: the larger weight) or add up (sum)."""
    merge = {"collapse": F.max, "sum": F.sum}[reciprocal]
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(merge("w").alias("w"))


def modularity(graph: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row q of the undirected graph (a, b, w) under partition (node, community); self-loops count twice in degrees."""
    pa_, pb = partition.select(F.col("node").alias("a"), F.col("community").alias("ca")), partition.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = graph.join(pa_, "a").join(pb, "b")
    ends = e.select(F.col("ca").alias("c"), "w", F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0e0).alias("inside")).unionByName(e.select(F.col("cb").alias("c"), "w", F.lit(0e0).alias("inside")))
    each = ends.groupBy("c").agg(F.sum("w").alias("degree"), F.sum("inside").alias("inside"))
    # inside over m less resolution times (degree over 2m) squared, with the sum of degrees being 2m
    total = each.agg(F.sum("degree").alias("t"), F.sum("inside").alias("i"), F.sum(F.col("degree") * F.col("degree")).alias("dd"))
    return total.select((2 * F.col("i") / F.col("t") - resolution * F.col("dd") / (F.col("t") * F.col("t"))).alias("q"))
