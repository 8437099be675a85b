"""The clustering pipeline: one step, the recursion, the final merge and the summary."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.operators import community, hvg, merging, moments, pca
from obsmat.operators.de import DEThresholds, Stats, de_pairs_in_blocks, marker_genes
from obsmat.plans import local
from obsmat.sources.scratch import kept, written
from obsmat.sources.matrix import row_form, sample_key, select_cells, select_genes


@dataclass(frozen=True)
class OneStep:
    low: float = 1.0
    min_cells: int = 4
    max_genes: int = 3000
    n_comps: int | None = None
    pca_cells: int | None = None
    pc_solver: str = "gram"
    pc_method: str | None = "zscore"
    pc_z: float = 2.0
    max_pcs: int | None = 20
    known_threshold: float = 0.7
    k: int = 15
    metric: str = "euclidean"
    neighbours: str = "approximate"
    weighting: str = "jaccard"
    community: str = "louvain"
    resolution: float = 1.0
    thresholds: DEThresholds = field(default_factory=DEThresholds)
    de_method: str = "ebayes"
    nearest: int = 2
    n_markers: int | None = 20
    seed: int | None = None


def kept_components(ev: np.ndarray, evr: np.ndarray, o: OneStep) -> list[int]:
    """The components' numbers after the filter on variances; a few hundred numbers, so no job is needed."""
    at = np.arange(len(ev))
    if o.pc_method == "zscore":
        sd = evr.std()
        at = at[(evr - evr.mean()) / sd > o.pc_z] if sd > 0 else at[:0]
    elif o.pc_method == "elbow":
        at = at[: pca.elbow(ev)]
    elif o.pc_method is not None:
        raise ValueError(f"unknown method {o.pc_method}")
    return at.tolist()[: o.max_pcs]


def without_known(vectors: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """vectors without the components that correlate with a known mode (obs_id, mode, known)."""
    long = vectors.select("obs_id", F.posexplode("features").alias("pc", "value"))
    keep = sorted(r.pc for r in pca.filter_known(long, known, "obs_id", threshold).select("pc").collect())
    return vectors.select("obs_id", F.array(*[F.col("features")[i] for i in keep]).alias("features")) if keep else vectors.select("obs_id", F.expr("array_repeat(0D, 0)").alias("features"))


def merge_clusters(expr: DataFrame, reduced: DataFrame, assign: DataFrame, o: OneStep) -> tuple[DataFrame, set]:
    """(assign, markers) after merging small clusters in the reduced space, then alike ones by differential expression."""
    long = reduced.select("obs_id", F.posexplode("features").alias("gene", "x"))
    first = Stats.collect(moments.cluster_stats(long, assign, low=o.low))
    if len(first.labels) < 2:
        return assign, set()
    into = merging.merge_small(first.labels, first.mean, dict(zip(first.labels, first.n, strict=True)), o.thresholds.cluster_size or 0)
    assign = merging.relabel(assign, into).transform(kept)
    near = Stats.collect(moments.cluster_stats(long, assign, low=o.low))
    full = Stats.collect(moments.cluster_stats(expr, assign, low=o.thresholds.low))
    into = merging.merge_by_de(full, near, o.thresholds, k=o.nearest, method=o.de_method)
    assign = merging.relabel(assign, into).transform(kept)
    return assign, merging.pair_markers(full, o)


def onestep(expr: DataFrame, obs: DataFrame, o: OneStep, *, known: DataFrame | None = None, latent: DataFrame | None = None) -> tuple[DataFrame, set]:
    """(obs_id, cluster) and the marker genes. expr: normalised; latent: obs_id, features, instead of genes and components.

    pca_cells: components are those of a seeded sample of that many rows (all, if None); all rows are projected. pc_solver: gram
    (exact, a genes x genes matrix on the driver) or subspace (for many genes).
    """
    if latent is None:
        n = obs.count()
        chosen = hvg.highly_variable(moments.gene_moments(expr, n, low=o.low), min_cells=o.min_cells, max_genes=o.max_genes).where("highly_variable")
        genes = sorted(r.gene for r in chosen.select("gene").collect())
        none = obs.select("obs_id", F.lit(0).alias("cluster")), set()
        if len(genes) < 2 or n < 3:
            return none
        rows = obs.select("obs_id").join(row_form(select_genes(expr, chosen), genes), "obs_id", "left")
        rows = rows.select("obs_id", F.coalesce("features", F.array_repeat(F.lit(0e0), len(genes))).alias("features")).transform(kept)
        seen = rows if o.pca_cells is None else rows.orderBy(F.xxhash64(F.lit(o.seed or 0), "obs_id"), "obs_id").limit(o.pca_cells)
        if o.pc_solver == "subspace":
            values = select_genes(expr, chosen)
            values = values if o.pca_cells is None else select_cells(values, seen)
            loadings, ev, evr, mean = pca.sparse_pca(values, n if o.pca_cells is None else seen.count(), genes, 50 if o.n_comps is None else o.n_comps, seed=o.seed or 0)
        else:
            loadings, ev, evr, mean = pca.pca(seen, o.n_comps)
        keep = kept_components(ev, evr, o)
        if not keep:
            return none
        vectors = pca.project_rows(rows, loadings[:, keep], mean)
    else:
        vectors = obs.select("obs_id").join(latent.select("obs_id", "features"), "obs_id")
    if known is not None:
        vectors = without_known(vectors, known, o.known_threshold)
    vectors = vectors.transform(kept)
    width = vectors.select(F.size("features").alias("n")).first()
    if width is None or width.n == 0:
        return obs.select("obs_id", F.lit(0).alias("cluster")), set()
    assign, _ = community.cluster_graph(vectors, min(o.k, width.n) if latent is None else o.k, metric=o.metric, neighbours=o.neighbours, weighting=o.weighting, method=o.community, resolution=o.resolution, seed=o.seed)
    return merge_clusters(expr, vectors, assign.transform(kept), o)


def iterate(expr: DataFrame, obs: DataFrame, o: OneStep, *, min_samples: int = 4, known: DataFrame | None = None, latent: DataFrame | None = None, step=onestep, local_values: int = 4_000_000) -> tuple[DataFrame, set]:
    """(obs_id, path) by splitting again and again; a leaf has one cluster or fewer rows than min_samples. Ids stay, so rows never
    change places.

    A level is worked at once. All its groups with at most local_values values of the matrix are groups of one grouped job,
    each of which goes on to its leaves; larger groups are split by jobs of their own, and what is left of the matrix is
    written once a level, by group. Paths are a column; the driver holds a row for each group of a level. Known modes, and any other
    step than `onestep`, are worked by jobs alone. Rows without values are rows of zeros; null ids are ignored.
    """
    in_tasks = known is None and step is onestep
    each = expr.groupBy("obs_id").agg(F.count("*").alias("k"))
    members = obs.where("obs_id is not null").select("obs_id").distinct().join(each, "obs_id", "left").select("obs_id", F.lit("0").alias("path"), F.coalesce("k", F.lit(0)).alias("k")).transform(kept)
    matrix, done, markers = expr, [], set()
    while True:
        sizes = [(r.path, r.n, r.k) for r in members.groupBy("path").agg(F.count("*").alias("n"), F.sum("k").alias("k")).orderBy("path").collect()]
        kind = {p: "leaf" if n < min_samples else "small" if in_tasks and k <= local_values else "large" for p, n, k in sizes}
        if not kind:
            break
        kinds = members.sparkSession.createDataFrame(list(kind.items()), "path string, kind string")
        members = members.join(F.broadcast(kinds), "path")
        done.append(members.where("kind = 'leaf'").select("obs_id", "path"))
        mine = matrix.join(members.select("obs_id", "path", "kind"), "obs_id")
        if "small" in kind.values():
            ended = _small_groups(mine.where("kind = 'small'"), members.where("kind = 'small'"), latent, o, min_samples).transform(kept)
            done.append(ended.where("obs_id is not null").select("obs_id", "path"))
            markers |= {r.marker for r in ended.where("obs_id is null").select("marker").distinct().collect()}
        large, children = [p for p, what in kind.items() if what == "large"], []
        split = written(mine.where("kind = 'large'").drop("kind"), "path") if large else None
        for path in large:
            part = members.where(F.col("path") == path).select("obs_id", "k")
            assign, found = step(split.where(F.col("path") == path).drop("path"), part.select("obs_id"), o, known=known, latent=latent)
            assign = assign.transform(kept)
            if assign.select("cluster").distinct().limit(2).count() < 2:
                done.append(part.select("obs_id", F.lit(path).alias("path")))
                continue
            markers |= found
            children.append(part.join(assign, "obs_id").select("obs_id", F.concat(F.lit(f"{path}."), F.col("cluster").cast("string")).alias("path"), "k"))
        if not children:
            break
        members, matrix = reduce(DataFrame.unionByName, children).transform(kept), split.drop("path")
    if not done:
        return obs.select("obs_id", F.lit("0").alias("path")).limit(0), markers
    return reduce(DataFrame.unionByName, done), markers


def _small_groups(values: DataFrame, members: DataFrame, latent: DataFrame | None, o: OneStep, min_samples: int) -> DataFrame:
    """obs_id, path, marker: a row for each member with its path, and one without obs_id for each marker."""
    rows = members.select("path", "obs_id", F.xxhash64(F.lit(o.seed or 0), "obs_id").alias("_o"))
    if latent is not None:
        rows = rows.join(latent.select("obs_id", "features"), "obs_id")
    kind = members.schema["obs_id"].dataType.simpleString()

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = pa.schema([("obs_id", left.schema.field("obs_id").type), ("path", pa.string()), ("marker", pa.string())])
        if not left.num_rows:
            return out.empty_table()
        left = left.sort_by("obs_id")
        ids = left.column("obs_id").combine_chunks()
        genes = right.column("gene").combine_chunks().dictionary_encode()
        names = genes.dictionary.to_pylist()
        row = pc.index_in(right.column("obs_id").combine_chunks(), value_set=ids).to_numpy()
        vectors = np.stack([np.asarray(v) for v in left.column("features").to_numpy()]) if "features" in left.column_names else None
        g = local.Group(ids.to_numpy(zero_copy_only=False), names, row.astype(np.int64), genes.indices.to_numpy(zero_copy_only=False).astype(np.int64), right.column("x").to_numpy().astype(float), left.column("_o").to_numpy(), vectors)
        paths, markers = local.iterate(g, left.column("path")[0].as_py(), o, min_samples)
        markers = sorted(map(str, markers))
        return pa.table([pa.concat_arrays([ids, pa.nulls(len(markers), ids.type)]), pa.array(paths + [None] * len(markers), pa.string()), pa.array([None] * len(paths) + markers, pa.string())], schema=out)

    other = values.select(F.col("path").alias("in_path"), "obs_id", F.col("gene").cast("string").alias("gene"), "x")
    return rows.groupBy("path").cogroup(other.groupBy("in_path")).applyInArrow(work, f"obs_id {kind}, path string, marker string")


def sample_clusters(assign: DataFrame, n: int = 20, seed: int = 123) -> DataFrame:
    """Up to n rows of each cluster, without replacement, in a seeded order."""
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(sample_key(F.col("obs_id"), seed), "obs_id"))
    return assign.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def final_merge(expr: DataFrame, assign: DataFrame, markers: set, o: OneStep, *, n_samples: int = 20, seed: int = 123, known: DataFrame | None = None) -> tuple[DataFrame, set]:
    """Components of a sample of each cluster over the marker genes; then all rows are projected and clusters merged. Without
    markers, as a recursion that splits nothing gives them, and for fewer than two clusters, nothing is merged."""
    genes = sorted(markers)
    if not genes or assign.select("cluster").distinct().limit(2).count() < 2:
        return assign.select("obs_id", "cluster"), set()
    marked = expr.where(F.col("gene").isin(genes))
    rows = assign.select("obs_id").join(row_form(marked, genes), "obs_id", "left")
    rows = rows.select("obs_id", F.coalesce("features", F.array_repeat(F.lit(0e0), len(genes))).alias("features")).transform(kept)
    loadings, ev, evr, mean = pca.pca(rows.join(sample_clusters(assign, n_samples, seed).select("obs_id"), "obs_id", "left_semi"), o.n_comps)
    keep = kept_components(ev, evr, o) or list(range(min(2, len(ev))))
    vectors = pca.project_rows(rows, loadings[:, keep], mean)
    if known is not None:
        vectors = without_known(vectors, known, o.known_threshold)
    return merge_clusters(expr, vectors.transform(kept), assign, o)


def summarize(expr: DataFrame, assign: DataFrame, thresholds: DEThresholds, method: str = "ebayes") -> tuple[DataFrame, DataFrame]:
    """(differential expression of all pairs, linkage of the means)."""
    stats = moments.cluster_stats(expr, assign, low=thresholds.low).transform(kept)
    return de_pairs_in_blocks(stats, thresholds, method), merging.hclust(stats)


def markers(expr: DataFrame, assign: DataFrame, thresholds: DEThresholds, n_markers: int = 20, method: str = "ebayes") -> DataFrame:
    stats = moments.cluster_stats(expr, assign, low=thresholds.low)
    return marker_genes(de_pairs_in_blocks(stats.transform(kept), thresholds, method), n_markers)
