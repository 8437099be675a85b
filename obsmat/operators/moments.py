"""Means, variances and present shares of genes and of genes within clusters; implicit zeros count.

Only non-zeros are read. Their partial sums are completed with the rows that have no entry: with k non-zeros of mean m
and population variance v among n rows, mean = k m / n and M2 = k v + k (m - mean)^2 + (n - k) mean^2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmat.sources.scratch import numbered


def complete(k: Column, m: Column, v: Column, n: Column) -> tuple[Column, Column]:
    """(mean, M2) over n rows of which k have entries."""
    mean = k * m / n
    return mean, k * v + k * (m - mean) * (m - mean) + (n - k) * mean * mean


def variance(m2: Column, n: Column, ddof: int) -> Column:
    return F.when(n > ddof, m2 / (n - ddof)).otherwise(0e0)


def gene_moments(expr: DataFrame, n_obs: int | Column, *, low: float = 1.0, ddof: int = 1, back: bool = True) -> DataFrame:
    """gene, n_present (rows with x > low), mean, var; back: moments of exp(x) - 1. A null x is a missing entry, as if it were 0; an
    empty table gives an empty one."""
    expr = expr.where("x is not null")
    y = F.expm1("x") if back else F.col("x")
    n = (F.lit(n_obs) if isinstance(n_obs, int) else n_obs).cast("double")
    g = expr.groupBy("gene").agg(F.count("*").alias("k"), F.avg(y).alias("m"), F.var_pop(y).alias("v"), F.sum((F.col("x") > low).cast("long")).alias("n_present"))
    mean, m2 = complete(F.col("k"), F.col("m"), F.col("v"), n)
    return g.select("gene", "n_present", mean.alias("mean"), variance(m2, n, ddof).alias("var"))


def gene_mask(moments: DataFrame, min_cells: int = 4) -> DataFrame:
    return moments.where(F.col("n_present") >= min_cells)


def cluster_sizes(assign: DataFrame) -> DataFrame:
    return assign.groupBy("cluster").agg(F.count("*").alias("n"))


def cluster_ids(assign: DataFrame, name: str = "cluster_id") -> DataFrame:
    """obs_id and the number (int, from 1) of its cluster in the clusters' order. Rows without a cluster have no number."""
    ids = numbered(assign.select("cluster").where("cluster is not null").distinct(), "cluster").select("cluster", (F.col("_n") + 1).cast("int").alias(name))
    return assign.join(ids, "cluster", "left").select("obs_id", name)


def cluster_members(assign: DataFrame) -> DataFrame:
    """cluster, members (its obs_ids, sorted): one row a cluster, as long as the cluster is large. Null ids are left out; rows
    without a cluster are one row."""
    return assign.groupBy("cluster").agg(F.sort_array(F.collect_list("obs_id")).alias("members"))


def one_hot(assign: DataFrame, most: int = 1000) -> DataFrame:
    """obs_id and a boolean column for each cluster, named as it is in lower case; false in all for rows without a cluster. Clusters become columns,
    so their number is checked."""
    names = [r.cluster for r in assign.select("cluster").where("cluster is not null").distinct().orderBy("cluster").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} clusters")
    return assign.select("obs_id", *[F.coalesce(F.col("cluster") == c, F.lit(False)).alias(str(c).lower()) for c in names])


def cluster_stats(expr: DataFrame, assign: DataFrame, genes: DataFrame | None = None, *, low: float = 1.0) -> DataFrame:
    """cluster, gene, n, mean, present (share of x > low), var (sample variance; 0 for one row), for all clusters x genes.

    The grid of clusters and genes is small; observations are aggregated before they meet it. low must not be negative. A null x
    is a missing entry, as if it were 0; rows without a cluster count nowhere; a null cluster is left out.
    """
    expr, assign = expr.where("x is not null"), assign.where("cluster is not null")
    genes = (expr if genes is None else genes).select("gene").distinct()
    sizes = cluster_sizes(assign)
    found = expr.join(assign, "obs_id").groupBy("cluster", "gene").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.sum((F.col("x") > low).cast("long")).alias("above"))
    grid = sizes.crossJoin(F.broadcast(genes)).join(found, ["cluster", "gene"], "left").fillna(0, ["k", "above"]).fillna(0e0, ["m", "v"])
    mean, m2 = complete(F.col("k"), F.col("m"), F.col("v"), F.col("n"))
    return grid.select("cluster", "gene", "n", mean.alias("mean"), (F.col("above") / F.col("n")).alias("present"), variance(m2, F.col("n"), 1).alias("var"))


def merge_stats(stats: DataFrame, mapping: DataFrame) -> DataFrame:
    """Statistics of merged clusters from those of their parts (exact, by sums of squares). mapping: cluster, into."""
    s = stats.join(mapping, "cluster", "left").withColumn("cluster", F.coalesce("into", "cluster")).drop("into")
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    square = F.sum((F.col("n") - 1) * F.col("var") + F.col("n") * F.col("mean") * F.col("mean"))
    g = s.groupBy("cluster", "gene").agg(n.alias("n"), mean.alias("mean"), (F.sum(F.col("n") * F.col("present")) / n).alias("present"), square.alias("sq"))
    return g.select("cluster", "gene", "n", "mean", "present", F.greatest(F.lit(0e0), variance(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"), F.col("n"), 1)).alias("var"))
