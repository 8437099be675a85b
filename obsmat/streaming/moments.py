"""Structured Streaming counterparts: running moments of genes, and normalising and projecting whole rows as they come."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmat.operators.moments import complete, variance
from obsmat.operators.pca import project_rows


def running_moments(expr: DataFrame, n_obs: int, ddof: int = 1) -> DataFrame:
    """gene, mean, var of what has come so far; for output mode update or complete."""
    g = expr.groupBy("gene").agg(F.count("*").alias("k"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    mean, m2 = complete(F.col("k"), F.col("m"), F.col("v"), F.lit(float(n_obs)))
    return g.select("gene", mean.alias("mean"), variance(m2, F.lit(float(n_obs)), ddof).alias("var"))


def normalize_rows(rows: DataFrame, target_sum: float = 1e6) -> DataFrame:
    """obs_id, features of counts to log counts per target; stateless, so it runs on streams."""
    total = F.aggregate("features", F.lit(0e0), lambda a, v: a + v)
    return rows.withColumn("_t", total).select("obs_id", F.transform("features", lambda v: F.when(F.col("_t") > 0, F.log1p(v * target_sum / F.col("_t"))).otherwise(0e0)).alias("features"))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window, user_id, gene (event type), count: a matrix for each time window, closed by the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return e.groupBy(F.window(time, width), F.col("user_id").alias("obs_id"), F.col("event_type").alias("gene")).agg(F.sum("value").alias("count"))


def running_cluster_moments(expr: DataFrame, low: float = 1.0) -> DataFrame:
    """cluster, gene, k (values so far), mean, m2 (sum of squared distances from it), above (values over low) of a stream of
    (cluster, gene, x), kept by key and merged from batch to batch; for output mode update or complete. Null x are missing values."""
    g = expr.where("x is not null").groupBy("cluster", "gene").agg(F.count("*").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("v"), F.sum((F.col("x") > low).cast("long")).alias("above"))
    return g.select("cluster", "gene", "k", "mean", (F.col("k") * F.col("v")).alias("m2"), "above")


def with_sizes(running: DataFrame, sizes: DataFrame) -> DataFrame:
    """cluster, gene, n, mean, present, var, as moments.cluster_stats has them, of what running_cluster_moments holds and the
    clusters' sizes (cluster, n): values that haven't come are zeros. Clusters and genes without any value have no row."""
    both = running.join(F.broadcast(sizes), "cluster")
    n = F.col("n").cast("double")
    mean, m2 = complete(F.col("k"), F.col("mean"), F.col("m2") / F.col("k"), n)
    return both.select("cluster", "gene", "n", mean.alias("mean"), (F.col("above") / n).alias("present"), variance(m2, n, 1).alias("var"))


def project_stream(rows: DataFrame, loadings: np.ndarray, mean: np.ndarray | None = None, target_sum: float | None = None) -> DataFrame:
    """obs_id, features of rows (obs_id, features) as they come, in the space of a model that has been fitted before; counts are
    normalised first where target_sum is given. Stateless."""
    return project_rows(rows if target_sum is None else normalize_rows(rows, target_sum), loadings, mean)


def late_rows(query) -> int:
    """How many rows of a streaming query came after the watermark had passed them, over the progress that it remembers."""
    return sum(int(s.numRowsDroppedByWatermark) for p in query.recentProgress for s in p.stateOperators)
