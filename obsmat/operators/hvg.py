"""Highly variable genes: residual dispersion over a local fit on the mean, robust z-scores, false discovery rate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmat.functions.multitest import bh_array
from obsmat.functions.special import QUARTILE_SPAN, normal_tail


def dispersion(moments: DataFrame) -> DataFrame:
    """moments with log_mean and dispersion (of the whole mean and variance)."""
    return moments.withColumns({"log_mean": F.log1p("mean"), "dispersion": F.log1p(F.col("var") / (F.col("mean") + 1e-10))})


def robust_z(df: DataFrame, column: str, out: str = "z") -> DataFrame:
    """Distance from the quartiles' middle in units of the normal's quartile span."""
    q = df.agg(F.percentile(column, 0.25).alias("_lo"), F.percentile(column, 0.75).alias("_hi"))  # one row
    spread = (F.col("_hi") - F.col("_lo")) / QUARTILE_SPAN
    return df.crossJoin(F.broadcast(q)).withColumn(out, F.when(spread != 0, (F.col(column) - (F.col("_lo") + F.col("_hi")) / 2) / F.when(spread != 0, spread))).drop("_lo", "_hi")


def robust_z_array(x: np.ndarray) -> np.ndarray:
    lo, hi = np.percentile(x, [25, 75])
    return (x - (lo + hi) / 2) / ((hi - lo) / QUARTILE_SPAN)


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.75, degree: int = 2, knots: int = 200) -> np.ndarray:
    """Local polynomial fit at each x, with tricube weights over the nearest span of points. It is fitted at the different x,
    at most at `knots` of them evenly spread over their ranks, and joined between knots by cubics of the fits' slopes."""
    n, at = len(x), np.unique(x)
    if not n:
        return np.zeros(0)
    q = min(n, max(degree + 1, int(np.floor(n * span))))
    at = at[np.unique(np.linspace(0, len(at) - 1, min(len(at), knots)).astype(int))]
    value, slope = np.empty(len(at)), np.zeros(len(at))
    for i, center in enumerate(at):
        d = np.abs(x - center)
        width = np.partition(d, q - 1)[q - 1]
        w = np.clip(1 - (d / width) ** 3, 0, None) ** 3 if width > 0 else (d == 0).astype(float)
        near = np.flatnonzero(w > 0)
        basis = np.vander(x[near] - center, degree + 1, increasing=True)
        root = np.sqrt(w[near])
        fit = np.linalg.lstsq(basis * root[:, None], y[near] * root, rcond=None)[0]
        value[i], slope[i] = fit[0], fit[1] if degree else 0.0
    if len(at) == 1:
        return np.full(n, value[0])
    k = np.clip(np.searchsorted(at, x, side="right") - 1, 0, len(at) - 2)
    h = at[k + 1] - at[k]
    t = (x - at[k]) / h
    return (1 + 2 * t) * (1 - t) ** 2 * value[k] + t * (1 - t) ** 2 * h * slope[k] + t * t * (3 - 2 * t) * value[k + 1] - t * t * (1 - t) * h * slope[k + 1]


def variable_genes(genes: list, n_present: np.ndarray, log_mean: np.ndarray, dispersion_: np.ndarray, min_cells: int = 4, max_genes: int = 3000) -> tuple[dict, dict, set]:
    """(z of the dispersion, adjusted p of the residual over the local fit, the highly variable ones) of genes in at least
    min_cells rows: the first max_genes by (p, z, name) with a p under 1."""
    on = np.flatnonzero(n_present >= min_cells)
    if not len(on):
        return {}, {}, set()
    names, d = [genes[i] for i in on], dispersion_[on]
    z = robust_z_array(d)
    adj = bh_array(normal_tail(robust_z_array(d - loess(log_mean[on], d))))
    order = [i for i in np.lexsort((np.array(names).astype(str), -z, adj)) if adj[i] < 1][:max_genes]
    return dict(zip(names, z.tolist(), strict=True)), dict(zip(names, adj.tolist(), strict=True)), {names[i] for i in order}


def highly_variable(moments: DataFrame, *, min_cells: int = 4, max_genes: int = 3000, most: int = 200_000) -> DataFrame:
    """gene, z (of the dispersion), p_adj (of the residual over the local fit), highly_variable for every gene of moments.

    The first max_genes by (p_adj, z) with a p_adj under 1 are highly variable; genes in fewer than min_cells rows have nulls
    and are not. The gene table is fitted on the driver: genes are few (most), more raise an error.
    """
    spark = moments.sparkSession
    p = dispersion(moments).select("gene", "n_present", "log_mean", "dispersion").limit(most + 1).toPandas().sort_values("gene").reset_index(drop=True)
    if len(p) > most:
        raise ValueError(f"more than {most} genes")
    schema = f"gene {moments.schema['gene'].dataType.simpleString()}, z double, p_adj double, highly_variable boolean"
    genes = p.gene.tolist()
    z, adj, top = variable_genes(genes, p.n_present.to_numpy(), p.log_mean.to_numpy(float), p.dispersion.to_numpy(float), min_cells, max_genes)
    return spark.createDataFrame([(g, z.get(g), adj.get(g), g in top) for g in genes], schema)
