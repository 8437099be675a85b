"""Adjusted p-values as window expressions, and the same on arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def holm(df: DataFrame, groups: list[str], tie: str, p: str = "p", out: str = "p_adj") -> DataFrame:
    """Step-down Holm within each group: running maximum of p * (m - rank + 1), at most 1."""
    by = Window.partitionBy(*groups)
    ranked = df.withColumns({"_rank": F.row_number().over(by.orderBy(p, tie)), "_m": F.count("*").over(by)})
    running = F.max(F.col(p) * (F.col("_m") - F.col("_rank") + 1)).over(by.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn(out, F.least(F.lit(1e0), running)).drop("_rank", "_m")


def benjamini_hochberg(df: DataFrame, groups: list[str], tie: str, p: str = "p", out: str = "p_adj") -> DataFrame:
    """False discovery rate within each group: running minimum from the largest p of p * m / rank, at most 1."""
    by = Window.partitionBy(*groups)
    ranked = df.withColumns({"_rank": F.row_number().over(by.orderBy(p, tie)), "_m": F.count("*").over(by)})
    running = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(by.orderBy("_rank").rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn(out, F.least(F.lit(1e0), running)).drop("_rank", "_m")


def holm_array(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.maximum.accumulate(p[order] * np.arange(len(p), 0, -1)))
    return out


def holm_rows(p: np.ndarray) -> np.ndarray:
    """Holm within each row of p."""
    order = np.argsort(p, axis=1, kind="stable")
    step = np.minimum(1, np.maximum.accumulate(np.take_along_axis(p, order, 1) * np.arange(p.shape[1], 0, -1), axis=1))
    out = np.empty_like(step)
    np.put_along_axis(out, order, step, 1)
    return out


def bh_array(p: np.ndarray) -> np.ndarray:
    order = np.argsort(p, kind="stable")
    out = np.empty(len(p))
    out[order] = np.minimum(1, np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    return out


def rounded(c: Column) -> Column:
    """Six decimals, and no negative zero."""
    return F.round(c, 6) + F.lit(0e0)
