"""Counts to log counts per target: x = ln(1 + count * target / total of the row)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def normalize(counts: DataFrame, target_sum: float | None = 1e6) -> DataFrame:
    """counts: obs_id, gene, count. A row of zeros stays zero. target_sum None: the median of the positive row totals.

    A null count is a missing entry and goes; a null obs_id is one row of the matrix; repeated entries of a row and gene stay apart, each with its
    own share of the total. An empty table gives an empty one; other columns are left out.
    """
    counts = counts.where("count is not null")
    total = F.sum("count").over(Window.partitionBy("obs_id"))
    rows = counts.withColumn("total", total)
    if target_sum is None:
        median = counts.groupBy("obs_id").agg(F.sum("count").alias("t")).where("t > 0").agg(F.percentile("t", 0.5).alias("target"))
        rows = rows.crossJoin(F.broadcast(median))  # one row
    else:
        rows = rows.withColumn("target", F.lit(float(target_sum)))
    return rows.select("obs_id", "gene", F.when(F.col("total") > 0, F.log1p(F.col("count") * F.col("target") / F.col("total"))).otherwise(0e0).alias("x"))
