"""Cutting lineage: a frame written to the checkpoint folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = f"{tempfile.gettempdir()}/obsmat-checkpoints"
        sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: lineage is cut, a lost executor costs no recomputation, and what reads it knows its size."""
    return written(df)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df as Parquet in the shared folder, in a folder for each value of the columns `by`, so that a filter reads its own only."""
    path = f"{_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order, name: str = "_n") -> DataFrame:
    """df with the place of each row (from 0) in the order of the given columns. Sorted and counted by partitions, so no task sees
    more than its own; rows that tie in all of order are numbered in any way."""
    placed = kept(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))  # partition number and row in it
    part = F.shiftright("_place", 33)
    counts = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    start = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    both = placed.withColumn("_part", part).join(F.broadcast(start), "_part")
    return both.withColumn(name, F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_part", "_start", "_place")
