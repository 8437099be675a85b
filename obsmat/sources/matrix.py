"""Matrices in long form: (obs_id, gene, x), non-zeros only. Builders from star-schema tables, and readers and writers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id (customer), gene (part brand), count (quantity ordered)."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    both = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    return both.groupBy(F.col("o_custkey").alias("obs_id"), F.col("p_brand").alias("gene")).agg(F.sum("l_quantity").alias("count"))


def customer_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_mktsegment").alias("cluster"))


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs_id, features (array of double), cluster."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("obs_id"), F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("cluster"))


def long_form(vectors: DataFrame, *keep: str) -> DataFrame:
    """A row for each element of the vectors: obs_id, the kept columns, gene (position from 0), x."""
    return vectors.select("obs_id", *keep, F.posexplode("features").alias("gene", "x"))


def sparse_rows(expr: DataFrame, genes: list, most: int = 200_000) -> DataFrame:
    """obs_id, at (places in genes), x: a row's values over the given genes, in order. The gene table is broadcast, its size checked."""
    if len(genes) > most:
        raise ValueError(f"more than {most} genes")
    table = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], f"gene {expr.schema['gene'].dataType.simpleString()}, at int")
    found = expr.join(F.broadcast(table), "gene").where("x is not null")
    rows = found.groupBy("obs_id").agg(F.sort_array(F.collect_list(F.struct("at", F.col("x").cast("double").alias("x")))).alias("s"))  # a row holds its genes at most
    return rows.select("obs_id", F.col("s.at").alias("at"), F.col("s.x").alias("x"))


def row_form(expr: DataFrame, genes: list) -> DataFrame:
    """obs_id, features in the order of genes; absent and null elements are 0, repeated ones add up. For a bounded number of genes."""
    kind, width = expr.schema["obs_id"].dataType.simpleString(), len(genes)

    def dense(batches):
        step = max(1, (1 << 22) // max(1, width))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy())
                out = np.zeros((b.num_rows, width))
                np.add.at(out, (row, b.column(1).flatten().to_numpy()), b.column(2).flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * width, pa.int32()), pa.array(out.ravel()))], ["obs_id", "features"])

    return sparse_rows(expr, genes).mapInArrow(dense, f"obs_id {kind}, features array<double>")


def select_genes(expr: DataFrame, genes: DataFrame) -> DataFrame:
    return expr.join(genes.select("gene"), "gene", "left_semi")


def select_cells(expr: DataFrame, obs: DataFrame) -> DataFrame:
    return expr.join(obs.select("obs_id"), "obs_id", "left_semi")


def sample_key(id_: Column, seed: int = 0) -> Column:
    """A pseudo-random order of ids that any engine can compute: (id + seed) * 2654435761 mod 2^32."""
    return F.pmod((id_ + F.lit(seed)) * F.lit(2654435761), F.lit(1 << 32))


def cast_same_kind(df: DataFrame, column: str, to: str) -> DataFrame:
    """Cast within a kind or to a wider one (integer to floating point); floating point to integer is an error."""
    kinds = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 1, "double": 1}
    have = dict(df.dtypes)[column]
    if kinds.get(have, 9) > kinds.get(to, -1):
        raise TypeError(f"{column}: {have} can't be cast to {to} within its kind")
    return df.withColumn(column, F.col(column).cast(to))


def unique_names(df: DataFrame, name: str = "gene", order: str = "pos") -> DataFrame:
    """Repeated names get -1, -2, ... in order, the first stays."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("-", F.col(name), F.col("_n").cast("string")))).drop("_n")


def write_matrix(path: str, expr: DataFrame, obs: DataFrame | None = None, var: DataFrame | None = None, mode: str = "append") -> None:
    """Parquet folders x, obs and var under path; appending adds rows to x."""
    expr.write.mode(mode).parquet(f"{path}/x")
    for name, df in (("obs", obs), ("var", var)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/x")


def write_by_cluster(expr: DataFrame, assign: DataFrame, path: str) -> None:
    """One folder a cluster, in one pass."""
    expr.join(assign, "obs_id").write.mode("overwrite").partitionBy("cluster").parquet(path)


def write_assignments(assign: DataFrame, path: str, kind: str = "csv") -> None:
    """csv: a row for each observation; json: a row for each cluster with its members."""
    if kind == "csv":
        assign.select("obs_id", F.col("cluster").alias("cl")).write.mode("overwrite").csv(path, header=True)
    else:
        assign.groupBy("cluster").agg(F.sort_array(F.collect_list("obs_id")).alias("members")).write.mode("overwrite").json(path)


def write_markers(spark: SparkSession, markers: set, path: str) -> None:
    """A CSV of one column, marker, in order."""
    spark.createDataFrame([(str(m),) for m in sorted(markers, key=str)], "marker string").coalesce(1).sortWithinPartitions("marker").write.mode("overwrite").csv(path, header=True)


def read_known_modes(spark: SparkSession, path: str, obs: DataFrame, key: str = "obs_id") -> DataFrame:
    """Modes by observation from a CSV with a header, aligned to obs; missing ones are null."""
    return aligned_modes(obs, spark.read.csv(path, header=True, inferSchema=True).withColumnRenamed(key, "obs_id"))


def aligned_modes(obs: DataFrame, modes: DataFrame) -> DataFrame:
    """obs_id of each row of obs with the columns of modes (obs_id, ...), null where modes has no such row."""
    return obs.select("obs_id").join(modes, "obs_id", "left")
