"""Column-major binary matrices (genes x cells, no header) with a CSV of genes and one of cells."""

from __future__ import annotations

import argparse
import json
import posixpath
import re
from collections.abc import Sequence
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from obsmat.operators.normalize import normalize

#: Names of element types in such files.
DTYPES = {"double64": "<f8", "float32": "<f4", "int32": "<i4", "int16": "<i2"}


class ColumnMajor(DataSource):
    """Non-zeros of a column-major binary matrix as rows (at, gene, x): the numbers of the cell and the gene, and the value.

    Partitions are ranges of bytes that begin and end between cells; nothing is counted and nothing pickled, as a cell's number
    follows from its place, and blocks of cells go to Spark as Arrow batches. Options: path, n_genes, dtype, part_bytes, and
    genes (numbers of the genes to give, as JSON; all if missing).
    """

    @classmethod
    def name(cls) -> str:
        return "column_major"

    def schema(self) -> str:
        return "at long, gene int, x double"

    def reader(self, schema) -> ColumnMajorReader:
        return ColumnMajorReader(self.options)


class ColumnMajorReader(DataSourceReader):
    #: Values in a block that a task holds at once, if a cell has no more.
    BLOCK = 1 << 21

    def __init__(self, options):
        self.path, self.kind = options["path"], np.dtype(DTYPES[options["dtype"]])
        self.n_genes, self.part_bytes = int(options["n_genes"]), int(options["part_bytes"])
        self.genes = np.array(json.loads(options["genes"]), np.int32) if "genes" in options else None

    def _open(self):
        path = re.sub(r"^file:/*", "/", self.path)
        return fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))

    def partitions(self) -> list[InputPartition]:
        store, at = self._open()
        info, record = store.get_file_info(at), self.n_genes * self.kind.itemsize
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        if info.size % max(record, 1):
            raise ValueError(f"{self.path} holds {info.size} bytes, no multiple of {record}, the bytes of {self.n_genes} genes")
        n, step = info.size // max(record, 1), max(1, self.part_bytes // max(record, 1))
        return [InputPartition((i, min(i + step, n))) for i in range(0, n, step)] or [InputPartition((0, 0))]

    def read(self, partition):
        first, end = partition.value
        store, at = self._open()
        step, names = max(1, self.BLOCK // max(self.n_genes, 1)), ["at", "gene", "x"]
        with store.open_input_file(at) as f:
            f.seek(first * self.n_genes * self.kind.itemsize)
            for i in range(first, end, step):
                rows = min(step, end - i)
                block = np.frombuffer(f.read(rows * self.n_genes * self.kind.itemsize), self.kind).reshape(rows, self.n_genes)
                if self.genes is not None:
                    block = block[:, self.genes]
                row, col = np.nonzero(block)
                gene = col if self.genes is None else self.genes[col]
                yield pa.RecordBatch.from_arrays([pa.array(row + i), pa.array(gene.astype(np.int32)), pa.array(block[row, col].astype(float))], names)


def numbered_as_read(df: DataFrame, name: str = "at") -> DataFrame:
    """df with the number of each row in the order in which it is read: the rows of the partitions before, of which the driver
    gets one count each, and the place in its own. df must be read alike each time, as files are."""
    at, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.part: r["n"] for r in df.select(at.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return df.withColumn(name, F.element_at(F.lit(before or [0]), at + 1).cast("long") + place)


def read_fbm(spark: SparkSession, fbm_path: str, gene_csv: str, cell_csv: str, dtype: str = "double64", *, genes: Sequence[str] | None = None, max_genes: int = 1_000_000) -> DataFrame:
    """obs_id, gene, x of the non-zeros, of all genes or of `genes` only. Files may be cut between any two cells.

    The first columns of the CSV files name genes and cells. Gene names are broadcast: more than max_genes are an error, so are
    genes that the file doesn't have and a file whose length doesn't fit. The file lies where pyarrow can open it: a shared
    folder, HDFS, S3 or GCS. NaN counts as a non-zero; cells without non-zeros have no row; an empty file gives no rows.
    """
    names = [r[0] for r in spark.read.csv(gene_csv, header=True).limit(max_genes + 1).collect()]
    if len(names) > max_genes:
        raise ValueError(f"more than {max_genes} genes")
    source = spark.read.format("column_major").option("path", fbm_path).option("n_genes", len(names)).option("dtype", dtype)
    source = source.option("part_bytes", int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    if genes is not None:
        place = {g: i for i, g in enumerate(names)}
        if lost := [g for g in genes if g not in place]:
            raise ValueError(f"no such genes: {lost[:5]}")
        source = source.option("genes", json.dumps(sorted({place[g] for g in genes})))
    spark.dataSource.register(ColumnMajor)
    named = F.broadcast(spark.createDataFrame(list(enumerate(names)), "gene int, _name string"))
    cells = spark.read.csv(cell_csv, header=True)
    cells = numbered_as_read(cells.select(F.col(cells.columns[0]).alias("obs_id")))
    return source.load().join(named, "gene").join(cells, "at").select("obs_id", F.col("_name").alias("gene"), "x")


def convert_fbm(spark: SparkSession, fbm_path: str, gene_csv: str, cell_csv: str, *, dtype: str = "double64", out: str | None = None, out_dtype: str | None = None, normalized: bool = True, target_sum: float | None = 1e6) -> str:
    """Reads, casts, normalises (None: to the median total) and writes Parquet; returns the folder."""
    x = read_fbm(spark, fbm_path, gene_csv, cell_csv, dtype)
    if normalized:
        x = normalize(x.withColumnRenamed("x", "count"), target_sum=target_sum)
    if out_dtype:
        x = x.withColumn("x", F.col("x").cast(out_dtype))
    out = out or str(PurePosixPath(fbm_path).with_suffix("")) + ("_normalized" if normalized else "") + ".parquet"
    x.write.mode("overwrite").parquet(out)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Convert a column-major binary matrix to Parquet")
    for name in ("fbm_path", "gene_csv", "cell_csv"):
        p.add_argument(name)
    p.add_argument("-p", "--dtype", default="double64", choices=sorted(DTYPES))
    p.add_argument("-o", "--out")
    p.add_argument("-d", "--out-dtype")
    p.add_argument("-n", "--normalize", action="store_true")
    p.add_argument("-t", "--target-sum", type=float, default=1e6)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("convert_fbm").getOrCreate()
    print(convert_fbm(spark, a.fbm_path, a.gene_csv, a.cell_csv, dtype=a.dtype, out=a.out, out_dtype=a.out_dtype, normalized=a.normalize, target_sum=a.target_sum))


if __name__ == "__main__":
    main()
