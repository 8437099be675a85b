"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: space and the ASCII control characters tab to carriage return.
SPACES = r"[ \x09-\x0D]+"

#: Makes Spark delete a query's shuffle files when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local session has none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.gettempdir()}/obsmat-scratch"
    return where


def table_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, so that a lost executor costs no recomputation, and where it is."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/obsmat/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, label: str) -> DataFrame:
    return table_at(df, label)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shingle_hashes(words_: Column, size: int) -> Column:
    """A 64-bit hash of each run of `size` words; of the whole sequence if there are fewer; none without words."""
    return let(
        F.transform(words_, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) == 0, F.expr("array_repeat(0L, 0)")).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (size - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, F.lit(size))))
        ),
    )
