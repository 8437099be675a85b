"""Streams against batches, over restarts and late rows; nulls in the batch operators that they share."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsmat.operators import moments
from obsmat.operators.normalize import normalize
from obsmat.operators.pca import project_rows
from obsmat.sources import matrix
from obsmat.streaming import moments as streaming


def cells(n=80):
    rng = np.random.default_rng(6)
    return [(i, i % 3, f"g{j}", float(rng.gamma(2, 1))) for i in range(n) for j in range(4) if rng.random() < 0.6]


def test_clusters_over_a_restart(spark, tmp_path):
    """Half of the files, a stop, the others from the checkpoint: the state holds what all rows together give."""
    df = spark.createDataFrame(cells(), "obs_id long, cluster int, gene string, x double").union(spark.createDataFrame([(900, 1, "g0", None)], "obs_id long, cluster int, gene string, x double"))
    seen = {}

    def take(batch, number):
        seen.update({(r.cluster, r.gene): r.asDict() for r in batch.collect()})

    for half in range(2):
        df.where(F.col("obs_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = streaming.running_cluster_moments(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(take).start()
        query.processAllAvailable()
        query.stop()
    kind = "cluster int, gene string, k long, mean double, m2 double, above long"
    running = spark.createDataFrame([tuple(r[c] for c in ("cluster", "gene", "k", "mean", "m2", "above")) for r in seen.values()], kind)
    assign = df.select("obs_id", "cluster").distinct()
    got = {(r.cluster, r.gene): r for r in streaming.with_sizes(running, moments.cluster_sizes(assign)).collect()}
    want = {(r.cluster, r.gene): r for r in moments.cluster_stats(df.select("obs_id", "gene", "x"), assign).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("n", "mean", "present", "var"))


def test_rows_are_projected_as_they_come(spark, tmp_path):
    rng = np.random.default_rng(2)
    counts = rng.poisson(3, (30, 5)).astype(float)
    counts[4] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(counts)], "obs_id long, features array<double>")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    w, mean = rng.normal(size=(5, 2)), rng.normal(size=5)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.project_stream(stream, w, mean, 1e4).writeStream.format("memory").queryName("projected").start()
    query.processAllAvailable()
    query.stop()
    got = {r.obs_id: r.features for r in spark.table("projected").collect()}
    total = counts.sum(1, keepdims=True)
    want = (np.where(total > 0, np.log1p(counts * 1e4 / np.where(total > 0, total, 1)), 0) - mean) @ w
    assert len(got) == 30 and all(np.allclose(got[i], want[i]) for i in range(30))
    batch = {r.obs_id: r.features for r in project_rows(streaming.normalize_rows(rows, 1e4), w, mean).collect()}
    assert all(np.allclose(batch[i], want[i]) for i in range(30))


def test_windows_close_and_late_rows_are_counted(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    kind = "ts timestamp, user_id long, event_type string, value double"
    batches = [[(at(1), 1, "a", 1.0), (at(1, 30), 1, "a", 2.0), (at(2), 2, "b", 5.0)], [(at(9), 1, "a", 1.0)], [(at(1, 10), 1, "a", 100.0), (at(9, 5), 1, "a", 4.0)], [(at(20), 3, "a", 1.0)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        query = streaming.windowed_counts(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        late = streaming.late_rows(query)
        query.stop()
        assert late == (1 if k == 2 else 0)
    out = spark.read.parquet(f"{tmp_path}/out").select(F.hour("window.start").alias("h"), "obs_id", "gene", "count")
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a", 3.0), (2, 2, "b", 5.0), (9, 1, "a", 5.0)]


def test_null_values_are_missing(spark):
    counts = spark.createDataFrame([(1, "a", 3.0), (1, "b", None), (1, "c", 1.0), (2, "a", 0.0), (None, "a", 2.0)], "obs_id long, gene string, count double").withColumn("x", F.lit("clash"))
    got = {(r.obs_id, r.gene): r.x for r in normalize(counts, 100.0).collect()}
    assert got == {(1, "a"): pytest.approx(np.log1p(75)), (1, "c"): pytest.approx(np.log1p(25)), (2, "a"): 0.0, (None, "a"): pytest.approx(np.log1p(100))}
    expr = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "a", 4.0), (3, "b", None)], "obs_id long, gene string, x double")
    g = {r.gene: r for r in moments.gene_moments(expr, 4, back=False).collect()}
    assert set(g) == {"a"} and g["a"].mean == 1.5 and g["a"].n_present == 2 and g["a"]["var"] == pytest.approx(np.var([2, 0, 4, 0], ddof=1))
    assign = spark.createDataFrame([(1, 0), (2, 0), (3, None), (4, 1)], "obs_id long, cluster int")
    s = {(r.cluster, r.gene): r for r in moments.cluster_stats(expr, assign).collect()}
    assert s[0, "a"].mean == 1.0 and s[0, "a"].n == 2 and s[1, "a"].mean == 0.0 and {c for c, _ in s} == {0, 1}
    assert normalize(counts.limit(0)).count() == moments.gene_moments(expr.limit(0), 3).count() == 0


def test_modes_and_markers_as_files(spark, tmp_path):
    (tmp_path / "modes.csv").write_text("cell,depth\n1,0.5\n3,2.5\n")
    obs = spark.createDataFrame([(i,) for i in range(4)], "obs_id long")
    got = {r.obs_id: r.depth for r in matrix.read_known_modes(spark, f"{tmp_path}/modes.csv", obs, "cell").collect()}
    assert got == {0: None, 1: 0.5, 2: None, 3: 2.5}
    for _ in range(2):
        matrix.write_markers(spark, {"b", "a", "c"}, f"{tmp_path}/markers")
    assert [r.marker for r in spark.read.csv(f"{tmp_path}/markers", header=True).collect()] == ["a", "b", "c"]
