"""Communities by modularity, the recursion, files and streams."""

import json
import os
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from obsmat.operators import community, knn
from obsmat.plans import clustering
from obsmat.sources import fbm, matrix
from obsmat.sources.scratch import numbered
from obsmat.streaming import moments as streaming


def planted(groups=8, size=25, seed=0):
    """Directed weighted edges of dense groups with a few edges between them, and each node's group."""
    rng = np.random.default_rng(seed)
    n = groups * size
    edges = [(i, j, 1.0) for i in range(n) for j in range(n) if i != j and rng.random() < (0.4 if i // size == j // size else 0.004)]
    return edges, {i: i // size for i in range(n)}


def connected(edges, label):
    """Whether each community is one part of the graph."""
    parts = {v: v for v in label}

    def root(v):
        while parts[v] != v:
            v = parts[v]
        return v

    for i, j, _ in edges:
        if label[i] == label[j]:
            parts[root(i)] = root(j)
    return len({root(v) for v in label}) == len(set(label.values()))


@pytest.mark.parametrize("method", ["louvain", "leiden"])
@pytest.mark.parametrize("local_edges", [300])
def test_communities_reach_the_planted_modularity(spark, method, local_edges):
    """In one task, and by moves and contraction on the cluster first or to the end."""
    edges, truth = planted()
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    found = community.communities(df, method, seed=1, local_edges=local_edges).cache()
    graph = knn.undirected(df, "collapse" if method == "louvain" else "sum").cache()
    q = lambda frame: knn.modularity(graph, frame).first().q
    planted_q = q(spark.createDataFrame(list(truth.items()), "node long, community int"))
    local = community.communities(df, method, seed=1)
    assert found.count() == len(truth) and found.select("node").distinct().count() == len(truth)
    assert q(found) > 0.95 * planted_q and q(found) >= 0.98 * q(local)
    if method == "leiden":
        assert connected(edges, {r.node: r.community for r in found.collect()})


@pytest.mark.parametrize("local_edges", [0])
def test_leiden_is_connected_on_the_cluster(spark, local_edges):
    """A sparse graph of paths and bridges, on which communities that only moves have made fall apart, with names as nodes."""
    rng = np.random.default_rng(4)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 300, (420, 2)) if a != b}
    edges = [(f"n{a:03d}", f"n{b:03d}", float(rng.integers(1, 4))) for a, b in sorted(pairs)]
    df = spark.createDataFrame(edges + edges[:20] + [(None, "n001", 1.0), ("n001", "n002", None)], "src string, dst string, w double")
    label = {r.node: r.community for r in community.communities(df, "leiden", seed=2, local_edges=local_edges).collect()}
    assert connected(edges, label) and set(label) == {v for e in edges for v in e[:2]}


def test_parts_of_communities(spark):
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(40) if i % 10 != 9] + [(3, 3, 1.0)], "a long, b long, w double")
    lab = spark.createDataFrame([(i, i // 20) for i in range(41)], "node long, community long")
    got = {r.node: r.community for r in community.connected_parts(graph, lab).collect()}
    assert got == {i: 10 * (i // 10) for i in range(41)}


def test_no_edges_no_communities(spark):
    assert community.communities(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_connected_parts():
    assert community._connected([{1: 1.0}, {0: 1.0}, {3: 1.0}, {2: 1.0}], [0, 0, 0, 0]) == [0, 0, 1, 1]


def test_outliers_get_labels_of_their_own(spark):
    rows = list(enumerate([-1, 1, -1, 2, -1, 3, None]))
    got = community.split_outliers(spark.createDataFrame(rows, "pos int, label int").repartition(3)).orderBy("pos")
    assert [r.label for r in got.collect()] == [4, 1, 5, 2, 6, 3, None]


def test_numbers_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).selectExpr("(id * 37) % 1000 as x", "'clash' as _part")
    assert all(r._n == 999 - r.x for r in numbered(df.drop("_part"), F.desc("x")).collect())
    assert numbered(spark.createDataFrame([], "x int"), "x").count() == 0


def gaussians(n=60, groups=4, width=8, seed=1, noise=0.3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 3, (groups, width))
    return [(int(i), (centre[i % groups] + rng.normal(0, noise, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("prune", [False, True])
def test_phenograph_against_all_pairs(spark, prune):
    """Four groups, a small one and two single rows: the graph by hand, and clusters by size with outliers on their own."""
    rng = np.random.default_rng(3)
    rows = gaussians(160) + [(200 + i, (np.full(8, 40.0) + rng.normal(0, 0.1, 8)).tolist()) for i in range(7)] + [(300, [-60.0] * 8), (301, [90.0] * 8)]
    k = 5
    assign, graph, q = community.phenograph(spark.createDataFrame(rows, "obs_id long, features array<double>"), k, prune=prune, min_size=10, seed=1)
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sets = {ids[i]: [ids[j] for j in np.lexsort((ids, d[i])) if j != i][:k] for i in range(len(ids))}
    w = {(i, j): len(set(sets[i]) & set(sets[j])) / (2 * k - len(set(sets[i]) & set(sets[j]))) for i in sets for j in sets[i]}
    want = {}
    for i, j in w:
        a, b = w[i, j], w.get((j, i), 0.0)
        if (v := a * b if prune else (a + b) / 2) > 0:
            want[min(i, j), max(i, j)] = v
    got = {(r.a, r.b): r.w for r in graph.collect()}
    assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-12 for e in want)
    label = {r.obs_id: r.cluster for r in assign.collect()}
    assert set(label) == set(ids) and q.first().q > 0.5
    big = [c for c in set(label.values()) if sum(v == c for v in label.values()) > 10]
    assert sorted(big) == list(range(len(big))) and all(len({i % 4 for i in label if label[i] == c and i < 200}) == 1 for c in big)
    alone = [label[i] for i in sorted(label) if label[i] not in big]
    assert alone == list(range(len(big), len(big) + len(alone))) and {*range(200, 207)} <= {i for i in label if label[i] not in big}


def test_phenograph_separates_groups(spark):
    """Ten tight groups: modularity over 0.8, as a graph of such groups has."""
    rows = gaussians(400, 10, 20, 5)
    assign, _, q = community.phenograph(spark.createDataFrame(rows, "obs_id long, features array<double>"), 10, seed=1)
    assert q.first().q > 0.8 and len({r.cluster for r in assign.collect()}) >= 10
    empty = community.phenograph(spark.createDataFrame([], "obs_id long, features array<double>"), 10)
    assert empty[0].count() == empty[1].count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "angular", "dot", "manhattan"])
def test_approximate_neighbours(spark, metric):
    """Recall of at least 0.9 with leaves that hold a sixteenth of the rows, and distances that are right."""
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, (12, 24))
    x = centre[rng.integers(0, 12, 2400)] + rng.normal(0, 0.8, (2400, 24))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "obs_id long, features array<double>").repartition(4).cache()
    true = {(r.src, r.dst): r.distance for r in knn.knn(df, 15, metric).collect()}
    rows = knn.approximate_knn(df, 15, metric, shard_rows=150).collect()
    got = {(r.src, r.dst): r.distance for r in rows}
    assert len(got) == len(rows) == len(true) == 2400 * 15
    assert len(got.keys() & true.keys()) >= 0.9 * len(true)
    assert all(got[e] == true[e] for e in got.keys() & true.keys())
    assert all(r.rank == 1 for r in rows if r.src == r.dst) or metric == "dot"
    again = {(r.src, r.dst) for r in knn.approximate_knn(df.repartition(7), 15, metric, shard_rows=150).collect()}
    assert again == got.keys()


def test_neighbours_of_few_rows_are_exact(spark):
    df = spark.createDataFrame(gaussians(90), "obs_id long, features array<double>")
    as_rows = lambda f: sorted(map(tuple, f.select("src", "dst", "rank", "distance").collect()))
    assert as_rows(knn.approximate_knn(df, 7)) == as_rows(knn.knn(df, 7))
    names = df.select(F.concat(F.lit("c"), "obs_id").alias("obs_id"), "features")
    assert as_rows(knn.approximate_knn(names, 7, shard_rows=16)) != [] and knn.approximate_knn(df.limit(0), 7).count() == 0


def test_copies_spread_over_leaves():
    """Half of the rows are one vector: no leaf gets all of them."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 6))
    x[:2000] = x[0]
    f = knn.Forest(x, 3, 5, 1)
    for _, leaf in f.leaves(x, rng.integers(0, 1 << 62, len(x))):
        assert np.bincount(leaf).max() < 800


def test_near_rows_keep_their_digits(spark):
    """Rows that differ far behind the point, far from the origin."""
    df = spark.createDataFrame([(i, [1e6 + i * 1e-5, 1e6]) for i in range(12)], "obs_id long, features array<double>")
    got = {(r.src, r.dst): r.distance for r in knn.knn(df, 3).collect()}
    assert got[0, 1] == pytest.approx(1e-5, rel=1e-3) and got.keys() >= {(i, i + 1) for i in range(11)}


def test_iterating_keeps_all_rows_and_has_no_depth_limit(spark):
    """A splitter that takes one row off at a time: fourteen levels, each reading its own rows only."""
    n = 16
    expr = spark.createDataFrame([(i, "g", float(i)) for i in range(n)], "obs_id long, gene string, x double")
    seen = []

    def step(inside, part, o, known=None, latent=None):
        ids = {r.obs_id for r in part.collect()}
        assert {r.obs_id for r in inside.select("obs_id").collect()} == ids
        seen.append(len(ids))
        return part.select("obs_id", F.when(F.col("obs_id") == min(ids), 0).otherwise(1).alias("cluster")), {f"m{len(ids)}"}

    paths, markers = clustering.iterate(expr, expr.select("obs_id"), clustering.OneStep(), min_samples=3, step=step)
    rows = paths.collect()
    assert sorted(r.obs_id for r in rows) == list(range(n)) and max(r.path.count(".") for r in rows) == 14
    assert seen == list(range(n, 2, -1)) and len(markers) == len(seen)


def test_one_step_from_counts_finds_planted_groups(spark):
    """Genes, components, projection, graph and merging, without a latent space given."""
    rng = np.random.default_rng(0)
    rows = [(i, f"g{j:02d}", float(np.log1p(rng.poisson(60 if (j < 15) == (i < 60) else 1)))) for i in range(120) for j in range(30)]
    expr = spark.createDataFrame(rows, "obs_id long, gene string, x double").where("x > 0")
    o = clustering.OneStep(n_comps=5, pc_method=None, max_pcs=2, k=10)
    assign, _ = clustering.onestep(expr, expr.select("obs_id").distinct(), o)
    sampled, _ = clustering.onestep(expr, expr.select("obs_id").distinct(), replace(o, pca_cells=50))
    for found in (assign, sampled):
        label = {r.obs_id: r.cluster for r in found.collect()}
        assert len(label) == 120 and len({label[i] for i in range(60)}) == 1 and len(set(label.values())) == 2


def nested_counts(seed=0, n=120):
    """Log counts of two groups, the first of which has two parts of its own, told by other genes; a row without values."""
    rng = np.random.default_rng(seed)
    mean = lambda i, j: 60 if (j < 12) == (i < n // 2) and j < 24 else 50 if 24 <= j < 36 and i < n // 2 and (j < 30) == (i < n // 4) else 1
    rows = [(i, f"g{j:02d}", float(np.log1p(rng.poisson(mean(i, j))))) for i in range(n) for j in range(36)]
    return [r for r in rows if r[2] > 0], list(range(n)) + [n]


def partition(rows):
    """Rows by path, whatever the paths are called."""
    out = {}
    for r in rows:
        out.setdefault(r.path, set()).add(r.obs_id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("names", [False, True])
def test_groups_in_tasks_give_the_paths_of_the_loop(spark, names):
    rows, ids = nested_counts()
    expr, obs = spark.createDataFrame(rows, "obs_id long, gene string, x double"), spark.createDataFrame([(i,) for i in ids], "obs_id long")
    if names:
        expr, obs = (f.withColumn("obs_id", F.format_string("c%03d", "obs_id")) for f in (expr, obs))
    o = clustering.OneStep(n_comps=5, pc_method=None, max_pcs=3, k=8, pca_cells=90, seed=3)
    found, markers = clustering.iterate(expr, obs, o, min_samples=20)
    got = found.collect()
    assert len(got) == len(ids) == len({r.obs_id for r in got}) and markers
    if not names:
        loop, its_markers = clustering.iterate(expr, obs, o, min_samples=20, local_values=0)
        assert {r.obs_id: r.path for r in loop.collect()} == {r.obs_id: r.path for r in got} and its_markers == markers
        mixed, _ = clustering.iterate(expr, obs, o, min_samples=20, local_values=2200)
        assert partition(mixed.collect()) == partition(got)
        assert max(r.path.count(".") for r in got) >= 1


def test_recursion_over_a_latent_space_and_nothing(spark):
    rows = gaussians(90, 3, 6, 2)
    v = spark.createDataFrame(rows, "obs_id long, features array<double>")
    o = clustering.OneStep(k=8, low=-1e9, thresholds=clustering.DEThresholds(q1=None, cluster_size=2, qdiff=None, lfc=0.1, score=5, low=0.0), seed=1)
    found, _ = clustering.iterate(matrix.long_form(v), v, o, min_samples=40, latent=v)
    parts = partition(found.collect())
    assert sorted(i for p in parts for i in p) == list(range(90)) and len(parts) >= 3 and all(len({i % 3 for i in p}) == 1 for p in parts)
    none, markers = clustering.iterate(matrix.long_form(v).limit(0), v.limit(0), o, latent=v)
    assert none.count() == 0 and markers == set()


def test_final_merge_without_markers_changes_nothing(spark):
    v = spark.createDataFrame(gaussians(30), "obs_id long, features array<double>")
    assign = v.select("obs_id", (F.col("obs_id") % 2).cast("int").alias("cluster"))
    expr = matrix.long_form(v).withColumn("gene", F.col("gene").cast("string"))
    for known in (set(), {"0", "1", "2"}):
        same = assign if not known else assign.withColumn("cluster", F.lit(4))
        out, markers = clustering.final_merge(expr, same, known, clustering.OneStep())
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, same.collect())) and markers == set()


def test_final_merge_joins_parts_of_a_group(spark):
    """Two groups, each cut in two without reason: the parts find each other, the groups stay apart."""
    rng = np.random.default_rng(7)
    rows = [(i, f"g{j}", float(np.log1p(rng.poisson(80 if (j < 6) == (i < 60) else 1)))) for i in range(120) for j in range(12)]
    expr = spark.createDataFrame(rows, "obs_id long, gene string, x double").where("x > 0")
    assign = spark.createDataFrame([(i, 2 * (i // 60) + i % 2) for i in range(120)], "obs_id long, cluster int")
    out, _ = clustering.final_merge(expr, assign, {f"g{j}" for j in range(12)}, clustering.OneStep(n_comps=4, pc_method=None, max_pcs=3))
    label = {r.obs_id: r.cluster for r in out.collect()}
    assert len(label) == 120 and all(len({label[i] for i in part}) == 1 for part in (range(60), range(60, 120))) and len(set(label.values())) == 2


@pytest.mark.parametrize("dtype", sorted(fbm.DTYPES))
@pytest.mark.parametrize("target", [1e6, None, "raw"])
def test_binary_matrices(spark, tmp_path, dtype, target):
    genes, cells = [f"g{i}" for i in range(7)], [f"c{i}" for i in range(11)]
    x = np.random.default_rng(3).integers(0, 5, (11, 7))
    (tmp_path / "m.fbm").write_bytes(x.astype(fbm.DTYPES[dtype]).tobytes())
    for name, values in (("genes", genes), ("cells", cells)):
        (tmp_path / f"{name}.csv").write_text("\n".join(["x", *values]) + "\n")
    normal = target != "raw"
    out = fbm.convert_fbm(spark, str(tmp_path / "m.fbm"), str(tmp_path / "genes.csv"), str(tmp_path / "cells.csv"), dtype=dtype, normalized=normal, target_sum=target if normal else None)
    got = {(r.obs_id, r.gene): r.x for r in spark.read.parquet(out).collect()}
    totals = x.sum(1)
    scale = (np.median(totals[totals > 0]) if target is None else target) / totals if normal else None
    want = {(cells[i], genes[j]): float(np.log1p(x[i, j] * scale[i]) if normal else x[i, j]) for i, j in zip(*np.nonzero(x), strict=True)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("dtype", sorted(fbm.DTYPES))
def test_binary_matrices_in_parts(spark, tmp_path, dtype):
    rng = np.random.default_rng(6)
    x = rng.poisson(0.7, (101, 13)).astype(fbm.DTYPES[dtype])
    x.tofile(tmp_path / "m.bin")
    (tmp_path / "g.csv").write_text("gene\n" + "".join(f"g{i}\n" for i in range(13)))
    (tmp_path / "c.csv").write_text("cell\n" + "".join(f"cell{i}\n" for i in range(101)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "250")  # a few cells of the matrix, a part of the names
    try:
        for path in (str(tmp_path / "m.bin"), f"file:{tmp_path}/m.bin", f"file://{tmp_path}/m.bin"):
            for some in (None, ["g12", "g3"]):
                got = fbm.read_fbm(spark, path, str(tmp_path / "g.csv"), str(tmp_path / "c.csv"), dtype, genes=some)
                got = {(r.obs_id, r.gene): r.x for r in got.collect()}
                assert got == {(f"cell{i}", f"g{j}"): float(x[i, j]) for i in range(101) for j in range(13) if x[i, j] and (some is None or f"g{j}" in some)}
        part = fbm.ColumnMajorReader({"path": str(tmp_path / "m.bin"), "dtype": dtype, "n_genes": "13", "part_bytes": "250"})
        assert len(part.partitions()) > 3 and sum(b - a for a, b in (p.value for p in part.partitions())) == 101
        part.BLOCK = 26  # two cells at a time
        assert sum(b.num_rows for p in part.partitions() for b in part.read(p)) == np.count_nonzero(x)
        assert [r.at for r in fbm.numbered_as_read(spark.read.csv(str(tmp_path / "c.csv"), header=True)).sort("at").collect()] == list(range(101))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_binary_matrices_that_do_not_fit(spark, tmp_path):
    (tmp_path / "m.bin").write_bytes(b"\0" * 40)
    (tmp_path / "e.bin").write_bytes(b"")
    (tmp_path / "g.csv").write_text("gene\na\nb\n")
    (tmp_path / "c.csv").write_text("cell\nx\ny\n")
    files = str(tmp_path / "g.csv"), str(tmp_path / "c.csv")
    assert fbm.read_fbm(spark, str(tmp_path / "e.bin"), *files).count() == 0
    with pytest.raises(Exception, match="multiple"):
        fbm.read_fbm(spark, str(tmp_path / "m.bin"), *files).count()
    with pytest.raises(ValueError, match="no such genes"):
        fbm.read_fbm(spark, str(tmp_path / "m.bin"), *files, genes=["z"])
    with pytest.raises(ValueError, match="more than 1"):
        fbm.read_fbm(spark, str(tmp_path / "m.bin"), *files, max_genes=1)


def test_sinks(spark, tmp_path):
    expr = spark.createDataFrame([(i, g, float(i + 1)) for i in range(6) for g in "ab"], "obs_id long, gene string, x double")
    assign = spark.createDataFrame([(i, i % 2) for i in range(6)], "obs_id long, cluster int")
    for _ in range(2):
        matrix.write_matrix(f"{tmp_path}/m", expr, obs=assign)
    assert matrix.read_matrix(spark, f"{tmp_path}/m").count() == 24
    matrix.write_by_cluster(expr, assign, f"{tmp_path}/by")
    assert spark.read.parquet(f"{tmp_path}/by/cluster=1").select("obs_id").distinct().count() == 3
    matrix.write_assignments(assign, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).columns == ["obs_id", "cl"]
    matrix.write_assignments(assign, f"{tmp_path}/j", "json")
    lines = [json.loads(x) for f in os.listdir(f"{tmp_path}/j") if f.endswith(".json") for x in open(f"{tmp_path}/j/{f}")]
    assert sorted((x["cluster"], x["members"]) for x in lines) == [(0, [0, 2, 4]), (1, [1, 3, 5])]


def test_streams_give_the_batch_result(spark, tmp_path):
    rows = [(i % 5, f"g{i % 3}", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "obs_id long, gene string, x double")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.running_moments(stream, 60).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    got = {r.gene: r.asDict() for r in spark.table("running").collect()}
    want = {r.gene: r.asDict() for r in streaming.running_moments(df, 60).collect()}
    assert got.keys() == want.keys() and all(got[g][c] == pytest.approx(want[g][c]) for g in want for c in want[g] if c != "gene")


def test_the_entry_imports_and_names_agree():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 70


@pytest.mark.parametrize("metric", knn.METRICS)
def test_neighbours_of_many_copies_come_in_the_order_of_their_rows(metric):
    """Far more copies than neighbours, blocks of pairs that end within rows, and numbers that have no bounds."""
    rng = np.random.default_rng(3)
    x = np.vstack([rng.integers(0, 3, (900, 3)).astype(float), np.tile([[1.0, 2.0, 0.0]], (1300, 1)), rng.normal(size=(300, 3)) * [1, 1e-3, 1e6] + 1e4])
    odd = x[:200].copy()
    odd[7, 1], odd[9, 0] = np.nan, np.inf
    for points in (x, odd):
        with np.errstate(all="ignore"):
            got = knn.nearest_rows(points[::5], points, 7, metric)
            want = [np.argsort(knn.exact_distances(q, points, metric), kind="stable")[:7] for q in points[::5]]
            far = [np.take(knn.exact_distances(q, points, metric), w) for q, w in zip(points[::5], want, strict=True)]
        assert got[2] == 7 and got[0].tolist() == np.concatenate(want).tolist()
        assert np.array_equal(got[1], np.concatenate(far), equal_nan=True)


def test_blocks_of_neighbours_grow_with_the_rows(spark):
    assert [knn.block_count(n, 64, 4096, 16) for n in (10, 32_768, 51_282, 262_144, 615_360)] == [1, 8, 8, 8, 19]
    assert knn.block_count(100_000, 5000, 4096, 16) == 25  # a block of wide rows stays as it is
    x = np.random.default_rng(4).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "obs_id long, features array<double>")
    rows = lambda n: sorted((r.src, r["rank"], r.dst) for r in knn.knn(df, 5, "manhattan", block_rows=n).collect())
    assert rows(4096) == rows(20)


def shuffled(spark, work):
    """(records, bytes) that the stages of work() wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        sc.listenerBus().waitUntilEmpty()
        some = spark.sparkContext._gateway
        stages = sc.statusStore().stageList(None, False, False, some.new_array(some.jvm.double, 0), some.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): (stages.apply(i).shuffleWriteRecords(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())}

    before = so_far()
    work()
    return tuple(sum(v) for v in zip(*(v for k, v in so_far().items() if k not in before), strict=True))


def test_shuffles_of_neighbours_grow_as_the_rows(spark):
    """Four times the rows shuffle four times as much: a row goes to eight tasks, and one list of neighbours comes back of each."""
    told = []
    for n in (8200, 32800):
        df = spark.createDataFrame(pa.table({"obs_id": np.arange(n), "features": list(np.random.default_rng(n).normal(size=(n, 3)))}))
        told.append(shuffled(spark, lambda df=df: knn.knn(df, 4).write.format("noop").mode("overwrite").save()))
        assert told[-1][0] < 16.1 * n
    assert told[1][1] < 4.2 * told[0][1]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_neighbours_of_pairs_of_blocks(spark, kind):
    """Rows over several blocks, with names, copies and numbers that are floats or aren't, against all pairs."""
    x = np.random.default_rng(6).normal(size=(2500, 5)).astype(kind).astype(float)
    x[1200:1210] = x[7]
    names = np.array([f"r{i:04d}" for i in range(len(x))])
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in zip(names, x, strict=True)], "obs_id string, features array<double>").repartition(3)
    got = {(r.src, r["rank"]): (r.dst, r.distance) for r in knn.knn(df, 6).collect()}
    assert len(got) == 6 * len(x)
    for i in range(0, len(x), 7):
        d = knn.exact_distances(x[i], x, "euclidean")
        assert [got[names[i], r + 1] for r in range(6)] == [(names[j], d[j]) for j in np.argsort(d, kind="stable")[:6]]


def test_neighbours_where_blocks_are_empty(spark):
    """More blocks than rows, fewer rows than neighbours asked for, and none."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "obs_id long, features array<double>")
    rows = sorted((r.src, r["rank"], r.dst) for r in knn.knn(df, 9, block_rows=1).collect())
    assert rows == [(i, r + 1, j) for i in range(5) for r, j in enumerate(sorted(range(5), key=lambda j: (abs(i - j), j)))]
    assert knn.knn(df.limit(0), 3).count() == 0


def test_labels_of_rounds_are_not_broadcast(spark, monkeypatch):
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "a long, b long, w double")
    plans, real = [], community.kept
    monkeypatch.setattr(community, "kept", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    community.spread_labels(graph, rounds=1).collect()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_nodes_unite_along_edges_whatever_the_chains(spark):
    """A path whose edges get heavier: each node's best neighbour is the next, so only the last two name each other."""
    graph = spark.createDataFrame([(i, i + 1, 1.0 + i) for i in range(400)], "a long, b long, w double")
    rows = community.united(graph).collect()
    label = {r.node: r.community for r in rows}
    assert len(rows) == len(label) == 401 and len(set(label.values())) < 340  # a quarter of the nodes, about
    assert connected([(i, i + 1, 1.0) for i in range(400)], label)


def test_rounds_on_the_cluster_are_few(spark, monkeypatch):
    """A ring of 60 cliques of six: at most a few rounds of uniting and eight of moves, with the modularity of one task."""
    edges = [(6 * c + i, 6 * c + j, 1.0) for c in range(60) for i in range(6) for j in range(i)] + [(6 * c, 6 * c + 9, 1.0) for c in range(59)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    calls, real = [], community.united
    monkeypatch.setattr(community, "united", lambda *a: (calls.append(1), real(*a))[1])
    monkeypatch.setattr(community, "connected_parts", lambda *a: pytest.fail("louvain splits nothing"))
    graph = knn.undirected(df).cache()
    q = [knn.modularity(graph, community.communities(df, "louvain", seed=1, local_edges=n)).first().q for n in (10**6, 100)]
    assert 0 < len(calls) <= 10 and q[1] >= 0.98 * q[0]
