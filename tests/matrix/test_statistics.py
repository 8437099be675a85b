"""Known values of the statistics, and tails against sums and closed forms."""

import math

import numpy as np
import pytest

from obsmat.functions import special as sp
from obsmat.functions.multitest import bh_array, holm_array, holm_rows
from obsmat.operators import de, hvg, merging, moments, pca
from obsmat.operators.de import DEThresholds, Stats
from obsmat.sources import matrix

VARIANCES = np.array([20, 25, 10, 15, 25, 30, 110, 30, 15, 20, 20, 25, 30, 15, 25, 20, 20, 25, 15, 10], float)
MEANS = np.array([100, 150, 100, 90, 110, 50, 75, 125, 130, 140, 70, 150, 60, 50, 110, 100, 90, 120, 80, 100], float)
PRESENT = np.array([0.25, 0.1, 0.5, 0.8, 0.8, 0.9, 0.75, 0.5, 0.25, 0.1, 0.05, 0.001, 0.4, 0.4, 0.3, 0.7, 0.8, 0.9, 0.99, 0.95])


def three_clusters():
    genes = [f"gene{i:02d}" for i in range(20)]
    return Stats(["a", "b", "c"], genes, [5, 10, 3], np.array([MEANS, MEANS - 20, MEANS - 100]), np.array([PRESENT, PRESENT * 1.1, 1 - PRESENT]), np.array([VARIANCES, VARIANCES + 5, VARIANCES - 5]))


def as_frame(spark, s):
    rows = [(c, g, float(s.n[i]), float(s.mean[i, j]), float(s.present[i, j]), float(s.var[i, j])) for i, c in enumerate(s.labels) for j, g in enumerate(s.genes)]
    kind = "string" if isinstance(s.labels[0], str) else "int"
    return spark.createDataFrame(rows, f"cluster {kind}, gene string, n double, mean double, present double, var double")


def test_moderated_variances():
    post, d0, s0 = de.moderated(VARIANCES, 15)
    assert abs(d0 - 18.92199) < 1e-4 and abs(s0 - 21.86946) < 1e-4
    assert np.allclose(post[:8], [21.04280, 23.25376, 16.62089, 18.83185, 23.25376, 25.46471, 60.84000, 25.46471], atol=1e-4)


def test_linear_fit(spark):
    rows = {r.gene: (r.sigma2, r.df) for r in de.linear_fit(as_frame(spark, three_clusters())).collect()}
    assert all(df == 15 for _, df in rows.values())
    assert abs(rows["gene00"][0] - 26 - 1 / 3) < 1e-9 and abs(rows["gene06"][0] - 134 - 1 / 3) < 1e-9


def test_moderated_t_of_pairs_in_frames_and_arrays(spark):
    t = DEThresholds(q1=0.5, q2=0.7, cluster_size=4, qdiff=0.7, padj=0.01, lfc=1.0)
    local = {(d["a"], d["b"]): d for d in three_clusters().de([("a", "b"), ("a", "c"), ("b", "c")], t, "ebayes")}
    assert abs(local["a", "c"]["score"] - 84.26030647753015) < 1e-8
    assert local["a", "c"]["up_genes"] == ["gene03", "gene04", "gene05", "gene16", "gene17", "gene18", "gene19"]
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "a string, b string")
    for r in de.de_pairs(as_frame(spark, three_clusters()), pairs, t, "ebayes").collect():
        d = local[r.a, r.b]
        assert abs(r.score - d["score"]) < 1e-8 and list(r.up_genes) == d["up_genes"] and list(r.down_genes) == d["down_genes"]


def test_chi_square_of_pairs_in_frames_and_arrays(spark):
    s = Stats([11, 4, 1, 2], [f"gene_{c}" for c in "abcde"], [200, 100, 17, 21], [[3.8, 1.5, 4, 5, 3], [3, 2, 3, 1, 3], [1, 4, 2, 3, 2], [3, 1, 1, 2, 1]], [[0.85, 0.67, 0.51, 0.14, 0.23], [0.1, 0.6, 0.4, 0.3, 0.2], [0.2, 0.16, 0.5, 0.11, 0.71], [0.3, 0.44, 0.2, 0.32, 0.83]], np.ones((4, 5)))
    t = DEThresholds(q1=0.3, q2=None, cluster_size=1, qdiff=0.1, padj=0.5, lfc=0.4)
    d = s.de([(11, 4), (1, 2)], t, "chisq")[0]
    assert abs(d["score"] - 34.29963735220708) < 1e-9 and d["up_genes"] == ["gene_a", "gene_c"]
    r = de.de_pairs(as_frame(spark, s), spark.createDataFrame([(11, 4)], "a int, b int"), t, "chisq").first()
    assert abs(r.score - 34.29963735220708) < 1e-9 and list(r.up_genes) == ["gene_a", "gene_c"]


@pytest.mark.parametrize("method", ["ebayes", "chisq"])
@pytest.mark.parametrize("names", [False, True])
def test_blocks_of_clusters_give_the_pairs(spark, method, names):
    """Thirty clusters in blocks of four against the join of pairs, and the local form with its markers."""
    rng = np.random.default_rng(5)
    k, genes = 30, [f"g{i:02d}" for i in range(25)]
    s = Stats([f"c{i}" for i in range(k)] if names else list(range(k)), genes, rng.integers(3, 60, k), rng.gamma(2, 2, (k, 25)), rng.random((k, 25)), rng.gamma(2, 1, (k, 25)))
    s.mean[3], s.present[3], s.var[3] = s.mean[4], s.present[4], s.var[4]
    t = DEThresholds(q1=0.3, q2=None, cluster_size=2, qdiff=0.1, padj=0.6, lfc=0.2)
    frame = as_frame(spark, s)
    want = {(r.a, r.b): r for r in de.de_pairs(frame, de.cluster_pairs(frame), t, method).collect()}
    rows = de.de_pairs_in_blocks(frame, t, method, block=4).collect()
    assert len(rows) == len(want) == k * (k - 1) // 2
    local = {(d["a"], d["b"]): d for d in s.de(list(want), t, method)}
    for r in rows:
        w, d = want[r.a, r.b], local[r.a, r.b]
        assert all(abs(r[c] - w[c]) < 1e-8 and abs(d[c] - w[c]) < 1e-8 for c in ("score", "up_score", "down_score"))
        assert all(r[c] == w[c] == d[c] for c in ("num", "up_num", "down_num")) and all(list(r[c]) == list(w[c]) == d[c] for c in ("up_genes", "down_genes"))
    assert sum(r.num for r in rows) > 0
    assert s.first_genes(t, method, 2) == {r.gene for r in de.marker_genes(de.de_pairs_in_blocks(frame, t, method), 2).collect()}
    assert de.de_pairs_in_blocks(frame.limit(0), t, method).count() == 0


def test_tails_against_integrals():
    x = np.linspace(1.3, 60, 2_000_001)
    density = lambda df: math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    for df in (5, 15, 40):
        y = density(df)
        want = 2 * float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))
        assert abs(sp.t_two_sided(np.array([1.3]), df)[0] - want) < 1e-6
    assert abs(sp.chi2_tail(np.array([3.841458820694124]))[0] - 0.05) < 1e-12
    assert abs(sp.normal_tail(np.array([1.6448536269514722]))[0] - 0.05) < 1e-12
    assert abs(sp.t_two_sided(np.array([1.959963984540054]), math.inf)[0] - 0.05) < 1e-12


def test_psi_functions():
    assert abs(sp.digamma(1) + 0.5772156649015329) < 1e-12 and abs(sp.trigamma(1) - math.pi**2 / 6) < 1e-12
    assert abs(sp.tetragamma(1) + 2 * 1.2020569031595942) < 1e-10
    for y in (0.05, 0.7, 3.0, 40.0):
        assert abs(sp.trigamma_inverse(sp.trigamma(y)) / y - 1) < 1e-7


def test_adjusted_p_values():
    p = np.array([0.01, 0.04, 0.03, 0.005, 0.2])
    assert np.allclose(holm_array(p), [0.04, 0.09, 0.09, 0.025, 0.2])
    assert np.allclose(bh_array(p), [0.025, 0.05, 0.05, 0.025, 0.2])
    assert np.allclose(holm_rows(np.array([p, p[::-1]])), [holm_array(p), holm_array(p[::-1])])
    assert len(holm_array(p[:0])) == len(bh_array(p[:0])) == 0


def test_loess_keeps_parabolas_and_is_quick():
    x = np.sort(np.random.default_rng(0).gamma(2, 1, 30_000))
    assert np.allclose(hvg.loess(x, 3 * x * x - x + 2), 3 * x * x - x + 2, atol=1e-3 * (3 * x * x).max())
    few = np.linspace(0, 4, 40)
    y = np.sin(few) + few
    exact = hvg.loess(few, y, span=0.3)
    assert np.abs(exact - y).max() < 0.05 and len(hvg.loess(few[:0], few[:0])) == 0
    assert np.allclose(hvg.loess(np.full(5, 2.0), np.arange(5.0)), 2.0)


def test_highly_variable_genes_by_p_then_raw_dispersion(spark):
    rng = np.random.default_rng(2)
    mean = rng.gamma(2, 2, 200)
    var = mean * np.exp(rng.normal(0, 0.4, 200))
    present = rng.integers(0, 12, 200)
    rows = [(f"g{i:03d}", float(m), float(v), int(k)) for i, (m, v, k) in enumerate(zip(mean, var, present, strict=True))]
    got = {r.gene: r for r in hvg.highly_variable(spark.createDataFrame(rows, "gene string, mean double, var double, n_present int"), max_genes=7).collect()}
    on = present >= 4
    disp = np.log1p(var / (mean + 1e-10))[on]
    z = hvg.robust_z_array(disp)
    adj = bh_array(sp.normal_tail(hvg.robust_z_array(disp - hvg.loess(np.log1p(mean[on]), disp))))
    names = [f"g{i:03d}" for i in np.flatnonzero(on)]
    order = sorted((a, -b, n) for a, b, n in zip(adj, z, names, strict=True) if a < 1)
    assert {n for n, r in got.items() if r.highly_variable} == {n for _, _, n in order[:7]}
    assert all(abs(got[n].z - b) < 1e-9 for n, b in zip(names, z, strict=True)) and all(got[f"g{i:03d}"].z is None for i in np.flatnonzero(~on))
    assert hvg.highly_variable(spark.createDataFrame([], "gene string, mean double, var double, n_present int")).count() == 0


def test_linkage_of_thirteen_means():
    means = np.array([[0.1232, 1.2423, 3.322212, 0.63823], [0.53453, 0.42463, 0.11232, 1.11111], [5.26124, 0.4536, 4.2323, 11.463632], [0.84323, 9.12312, 6.23123, 2.32123], [0.1642, 3.298774, 5.12, 8.58372], [0.00002, 0.11222, 0.8753, 0.75453], [12.290923, 7.39573, 6.3288, 3.421], [3.76237, 8.21321, 0.22221, 0.8792], [6.00005, 0.0042, 14.87999, 4.98], [0.99903, 1.2221, 1.6520, 7.22324], [1.1135, 2.98723, 3.12314, 4.762], [8.01265, 5.2312, 0.2983, 2.87362], [2.5928324, 0.01548, 0.7902, 4.2398]])
    want = [[1, 5, 1.045270, 2], [0, 13, 3.035878, 3], [9, 10, 3.369086, 2], [12, 15, 3.892025, 3], [4, 16, 5.380229, 4], [7, 11, 5.562442, 2], [14, 17, 6.343478, 7], [3, 18, 8.498407, 3], [19, 20, 9.280318, 10], [2, 21, 10.474621, 11], [6, 22, 12.911395, 12], [8, 23, 14.389003, 13]]
    assert np.allclose(merging.linkage(means), want, atol=1e-6)
    with pytest.raises(ValueError):
        merging.linkage(means[:1])


def test_merging_by_scores():
    s, r = (Stats([11, 4], list("abc"), [5, 3], [[3.8, 1.5, 4.0], [3.0, 2.0, 3.0]], [[0.1, 0.67, 0.51], [0.0, 0.6, 0.4]], np.full((2, 3), 10.0)) for _ in range(2))
    t = DEThresholds(q1=0.3, q2=None, cluster_size=1, qdiff=0.1, padj=0.5, lfc=0.4, score=40)
    assert merging.merge_by_de(s, r, t, k=1) == {11: 4, 4: 4}


def test_merged_statistics_are_those_of_all_rows():
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 1, (7, 3)), rng.normal(2, 3, (12, 3))
    row = lambda x: (len(x), x.mean(0), (x > 1).mean(0), x.var(0, ddof=1))
    s = Stats([1, 2], list("xyz"), *(np.array(v) for v in zip(row(a), row(b), strict=True)))
    s.merge(1, 2)
    n, mean, present, var = row(np.vstack([a, b]))
    assert s.labels == [2] and s.n[0] == n and np.allclose(s.mean[0], mean) and np.allclose(s.present[0], present) and np.allclose(s.var[0], var)


def test_small_clusters_go_to_the_most_similar():
    means = np.array([[1.0, 2, 3], [3, 2, 1], [1.1, 2.1, 3.3]])
    assert merging.merge_small([1, 2, 3], means, {1: 10, 2: 9, 3: 1}, 3) == {1: 1, 2: 2, 3: 1}
    assert merging.merge_small([1], means[:1], {1: 1}, 3) == {1: 1}


def test_markers_of_five_clusters(spark):
    means = np.repeat(np.array([[10, 0, 0], [10, 0, 0], [0, 10, 0], [0, 0, 10], [10, 10, 10]]), 3, axis=1)
    present = [[0.8, 0.8, 0.4, 0, 0, 0, 0, 0, 0]] * 2 + [[0, 0, 0, 0.8, 0.8, 0.4, 0, 0, 0], [0] * 6 + [0.4] * 3, [0.3] * 9]
    s = Stats(list(range(5)), [f"Gene_{i}" for i in range(9)], [6, 6, 5, 4, 5], means, present, np.tile([3, 3, 3, 5, 5, 5, 1, 1, 1], (5, 1)))
    frame = as_frame(spark, s)
    t = DEThresholds(q1=0.5, q2=None, cluster_size=3, qdiff=0.7, padj=0.01, lfc=1.0, score=150)
    found = de.marker_genes(de.de_pairs(frame, de.cluster_pairs(frame.select("cluster").distinct()), t), 6)
    assert {r.gene for r in found.collect()} == {"Gene_0", "Gene_1", "Gene_3", "Gene_4"}


def by_steps(means):
    """Average linkage by searching all pairs at each step."""
    groups, out = {i: [i] for i in range(len(means))}, []
    dist = lambda a, b: np.mean([np.linalg.norm(means[i] - means[j]) for i in groups[a] for j in groups[b]])
    for step in range(len(means) - 1):
        far, a, b = min((dist(a, b), a, b) for a in groups for b in groups if a < b)
        groups[len(means) + step] = groups.pop(a) + groups.pop(b)
        out.append((a, b, far, len(groups[len(means) + step])))
    return np.array(out)


def test_linkage_by_chains_is_that_of_all_pairs():
    for seed in range(4):
        means = np.random.default_rng(seed).normal(size=(24, 5))
        assert np.allclose(merging.linkage(means), by_steps(means), atol=1e-9)
    tree = merging.linkage(np.array([[0.0], [1.0], [10.0], [11.5], [30.0]]))
    assert merging.cut(tree, 2) == [0, 0, 1, 1, 2] and merging.cut(tree, 0.5) == [0, 1, 2, 3, 4] and merging.cut(tree, 99) == [0] * 5
    big = np.random.default_rng(9).normal(size=(1500, 12))
    tree = merging.linkage(big)
    assert tree[-1, 3] == 1500 and (np.diff(tree[:, 2]) >= 0).all()


def test_many_genes_without_their_square(spark):
    """Against the eigenvectors of all genes, on few; and planted directions among thirty thousand genes."""
    rng = np.random.default_rng(1)
    low = rng.normal(size=(150, 6)) * [9, 7, 5, 4, 3, 2] @ rng.normal(size=(6, 40))
    x = np.maximum(0, low + rng.normal(0, 0.3, low.shape))
    rows = [(i, f"g{j:02d}", float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if v > 0]
    expr = spark.createDataFrame(rows, "obs_id long, gene string, x double").repartition(4)
    w, ev, evr, mean = pca.sparse_pca(expr, 152, [f"g{j:02d}" for j in range(40)], 6)
    full = np.vstack([x, np.zeros((2, 40))])
    value, vector = np.linalg.eigh(np.cov(full.T))
    assert np.allclose(mean, full.mean(0)) and np.allclose(ev, value[::-1][:6], rtol=1e-5) and np.allclose(evr, value[::-1][:6] / value.sum(), rtol=1e-5)
    assert (np.abs((w * vector[:, ::-1][:, :6]).sum(0)) > 1 - 1e-4).all()
    assert all(w[np.abs(w[:, k]).argmax(), k] > 0 for k in range(6))
    n, genes = 120, 30_000
    sign = rng.choice([-1.0, 1.0], (n, 2))
    at = [(i, 100 * k + j, float(5.0 + (3 - k) * sign[i, k])) for i in range(n) for k in range(2) for j in range(50)] + [(int(i), int(j), 1.0) for i, j in zip(rng.integers(0, n, 2000), rng.integers(1000, genes, 2000), strict=True)]
    wide = spark.createDataFrame(at, "obs_id long, gene int, x double")
    w, ev, _, _ = pca.sparse_pca(wide, n, list(range(genes)), 2, spare=4)
    assert np.square(w[:50, 0]).sum() > 0.95 and np.square(w[100:150, 1]).sum() > 0.95 and ev[0] > ev[1]


def test_row_form_adds_up_and_fills(spark):
    expr = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "z", 9.0), (2, "b", None), (2, "c", 4.0)], "obs_id long, gene string, x double")
    got = {r.obs_id: list(r.features) for r in matrix.row_form(expr, ["b", "a", "c"]).collect()}
    assert got == {1: [0.0, 3.0, 0.0], 2: [0.0, 0.0, 4.0]}
    assert matrix.row_form(expr.limit(0), ["a"]).count() == 0


def test_clusters_as_numbers_columns_and_lists(spark):
    rows = [(1, "B"), (2, "A"), (3, None), (4, "B"), (None, "A"), (4, "B")]
    assign = spark.createDataFrame(rows, "obs_id long, cluster string")
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, moments.cluster_ids(assign).collect()), key=str) == sorted([(1, 2), (2, 1), (3, None), (4, 2), (None, 1), (4, 2)], key=str)
    assert {r.cluster: list(r.members) for r in moments.cluster_members(assign).collect()} == {"A": [2], "B": [1, 4, 4], None: [3]}
    hot = moments.one_hot(assign)
    assert hot.columns == ["obs_id", "a", "b"] and [tuple(r) for r in sorted(hot.collect(), key=key)][:2] == [(1, False, True), (2, True, False)]
    assert moments.one_hot(assign.limit(0)).columns == ["obs_id"] and moments.cluster_ids(assign.limit(0)).count() == 0
    with pytest.raises(ValueError):
        moments.one_hot(assign, most=1)
    means = spark.createDataFrame([("A", "g", 0.0), ("A", "h", 0.0), ("B", "g", 3.0), ("B", "h", 4.0)], "cluster string, gene string, mean double")
    assert [tuple(r) for r in merging.centroid_distances(means).collect()] == [("A", "B", 5.0)]
