"""Known values of similarity, merging and comparisons of two clusters, in frames and in arrays."""

import numpy as np
from test_statistics import as_frame

from obsmat.operators import de, merging
from obsmat.operators.de import Stats

# Four clusters of ten cells and what is known of them.
LABELS, SIZES = [11, 2, 32, 4], [4, 3, 2, 1]
CLUSTER_MEANS = [[3, 1.5, 4], [3, 4, 2], [3, 0.5, 3], [0, 0, 7]]
CLUSTER_PRESENT = [[0.5, 0.25, 0.75], [1 / 3, 2 / 3, 1 / 3], [0.5, 0, 0.5], [0, 0, 1]]
CLUSTER_VARIANCES = [[5, 2.25, 7.5], [12 + 2 / 3, 8, 2 / 3], [1, 0.25, 9], [0, 0, 0]]
SIMILARITY = {(32, 11): 0.917663, (32, 2): -0.866025, (32, 4): 0.5, (4, 11): 0.802955, (4, 2): -0.866025, (4, 32): 0.5}
NEAREST = {(4, 11), (11, 32), (2, 32), (2, 4), (4, 32)}
NEAREST_OF_TWO = {(4, 11), (11, 32), (2, 32), (2, 4)}
MERGED_VARIANCES = [10.131944, 8.333333, 5.131944]
# Two clusters of 17 and 21 cells, 16 genes.
PRESENT_A = [0.05882353, 1, 0.76470588, 0.17647059, 0.17647059, 0.94117647, 0.35294118, 0, 0, 0.88235294, 1, 0, 0.64705882, 0.94117647, 0.70588235, 0.58823529]
PRESENT_B = [0.04761905, 0.95238095, 0.28571429, 0.19047619, 0.14285714, 0.85714286, 0.47619048, 0, 0, 0.76190476, 0.9047619, 0, 0.47619048, 0.66666667, 0.57142857, 0.66666667]
MEANS_A = [0.10808219, 6.14949347, 3.66000008, 0.71396599, 1.15847955, 6.0754849, 1.64339128, 0, 0, 5.31713514, 6.7146199, 0, 2.47119911, 4.4726901, 3.49215706, 2.6642798]
MEANS_B = [0.211184303, 6.649927198, 1.998193789, 0.874202979, 0.390651884, 5.805244809, 2.295554058, 0, 0, 4.456795629, 6.261517091, 0, 3.066860157, 3.138447669, 3.469266762, 3.830073194]
P = [1, 1, 0.009053, 1, 1, 0.758282, 0.663754, 1, 1, 0.595042, 0.564113, 1, 0.468314, 0.096169, 0.605741, 0.872733]
P_ADJUSTED = [1, 1, 0.144849] + [1] * 13
DIFFERENCE = [0.19047616, 0.04761905, 0.62637362, 0.0735294, 0.19047621, 0.08928571, 0.25882353, 0, 0, 0.13650794, 0.0952381, 0, 0.26406925, 0.29166666, 0.19047619, 0.11764707]


def four():
    return Stats(LABELS, ["x", "y", "z"], SIZES, CLUSTER_MEANS, CLUSTER_PRESENT, CLUSTER_VARIANCES)


def test_similarity_of_four_clusters(spark):
    sim = merging.similarity(as_frame(spark, four()).select("cluster", "gene", "mean"))
    got = {(r.src, r.dst): r.sim for r in sim.collect()}
    local = merging.similarity_array(np.array(CLUSTER_MEANS), np.array(CLUSTER_MEANS))
    for (a, b), want in SIMILARITY.items():
        assert abs(got[a, b] - want) < 1e-6 and abs(local[LABELS.index(a), LABELS.index(b)] - want) < 1e-6
    best = merging.most_similar(sim.where("src in (32, 4)")).first()
    assert (best.src, best.dst) == (32, 11)
    assert {(r.a, r.b) for r in merging.nearest_pairs(sim, 2).collect()} == NEAREST
    assert {(r.a, r.b) for r in merging.nearest_pairs(sim.where("src in (11, 2)"), 2).collect()} == NEAREST_OF_TWO
    assert set(merging.nearest_pairs_local(LABELS, np.array(CLUSTER_MEANS), None, 2)) == NEAREST
    assert set(merging.nearest_pairs_local(LABELS, np.array(CLUSTER_MEANS), [11, 2], 2)) == NEAREST_OF_TWO


def test_shares_of_the_largest_distance():
    got = merging.similarity_array(np.array([[1.0], [3.0]]), np.array([[1.0], [6.0], [7.0]]))
    assert np.allclose(got, [[1, 1 / 6, 0], [4 / 6, 3 / 6, 2 / 6]])


def test_two_of_four_clusters_become_one():
    """The known variances divide by the number of cells and leave out the receiving cluster's shift; exact ones are those of all cells."""
    cells = np.array([[0, 6, 2], [1, 0, 1], [8, 6, 3], [0, 0, 7]])
    for kind, before, want in (("compat", CLUSTER_VARIANCES[1], MERGED_VARIANCES), ("exact", cells[:3].var(0, ddof=1), cells.var(0, ddof=1))):
        s = four()
        s.var[1] = before
        s.merge(4, 2, kind)
        at = s.index(2)
        assert s.labels == [11, 2, 32] and s.n.tolist() == [4, 4, 2]
        assert np.allclose(s.mean[at], [2.25, 3, 3.25]) and np.allclose(s.present[at], [0.25, 0.5, 0.5]) and np.allclose(s.var[at], want, atol=1e-6)
        assert np.allclose(s.var[[0, 2]], [CLUSTER_VARIANCES[0], CLUSTER_VARIANCES[2]])


def test_small_clusters_of_four():
    assert merging.merge_small(LABELS, np.array(CLUSTER_MEANS, float), dict(zip(LABELS, SIZES, strict=True)), 3) == {11: 11, 2: 2, 32: 11, 4: 11}


def test_chi_square_of_sixteen_genes(spark):
    genes = [f"g{i:02d}" for i in range(16)]
    s = Stats([1, 2], genes, [17, 21], [MEANS_A, MEANS_B], [PRESENT_A, PRESENT_B], np.ones((2, 16)))
    rows = de.pairs_chisq(as_frame(spark, s), spark.createDataFrame([(1, 2)], "a int, b int")).orderBy("gene").collect()
    column = lambda c: [r[c] for r in rows]
    assert column("gene") == genes
    for name, want in (("p", P), ("p_adj", P_ADJUSTED), ("lfc", np.subtract(MEANS_A, MEANS_B)), ("qdiff", DIFFERENCE)):
        assert np.allclose(column(name), want, rtol=1e-5, atol=1e-6), name
