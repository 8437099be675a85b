"""SimHash groups against all pairs."""

import numpy as np
import xxhash
from llm_helpers import clashing, empty_docs, odd_docs, odd_rows, prose
from pyspark.sql import functions as F

from obsmat.llm import simhash as sh


def by_hand(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(points):
    """Smallest member of each point's component, by all pairs."""
    adj = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    lab = np.arange(len(points))
    while True:
        new = np.where(adj, lab[None, :], len(points)).min(1)
        if (new == lab).all():
            return lab
        lab = new


def test_components_by_hand(spark):
    base = prose(300, 3)
    rows = odd_rows() + [(200 + i, base.replace(base.split()[i * 7], "changed", 1), "en", "s1", 0) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sh.near_duplicates(clashing(df)).collect()
    fps = np.array([by_hand(r[1]) for r in rows], np.uint64)
    lab = groups(fps)
    ids = [r[0] for r in rows]
    want = []
    for i in range(len(rows)):
        known = [ids[j] for j in range(len(rows)) if lab[j] == lab[i] and ids[j] is not None]
        want.append((ids[i], f"{int(fps[i]):016x}", min(known) if known else None))
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == sorted(want, key=str)


def test_deep_trees_lose_no_link():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[rng.integers(0, 1500, 800)] ^ (np.uint64(1) << rng.integers(0, 64, 800).astype(np.uint64))
    points = np.unique(np.concatenate([base, near, base[:1] ^ np.arange(600, dtype=np.uint64)]))
    a, b = [], []
    sent = 0
    for by in sh.metrics():
        for leaf, at, home in sh.route(sh.build_tree(points, 4, by), points):
            sent += len(at)
            x, y = sh.shard_links(points[at[home]], points[at[~home]], by, leaf=24, most=5000)
            a.append(x)
            b.append(y)
    assert sent < 6 * len(points)
    root, node = sh.stars(np.concatenate(a), np.concatenate(b))
    lab = groups(points)
    assert dict(zip(node, root, strict=True)) == {points[i]: points[lab[i]] for i in range(len(points)) if lab[i] != i}
    assert len(node) < len(points)


def test_chains_are_one_component(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r.root for r in sh.components(edges).collect()} == {0}


def test_one_document_of_each_group_stays(spark):
    df = odd_docs(spark)
    out = sh.first_of_each(clashing(df))
    assert out.columns == clashing(df).columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 8, 10} <= set(ids) and not {2, 5, 6, 9} & set(ids)
    assert sh.first_of_each(empty_docs(spark)).count() == 0 and sh.near_duplicates(empty_docs(spark)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_stage_takes_five_words_and_four_fifths(spark):
    """Pairs with 1 to 8 changed words: one stays of those with a Jaccard of 0.8 or more, both of the others."""
    rows, want = [], set()
    for i in range(64):
        a = prose(200, 1000 + i).split()
        b = [f"changed{i}x{j}" if j % 24 == 5 and j // 24 <= i % 8 else w for j, w in enumerate(a)]
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want |= {2 * i} if jaccard(rows[-2][1], rows[-1][1]) >= 0.8 else {2 * i, 2 * i + 1}
    assert 64 < len(want) < 128
    assert {r.doc_id for r in sh.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_rows_not_ids_are_kept(spark):
    """Null and repeated ids with unrelated texts: each text has a row, and copies of a text have one."""
    a, b, c, d, e = (prose(60, 2000 + i) for i in range(5))
    rows = [(None, a), (None, b), (7, c), (7, d), (3, c), (None, b), (7, d), (None, e), (9, e)]
    got = sorted(map(tuple, sh.first_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (3, c), (7, d), (9, e)], key=str)


def test_rows_a_fingerprint_stay_flat():
    """Random fingerprints are sent to one shard a part, at any depth, and their shards are alike."""
    points = np.random.default_rng(5).integers(0, 2**63, 1 << 16, dtype=np.uint64)
    for depth in (2, 5, 8):
        for by in sh.metrics():
            sizes = [len(at) for _, at, _ in sh.route(sh.build_tree(points[: 64 << depth], depth, by), points)]
            assert sum(sizes) < 1.1 * len(points) and max(sizes) < 8 * len(points) / 2**depth


def test_many_points_that_agree_in_a_part_are_dealt_to_several_shards():
    """Where the part can't split, all bits do: each linked pair meets where one of the two is at home."""
    rng = np.random.default_rng(6)
    points = rng.integers(0, 2**48, 3000, dtype=np.uint64) << np.uint64(16)
    points = np.unique(np.concatenate([points, points[:500] ^ (np.uint64(7) << np.uint64(40))]))
    by = sh.metrics()[0]
    leaves = list(sh.route(sh.build_tree(points, 4, by), points))
    assert len(leaves) > 4 and sum(home.sum() for _, _, home in leaves) == len(points) < sum(len(at) for _, at, _ in leaves)
    links = [sh.shard_links(points[at[home]], points[at[~home]], by, leaf=24) for _, at, home in leaves]
    root, node = sh.stars(*(np.concatenate(x) for x in zip(*links, strict=True)))
    lab = groups(points)
    assert dict(zip(node, root, strict=True)) == {points[i]: points[lab[i]] for i in range(len(points)) if lab[i] != i}


def family(n, seed, words=90):
    """n different texts of one text with one word replaced in each, at places that repeat."""
    base = prose(words, seed).split()
    return [" ".join([*base[: 4 + (7 * i + seed) % (words - 8)], f"w{seed}x{i}", *base[5 + (7 * i + seed) % (words - 8) :]]) for i in range(n)]


def jaccard_groups(texts):
    sets = [sh.shingle_set(t) for t in texts]
    lab = np.arange(len(texts))

    def root(i):
        while lab[i] != i:
            i = lab[i]
        return i

    for i, found in sh.matches(sets, sets, 80):
        for j in found.tolist():
            x, y = root(i), root(j)
            lab[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(len(texts))])


def test_matches_are_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 14, rng.integers(1, 16))).astype(np.uint64) for _ in range(200)] + [np.zeros(0, np.uint64)]
    got = {(i, j) for i, found in sh.matches(sets, sets, 80) for j in found.tolist()}
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if len(a) and len(b) and sh.alike(a, b, 80)}
    assert [len(f) for _, f in sh.matches(sets[:2], [], 80)] == [0, 0]


def test_large_families_lose_no_link(spark):
    """Hundreds of near copies, most of them too far from any one of them: groups are those of all pairs."""
    texts = family(600, 0) + family(250, 1, 60) + [prose(60, 3000 + i) for i in range(50)]
    lab = jaccard_groups(texts)
    assert len(set(lab[:600].tolist())) == 1 and 40 < (np.bincount(lab)[lab] == 1).sum()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in sh.first_of_each(df).collect()}
    assert kept == {int(x) for x in lab}


def test_buckets_are_compared_in_blocks(spark):
    texts = family(300, 5)
    sets = [sh.shingle_set(t) for t in texts]
    nodes = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, set binary")
    ids = nodes.select("node")
    bands = ids.selectExpr("node", "7L as band").union(ids.where("node < 5").selectExpr("node", "8L as band"))
    roots = ids.selectExpr("node", "case when node % 3 = 0 then 0L else node end as root")
    edges = sh.links_of_labels(bands, nodes, roots, block=64)
    merged = {r.node: r.root for r in sh.components(edges).collect()}
    label = [0 if i % 3 == 0 else i for i in range(300)]
    got = [merged.get(x, x) for x in label]
    assert len(set(jaccard_groups(texts).tolist())) == 1 and set(got) == {0}


def test_stage_asks_the_simhash_search(spark, monkeypatch):
    """Without any shared band key, near copies within the radius are still found, and confirmed by their sets."""
    words = prose(400, 77).split()
    rows = [(i, " ".join(words[:-1] + [f"end{i}"])) for i in range(6)] + [(10 + i, prose(60, 4000 + i)) for i in range(5)] + [(20, ""), (21, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = sh.near_duplicates(df).where("doc_id < 6").select("component_id").distinct().count()
    assert marked < 6  # some are within the radius
    monkeypatch.setattr(sh, "banded_texts", lambda texts, shingle=5: texts.select("node", F.col("node").alias("band")).distinct())
    kept = {r.doc_id for r in sh.first_of_each(df).collect()}
    assert len(kept & set(range(6))) == marked and kept - set(range(6)) == {10, 11, 12, 13, 14, 20}
