"""SimHash near-duplicates by vantage-point trees.

Fingerprints (not documents) are linked: copies of one fingerprint are one node. Two within radius 3 agree in at least one of
four parts of 16 bits, so there is a vantage-point tree for each part. A tree is shallow, built on a bounded sample, and
deals the fingerprints into shards. It splits by the distance within its part as long as that splits: both of a pair that
agrees there fall on one side, nothing is sent twice. Where the part no longer splits (many points agree in it), it splits
by the distance of all 64 bits: each point is at home in one leaf and is sent as a query to the other leaves that the
triangle inequality can't rule out (its distance to a vantage point is within the link radius of the boundary). Inside a
shard the same splitting goes on in memory down to small leaves, where distances are exact. So each linked pair meets
where one of the two is at home, and a fingerprint has about one row a part however many there are. Shards return spanning
stars of their links, never all pairs of a group. Components are found by smallest-label passes with pointer jumping, each
written to the shared folder.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsmat.llm.common import table

RADIUS = 3
SHINGLE = 3
#: Fingerprints at home in a shard, about, the most that the trees are built on, and the least of these that a split takes.
SHARD, SAMPLE, SPLIT = 8192, 1 << 18, 64
#: The pipeline stage takes five words and a Jaccard of 80 % or more; its candidates share one of BANDS keys of ROWS minima.
WIDE, SIMILAR, BANDS, ROWS = 5, 80, 16, 5
MULTIPLIERS = np.random.default_rng(1).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 (seed 42) hashes of the word shingles of a text with A-Z lower-cased; 0 without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    runs = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [w]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, 42) for s in map(b" ".join, runs)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def each(batches):
        for b in batches:
            fp = np.fromiter((simhash(t, shingle) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def metrics(radius: int = RADIUS) -> list[tuple[tuple[int, int], ...]]:
    """For each of radius + 1 parts of the bits the distances to split by, (mask, slack): points linked through the part are
    at most slack apart in the masked bits. One part, or more, of a linked pair agrees in all its bits."""
    ends = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(((1 << high) - (1 << low), 0), ((1 << 64) - 1, radius)) for low, high in zip(ends, ends[1:])]


def choose(points: np.ndarray, rng: np.random.Generator, by, tries: int = 12) -> tuple[float, int, int, int, int]:
    """(cost, vantage point, r, mask, slack) of the split with the least share of pairs left to compare; cost 1 splits nothing."""
    seen = points if len(points) <= 512 else points[rng.integers(0, len(points), 512)]
    best, r = (1.0, 0, 0, 0, 0), np.arange(1, 65)
    for mask, slack in by:
        for v in points[rng.integers(0, len(points), tries)]:
            at = np.cumsum(np.bincount(distance(seen & np.uint64(mask), v & np.uint64(mask)), minlength=65 + slack)) / len(seen)
            below = np.concatenate([np.zeros(slack + 1), at])  # the share nearer than k is at k + slack
            inner, wide, narrow = below[r + slack], below[r + 2 * slack], below[r]
            cost = np.where((inner >= 0.05) & (inner <= 0.95), inner * wide + (1 - inner) * (1 - narrow), 1.0)
            k = int(cost.argmin())
            best = min(best, (float(cost[k]), int(v), int(r[k]), mask, slack))
    return best


def build_tree(sample: np.ndarray, depth: int, by) -> tuple | int:
    """A nested (v, r, mask, slack, inner, outer), or a leaf's number."""
    rng, leaves = np.random.default_rng(42), [0]

    def grow(points, left):
        cost, v, r, mask, slack = choose(points, rng, by) if left and len(points) >= SPLIT else (1.0, 0, 0, 0, 0)
        if cost > 0.95:
            leaves[0] += 1
            return leaves[0] - 1
        inside = distance(points & np.uint64(mask), np.uint64(v & mask)) < r
        return v, r, mask, slack, grow(points[inside], left - 1), grow(points[~inside], left - 1)

    return grow(sample, depth)


def route(tree, points: np.ndarray):
    """(leaf, indices of points, at home or not) for each leaf that may hold a partner of the points."""
    stack = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while stack:
        node, at, home = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            yield node, at, home
            continue
        v, r, mask, slack, inner, outer = node
        d = distance(points[at] & np.uint64(mask), np.uint64(v & mask))
        into, out = d < r + slack, d >= r - slack
        stack.append((inner, at[into], home[into] & (d[into] < r)))
        stack.append((outer, at[out], home[out] & (d[out] >= r)))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as (a, b): from each component's smallest node to the others."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    lab = np.arange(len(nodes))
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        for at in (x, y, lab[x], lab[y]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    rest = lab != np.arange(len(nodes))
    return nodes[lab[rest]], nodes[rest]


def shard_links(home: np.ndarray, queries: np.ndarray, by, radius: int = RADIUS, leaf: int = 96, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the links of home points with each other and with the queries, all that agree in the part that `by`
    splits by and maybe others. Points must be distinct."""
    rng, found, held = np.random.default_rng(7), [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))], 0
    stack = [(home, queries)]
    while stack:
        h, q = stack.pop()
        if not len(h) or len(h) + len(q) < 2:
            continue
        cost, v, r, mask, slack = choose(h, rng, by, 4) if len(h) > leaf else (1.0, 0, 0, 0, 0)
        if cost < 0.9:
            dh, dq = (distance(x & np.uint64(mask), np.uint64(v & mask)) for x in (h, q))
            inner, outer = dh < r, dh >= r
            stack.append((h[inner], np.concatenate([q[dq < r + slack], h[outer & (dh < r + slack)]])))
            stack.append((h[outer], np.concatenate([q[dq >= r - slack], h[inner & (dh >= r - slack)]])))
            continue
        every, step = np.concatenate([h, q]), max(1, (1 << 20) // (len(h) + len(q)))
        for i in range(0, len(h), step):
            x, y = np.nonzero(np.bitwise_count(h[i : i + step, None] ^ every[None, :]) <= radius)
            keep = x + i != y
            if keep.any():
                found.append((h[x[keep] + i], every[y[keep]]))
                held += int(keep.sum())
                if held > most:
                    found = [stars(*map(np.concatenate, zip(*found, strict=True)))]
                    held = len(found[0][0])
    return stars(*map(np.concatenate, zip(*found, strict=True)))


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within the radius."""
    n, parts = fps.count(), metrics(radius)
    depth = max(0, math.ceil(math.log2(max(1, n) / shard)))
    bound = min(SAMPLE, SPLIT << depth)
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(bound).collect()], np.int64).view(np.uint64)
    trees = [build_tree(sample, depth, by) for by in parts]

    def deal(batches):
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, tree in enumerate(trees):
                for leaf, at, home in route(tree, points):
                    key = (pa.array(np.full(len(at), k, np.int32)) for k in (part, leaf))
                    yield pa.RecordBatch.from_arrays([*key, pa.array(points[at].view(np.int64)), pa.array(home)], ["part", "leaf", "fp", "home"])

    def pairs(t: pa.Table) -> pa.Table:
        fp, home = t.column("fp").to_numpy().view(np.uint64), t.column("home").to_numpy(zero_copy_only=False)
        a, b = shard_links(fp[home], fp[~home], parts[t.column("part")[0].as_py()], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(deal, "part int, leaf int, fp long, home boolean").groupBy("part", "leaf").applyInArrow(pairs, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, for the nodes of the edges (a, b)."""
    ways = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    both = table(edges.select(F.explode(ways).alias("way")).select("way.u", "way.v").distinct(), "links")  # edges are found once
    lab = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("lab")), "labels")
    for _ in range(rounds):
        near = both.join(lab.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("lab").alias("near"))
        step = table(lab.join(near, "u").select("u", "lab", F.least("lab", "near").alias("new")), "labels")
        jump = step.select(F.col("u").alias("_at"), F.col("new").alias("_far"))
        lab2 = table(step.join(jump, step["new"] == jump["_at"]).select("u", F.least("new", "_far").alias("lab"), (F.least("new", "_far") != F.col("lab")).alias("moved")), "labels")
        lab = lab2.select("u", "lab")
        if lab2.where("moved").limit(1).count() == 0:
            return lab.select(F.col("u").alias("node"), F.col("lab").alias("root"))
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, itself included), n_links
    (other fingerprints of the component), a row for each row of docs.

    Null and wordless texts have fingerprint 0. Null doc_ids count as larger than others and have a component of null only
    if all its ids are null. Repeated rows stay. An empty table gives an empty one.
    """
    marked = table(fingerprints(docs, shingle), "simhash")
    groups = table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-groups")
    roots = components(links(groups, radius))
    of = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("first").alias("component_id"), (F.count("*") - 1).alias("n_links"))
    known = table(of.join(low, "root").select("fp", "component_id", "n_links"), "simhash-components")
    return marked.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def shingle_set(text: str | None, shingle: int = WIDE) -> np.ndarray:
    """The distinct hashes of the word shingles of a text with A-Z lower-cased, sorted; of the whole sequence if it has fewer
    words; none without words."""
    w = (text or "").encode().lower().split()
    h = np.fromiter(map(zlib.crc32, w), np.uint64, len(w)) * np.uint64(0x9E3779B97F4A7C15)
    n = max(min(1, len(h)), len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(h))):
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    out = np.sort(out ^ out >> np.uint64(29))
    return out[np.append(True, out[1:] != out[:-1])] if n else out


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys, each of the ROWS least values of the shingle hashes under one multiplier; a pair of Jaccard j shares one
    with probability 1 - (1 - j^ROWS)^BANDS: 0.999 at 0.8."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 10):
        least = np.minimum(least, (h[i : i + (1 << 10)] * MULTIPLIERS[:, None]).min(1))
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), k) for k, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def banded_texts(texts: DataFrame, shingle: int = WIDE) -> DataFrame:
    """node, band: the band keys of each different text of texts (node, text)."""

    def banded(batches):
        for b in batches:
            node, first = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)  # copies in a batch once
            keys = [band_keys(shingle_set(b.column(1)[i].as_py(), shingle)) for i in first.tolist()]
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, BANDS)), pa.array(flat.view(np.int64))], ["node", "band"])

    return texts.select("node", "text").mapInArrow(banded, "node long, band long").distinct()


def links_to_heads(sets: DataFrame, pairs: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """a, b: the pairs (a, b) whose sets (node, set) have a Jaccard of percent / 100 or more."""

    def confirmed(batches):
        for b in batches:
            x, y = ([np.frombuffer(v, np.uint64) for v in b.column(i).to_pylist()] for i in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array([alike(p, q, percent) for p, q in zip(x, y, strict=True)], pa.bool_()))

    with_sets = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return with_sets.select("a", "b", "x", "y").mapInArrow(confirmed, "a long, b long")


def matches(queries: list[np.ndarray], points: list[np.ndarray], percent: int):
    """(query, indices of the points that are alike) for each query; sets without repetitions. The points that hold a shingle are
    listed once, so a query costs what it has in common with the points."""
    size = np.array([len(p) for p in points], np.int64)
    every = np.concatenate(points) if points else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    holder = np.repeat(np.arange(len(points)), size)[order]
    every = every[order]
    for i, q in enumerate(queries):
        low, high = np.searchsorted(every, q, "left"), np.searchsorted(every, q, "right")
        n = high - low
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(low - (ends - n), n)
        both = np.bincount(holder[at], minlength=len(points))
        yield i, np.flatnonzero((100 * both >= percent * (size + len(q) - both)) & (both > 0))


def links_of_labels(bands: DataFrame, sets: DataFrame, roots: DataFrame, percent: int = SIMILAR, block: int = 1024) -> DataFrame:
    """a, b: links between roots (node, root) of which a member of each shares a band and is alike.

    In a bucket all members but those of its most frequent root are held against all members, in blocks: so every pair of a
    bucket that isn't yet in one group is compared, and a bucket that is one group costs nothing. A block returns a spanning forest of what it finds.
    """
    at = table(bands.join(roots, "node"), "near-labels")
    each = at.groupBy("band", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root"))
    mixed = each.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("k"), most.alias("m")).where("k > 1")
    cut = lambda n: F.ceil(n / F.lit(block)).cast("int")
    mixed = mixed.select("band", F.col("m.root").alias("main"), cut(F.col("n") - F.col("m.n")).alias("qs"), cut(F.col("n")).alias("ps"))
    open_ = table(at.join(mixed, "band"), "near-mixed")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_ = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = table(sets.join(open_.select("node").distinct(), "node", "left_semi"), "near-mixed-sets")
    queries = open_.where("root != main").select("band", "node", "root", mine(F.col("qs")).alias("q"), all_(F.col("ps")).alias("p")).join(held, "node")
    points = open_.select(F.col("band").alias("in_band"), "node", F.col("root").alias("of"), mine(F.col("ps")).alias("in_p"), all_(F.col("qs")).alias("in_q")).join(held, "node").select("in_band", "in_q", "in_p", "of", F.col("set").alias("held"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = ([np.frombuffer(v, np.uint64) for v in t.column(c).to_pylist()] for t, c in ((left, "set"), (right, "held")))
        of_x, of_y = (t.column(c).to_numpy().view(np.uint64) for t, c in ((left, "root"), (right, "of")))
        a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for i, found in matches(x, y, percent):
            to = np.unique(of_y[found])
            to = to[to != of_x[i]]
            a.append(np.full(len(to), of_x[i]))
            b.append(to)
        root, node = stars(np.concatenate(a), np.concatenate(b))
        return pa.table({"a": root.view(np.int64), "b": node.view(np.int64)})

    return queries.groupBy("band", "q", "p").cogroup(points.groupBy("in_band", "in_q", "in_p")).applyInArrow(compare, "a long, b long").distinct()


def simhash_pairs(texts: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: pairs of texts (node, text) to be confirmed, whose fingerprints are equal or linked: each text and the first of its
    fingerprint, and the first ones of linked fingerprints."""
    marked = table(fingerprints(texts.select(F.col("node").alias("doc_id"), "text")).distinct().withColumnRenamed("doc_id", "node"), "near-simhash")
    firsts = table(marked.groupBy("fp").agg(F.min("node").alias("first")), "near-firsts")
    copies = marked.join(firsts, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (firsts.select(F.col("fp").alias(side), F.col("first").alias(f"_{side}")) for side in ("a", "b"))
    linked = links(firsts.select("fp"), radius).join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return copies.union(linked)


def near_groups(docs: DataFrame, percent: int = SIMILAR, shingle: int = WIDE) -> DataFrame:
    """node, root for each different text of docs: its hash and that of its group. Null counts as ''.

    Texts whose SimHash fingerprints are equal or linked by the search of `links` are candidates, and texts that share a band
    key, as fingerprints of texts at `percent` are often further apart than the search goes. All members of a bucket are first held against one of them, another in each
    band, which joins most of a group of near copies at one comparison a member and band. Then whatever of a bucket isn't one
    group yet is compared with all of it. So no pair of a bucket is left out; each link is confirmed by the exact sets.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("node"), "text")

    def as_sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["node", "set"])

    bands = table(banded_texts(texts, shingle), "near-bands")
    heads = bands.groupBy("band").agg(F.min(F.struct(F.xxhash64("band", "node").alias("o"), F.col("node").alias("a"))).alias("head"), F.count("*").alias("n")).where("n > 1").select("band", F.col("head")["a"].alias("a"))
    by_band = bands.join(heads, "band").where("a != node").select("a", F.col("node").alias("b"))
    pairs = table(by_band.union(simhash_pairs(texts)).distinct(), "near-pairs")
    named = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    once = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = table(once.join(named, "node", "left_semi").select("node", "text").mapInArrow(as_sets, "node long, set binary"), "near-sets")
    found = components(links_to_heads(sets, pairs, percent))
    roots = table(named.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "near-roots")
    merged = components(links_of_labels(bands.join(named, "node", "left_semi"), sets, roots, percent))
    last = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("_to")), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return texts.select("node").distinct().join(last, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def first_of_each(docs: DataFrame, percent: int = SIMILAR, shingle: int = WIDE) -> DataFrame:
    """One row of each group of similar texts: of the smallest doc_id, null counting as larger than others, and of the
    smallest text hash where that id has several texts in the group. Of rows that share both one stays. Null and wordless
    texts are one group; an empty table gives an empty one; extra columns stay, whatever their names."""
    at = {"_node": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), "_null": F.col("doc_id").cast("long").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    marked = docs.select(*[v.alias(k) for k, v in at.items()]).groupBy("_node").agg(F.min(F.struct("_null", "_id")).alias("_low"))
    roots = near_groups(docs, percent, shingle)
    keep = marked.join(roots, marked["_node"] == roots["node"]).groupBy("root").agg(F.min(F.struct("_low", "_node")).alias("_k")).select("_k._node", "_k._low._null", "_k._low._id")
    row = docs.select(F.struct(*docs.columns).alias("_row"), *[v.alias(k) for k, v in at.items()])
    return row.join(table(keep, "near-keep"), ["_node", "_null", "_id"], "left_semi").groupBy("_node", "_null", "_id").agg(F.first("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
