"""Principal components from a Gramian summed over partitions, filters on components, and projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.sources import matrix
from obsmat.sources.scratch import kept

def added_rows(parts: DataFrame) -> np.ndarray:
    """The sum of matrices that tasks give row by row (i, row), in the order of i; one matrix row is added in one place."""

    def add(batches):
        held: dict = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                held[i] = held[i] + row if i in held else np.array(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.list_(pa.float64()))], ["i", "row"])

    out = parts.repartition("i").mapInArrow(add, "i int, row array<double>").toPandas().sort_values("i")
    return np.stack(out.row.to_list()) if len(out) else np.zeros((0, 0))


def gramian(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, column sums, X'X) of the features. Each task adds up its rows; the partial rows of the matrix are then added
    as streams, one matrix row in one place, so no task holds more than its share. The result is features x features."""

    def part(batches):
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([np.asarray(v) for v in b.column(0).to_numpy(zero_copy_only=False)])
            x = np.hstack([np.ones((len(x), 1)), x])
            total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    g = added_rows(vectors.select("features").mapInArrow(part, "i int, row array<double>"))
    if not len(g):
        raise ValueError("no rows")
    return int(round(g[0, 0])), g[0, 1:], g[1:, 1:]


def pca(vectors: DataFrame, n_comps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loadings: features x components, explained variances with ddof 1, their ratios, means). Signs: the largest loading is positive."""
    return components(*gramian(vectors), n_comps)


def components(n: int, sums: np.ndarray, xx: np.ndarray, n_comps: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from the number of rows, their sums and their Gramian."""
    mean = sums / n
    cov = (xx - n * np.outer(mean, mean)) / max(1, n - 1)
    most = max(1, min(n, len(mean)) - 1)
    n_comps = min(50 if n_comps is None else n_comps, most)
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1]
    value, vector = np.clip(value[order], 0, None), vector[:, order]
    vector = vector[:, :n_comps] * np.sign(vector[np.abs(vector[:, :n_comps]).argmax(0), np.arange(n_comps)])
    return vector, value[:n_comps], value[:n_comps] / value.sum(), mean


def sparse_pca(expr: DataFrame, n_obs: int, genes: list, n_comps: int = 50, *, spare: int = 10, rounds: int = 30, tolerance: float = 1e-7, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As pca, of n_obs rows of which expr (obs_id, gene, x) holds the non-zeros: for many genes, without a genes x genes matrix.

    A random range of n_comps + spare directions is multiplied again and again by the covariance, which takes one pass over
    the rows, until the variances along it change by less than the tolerance, or for `rounds` passes. Rows stay sparse between
    passes; a task holds a slab of them and genes x directions. The driver holds genes x directions. Values of one row and gene add up.
    """
    rows = matrix.sparse_rows(expr, genes).transform(kept)
    spark, width = expr.sparkSession, len(genes)
    most = max(1, min(n_obs, width) - 1)
    n_comps = min(n_comps, most)
    wide = min(n_comps + spare, min(n_obs, width))
    one = rows.select(F.explode(F.arrays_zip("at", "x")).alias("e")).groupBy("e.at").agg(F.sum("e.x").alias("s"), F.sum(F.col("e.x") * F.col("e.x")).alias("ss")).toPandas()  # a row for each gene
    mean, square = np.zeros(width), np.zeros(width)
    mean[one["at"].to_numpy(int)] = one["s"].to_numpy() / n_obs
    square[one["at"].to_numpy(int)] = one["ss"].to_numpy()
    total = float((square - n_obs * mean * mean).sum() / max(1, n_obs - 1))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, wide)))[0]
    before = np.zeros(n_comps)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(q)

        def part(batches):
            basis = shared.value  # noqa: B023
            shift, total_, step = mean @ basis, np.zeros_like(basis), max(1, (1 << 23) // max(1, width))
            for b in batches:
                ends = b.column(0).offsets.to_numpy()
                at, x = b.column(0).values.to_numpy(), b.column(1).values.to_numpy()
                for i in range(0, b.num_rows, step):
                    slab = ends[i : i + step + 1] if i + step < len(ends) else ends[i:]
                    dense = np.zeros((len(slab) - 1, width))
                    np.add.at(dense, (np.repeat(np.arange(len(slab) - 1), np.diff(slab)), at[slab[0] : slab[-1]]), x[slab[0] : slab[-1]])
                    total_ += dense.T @ (dense @ basis - shift)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total_), pa.list_(pa.float64()))], ["i", "row"])

        z = added_rows(rows.select("at", "x").mapInArrow(part, "i int, row array<double>")) / max(1, n_obs - 1)
        shared.unpersist()
        value, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        order = np.argsort(value)[::-1]
        value, vector = value[order], q @ turn[:, order]
        if np.abs(value[:n_comps] - before).max() <= tolerance * max(value[0], 1e-300):
            break
        before, q = value[:n_comps], np.linalg.qr(z)[0]
    value, vector = np.clip(value[:n_comps], 0, None), vector[:, :n_comps]
    vector = vector * np.sign(vector[np.abs(vector).argmax(0), np.arange(n_comps)])
    return vector, value, value / total if total > 0 else value, mean


def loadings_frame(spark, genes: list, loadings: np.ndarray) -> DataFrame:
    kind = "string" if isinstance(genes[0], str) else "long"
    return spark.createDataFrame([(g, k, float(v)) for g, row in zip(genes, loadings, strict=True) for k, v in enumerate(row)], f"gene {kind}, pc int, w double")


def project(expr: DataFrame, obs: DataFrame, loadings: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """obs_id, pc, value = sum of (x - mean) * w, for every row of obs, all-zero rows too. Loadings and means are small."""
    part = expr.join(F.broadcast(loadings), "gene").groupBy("obs_id", "pc").agg(F.sum(F.col("x") * F.col("w")).alias("part"))
    centre = loadings.withColumn("mean", F.lit(0e0)) if means is None else loadings.join(means, "gene")
    shift = centre.groupBy("pc").agg(F.sum(F.col("mean") * F.col("w")).alias("shift"))
    grid = obs.select("obs_id").crossJoin(F.broadcast(shift))  # a row for each component
    return grid.join(part, ["obs_id", "pc"], "left").select("obs_id", "pc", (F.coalesce("part", F.lit(0e0)) - F.col("shift")).alias("value"))


def project_rows(vectors: DataFrame, loadings: np.ndarray, mean: np.ndarray | None = None) -> DataFrame:
    """obs_id, features of the projected rows, in vectorised batches; other columns stay out."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast((np.asarray(loadings), np.zeros(len(loadings)) if mean is None else np.asarray(mean)))
    kind = vectors.schema["obs_id"].dataType.simpleString()

    def each(batches):
        w, m = shared.value
        for b in batches:
            if b.num_rows:
                x = np.stack([np.asarray(v) for v in b.column(1).to_numpy(zero_copy_only=False)])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list((x - m) @ w), pa.list_(pa.float64()))], ["obs_id", "features"])

    return vectors.select("obs_id", "features").mapInArrow(each, f"obs_id {kind}, features array<double>")


def latent(vectors: DataFrame) -> DataFrame:
    """obs_id, name (latent-0, ...), value."""
    return vectors.select("obs_id", F.posexplode("features").alias("i", "value")).select("obs_id", F.concat(F.lit("latent-"), F.col("i").cast("string")).alias("name"), "value")


def pearson(x: str, y: str):
    """Correlation as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def known_similarity(components: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """components: key, pc, value; known: key, mode, known (null: missing). pc and its largest absolute correlation; a mode
    with missing values, or a constant one, is like nothing."""
    both = components.join(known, key)
    each = both.groupBy("pc", "mode").agg(F.when(F.count("known") == F.count("*"), pearson("value", "known")).alias("r"))
    return each.groupBy("pc").agg(F.coalesce(F.max(F.abs("r")), F.lit(0e0)).alias("similarity"))


def filter_known(components: DataFrame, known: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """pc, similarity of the components that no known one resembles."""
    return known_similarity(components, known, key).where(F.col("similarity") <= threshold)


def filter_zscore(ratios: DataFrame, threshold: float = 2.0) -> DataFrame:
    """ratios: pc, ev (a few hundred rows at most). Those above threshold population z-scores."""
    all_ = Window.partitionBy(F.lit(0))
    spread = F.stddev_pop("ev").over(all_)
    return ratios.withColumn("z", F.when(spread > 0, (F.col("ev") - F.avg("ev").over(all_)) / F.when(spread > 0, spread)).otherwise(0e0)).where(F.col("z") > threshold)


def elbow(values) -> int:
    """How many of the variances, sorted down, stand up to the elbow."""
    v = np.sort(np.asarray(values, float))[::-1]
    if len(v) < 3:
        return len(v)
    dx, dy = len(v) - 1, v[-1] - v[0]
    length = np.hypot(dx, dy)
    dx, dy = dx / length, dy / length
    i, drop = np.arange(len(v)), v - v[0]
    along = np.sqrt((i * dx) ** 2 + (drop * dy) ** 2)
    off = np.stack([i - dx * along, drop - dy * along])
    below = np.flatnonzero((off[0] < 0) & (off[1] < 0))
    if not len(below):
        return len(v)
    return int(below[np.argmax(np.hypot(*off[:, below]))]) + 1


def filter_elbow(ratios: DataFrame) -> DataFrame:
    """The same as elbow, on a few hundred rows pc, ev."""
    all_ = Window.partitionBy(F.lit(0))
    r = ratios.withColumns({"i": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("ev"), "pc")) - 1, "n": F.count("*").over(all_), "hi": F.max("ev").over(all_), "lo": F.min("ev").over(all_)})
    length = F.sqrt((F.col("n") - 1) * (F.col("n") - 1) + (F.col("lo") - F.col("hi")) * (F.col("lo") - F.col("hi")))
    r = r.withColumns({"dx": F.when(length > 0, (F.col("n") - 1) / length).otherwise(0e0), "dy": F.when(length > 0, (F.col("lo") - F.col("hi")) / length).otherwise(0e0), "drop": F.col("ev") - F.col("hi")})
    r = r.withColumn("along", F.sqrt(F.pow(F.col("i") * F.col("dx"), 2) + F.pow(F.col("drop") * F.col("dy"), 2)))
    r = r.withColumns({"ox": F.col("i") - F.col("dx") * F.col("along"), "oy": F.col("drop") - F.col("dy") * F.col("along")})
    below = F.when((F.col("ox") < 0) & (F.col("oy") < 0), F.struct(F.sqrt(F.pow("ox", 2) + F.pow("oy", 2)).alias("d"), (-F.col("i")).alias("i")))
    return r.withColumn("at", F.coalesce(-F.max(below).over(all_)["i"], F.col("n"))).where(F.col("i") <= F.col("at")).select("pc", "ev")


def filter_components(components: DataFrame, variances: DataFrame, *, known: DataFrame | None = None, key: str = "gene", similarity: float = 0.7, method: str | None = "zscore", z: float = 2.0, max_pcs: int | None = None) -> DataFrame:
    """variances: pc, ev, evr. pc of the components kept: not like known ones, then by z-score of ratios or the elbow or all, then the first max_pcs."""
    left = variances
    if known is not None:
        left = left.join(filter_known(components, known, key, similarity).select("pc"), "pc", "left_semi")
    if method == "zscore":
        left = filter_zscore(left.select("pc", F.col("evr").alias("ev")), z)
    elif method == "elbow":
        left = filter_elbow(left.select("pc", "ev"))
    elif method is not None:
        raise ValueError(f"unknown method {method}")
    left = left.select("pc")
    return left if max_pcs is None else left.orderBy("pc").limit(max_pcs)
