"""Differential expression between pairs of clusters, from cluster statistics alone."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsmat.functions.multitest import holm, holm_rows
from obsmat.functions.special import chi2_p_value, chi2_tail, digamma, t_p_value, t_two_sided, trigamma, trigamma_inverse


@dataclass(frozen=True)
class DEThresholds:
    """Zero or None switches a filter off. `low` is the level above which a gene counts as present."""

    q1: float | None = 0.5
    q2: float | None = None
    cluster_size: int | None = 6
    qdiff: float | None = 0.7
    padj: float | None = 0.05
    lfc: float | None = 1.0
    score: float = 40.0
    low: float = 1.0
    min_genes: int = 5

    def with_(self, **changes) -> DEThresholds:
        return replace(self, **changes)


def qdiff(q1: Column, q2: Column) -> Column:
    top = F.greatest(q1, q2)
    return F.when(top == 0, 0e0).otherwise(F.abs(q1 - q2) / F.when(top == 0, 1e0).otherwise(top))


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """(a, b) with a < b of the few distinct clusters."""
    c = clusters.select("cluster").distinct()
    a, b = c.select(F.col("cluster").alias("a")), c.select(F.col("cluster").alias("b"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b"))


def pair_frame(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair and gene: a, b, gene, and n, mean, present, var of both, lfc, q1, q2, qdiff."""
    side = lambda s: stats.select(F.col("cluster").alias(s), "gene", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "present", "var")])
    both = side("a").join(pairs, "a").join(side("b"), ["b", "gene"])
    return both.withColumns({"lfc": F.col("mean_a") - F.col("mean_b"), "q1": F.col("present_a"), "q2": F.col("present_b"), "qdiff": qdiff(F.col("present_a"), F.col("present_b"))})


def chi2_statistic(q1: Column, n1: Column, q2: Column, n2: Column) -> Column:
    """Two by two table of present and absent with the continuity correction of at most a half; 0 if a margin is empty."""
    present, total = q1 * n1 + q2 * n2, (n1 + n2).cast("double")
    absent = total - present
    bad = (present <= 0) | (absent <= 0) | (n1 <= 0) | (n2 <= 0)
    expected = n1 * F.when(bad, 1e0).otherwise(present) / total
    gap = F.abs(q1 * n1 - expected)
    less = gap - F.least(F.lit(0.5), gap)
    return F.when(bad, 0e0).otherwise(less * less * total * total * total / (n1 * n2 * F.when(bad, 1e0).otherwise(present) * F.when(bad, 1e0).otherwise(absent)))


def linear_fit(stats: DataFrame) -> DataFrame:
    """gene, sigma2 (weighted by cluster sizes), df (all rows less clusters)."""
    g = stats.groupBy("gene").agg(F.sum(F.col("n") * F.col("var")).alias("s"), (F.sum("n") - F.count("*")).alias("df"))
    return g.select("gene", (F.col("s") / F.when(F.col("df") > 0, F.col("df"))).alias("sigma2"), "df")


def fit_prior(z_mean: float, z_var: float, df: float) -> tuple[float, float]:
    """(d0, s0^2) of the scaled F distribution of variances, from mean and variance of their logarithms."""
    e_mean = z_mean - digamma(df / 2) + math.log(df / 2)
    spread = z_var - trigamma(df / 2)
    if not spread > 0:
        return math.inf, math.exp(e_mean)
    d0 = 2 * trigamma_inverse(spread)
    return d0, math.exp(e_mean + digamma(d0 / 2) - math.log(d0 / 2))


def moderated(variances: np.ndarray, df: float) -> tuple[np.ndarray, float, float]:
    """(posterior variances, d0, s0^2); a prior of infinite strength gives its own variance."""
    v = np.where(variances == 0, np.finfo(float).eps, variances)
    z = np.log(v)
    d0, s0 = fit_prior(float(z.mean()), float(z.var(ddof=1)) if len(z) > 1 else 0.0, df)
    return (np.full(len(v), s0) if math.isinf(d0) else (d0 * s0 + df * v) / (df + d0)), d0, s0


def posterior(sigma2: Column, df: Column, d0: float, s0: float) -> Column:
    return F.lit(s0) if math.isinf(d0) else (F.lit(d0 * s0) + df * sigma2) / (df + F.lit(d0))


def t_statistic(post: Column) -> Column:
    return F.col("lfc") / F.sqrt(post) / F.sqrt(1 / F.col("n_a").cast("double") + 1 / F.col("n_b").cast("double"))


def pairs_chisq(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_frame with stat, p and p_adj (Holm within the pair)."""
    f = pair_frame(stats, pairs)
    f = f.withColumn("stat", chi2_statistic(F.col("q1"), F.col("n_a"), F.col("q2"), F.col("n_b")))
    return holm(f.withColumn("p", chi2_p_value(F.col("stat"))), ["a", "b"], "gene")


def pairs_ebayes(stats: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_frame with stat, p and p_adj. The prior is fitted on all clusters' variances; degrees of freedom stay the residual ones."""
    fit = linear_fit(stats)
    eps = float(np.finfo(float).eps)
    s2 = F.when(F.col("sigma2") == 0, eps).otherwise(F.col("sigma2"))
    one = fit.agg(F.avg(F.log(s2)).alias("m"), F.var_samp(F.log(s2)).alias("v"), F.max("df").alias("df")).first()  # three numbers
    d0, s0 = fit_prior(one.m, one.v if one.v is not None else 0.0, float(one.df))
    f = pair_frame(stats, pairs).join(F.broadcast(fit.select("gene", posterior(s2, F.col("df"), d0, s0).alias("post"), "df")), "gene")
    f = f.withColumn("stat", t_statistic(F.col("post")))
    return holm(f.withColumn("p", t_p_value(F.col("stat"), F.col("df").cast("double"))), ["a", "b"], "gene")


METHODS = {"chisq": pairs_chisq, "ebayes": pairs_ebayes}


def gene_filter(t: DEThresholds, up: bool) -> Column:
    """Genes higher in a (up) or in b."""
    qa, qb, size = ("q1", "q2", "n_a") if up else ("q2", "q1", "n_b")
    keep = F.col("lfc") > 0 if up else F.col("lfc") < 0
    for on, rule in ((t.padj, lambda v: F.col("p_adj") < v), (t.lfc, lambda v: F.abs("lfc") > v), (t.q1, lambda v: F.col(qa) > v), (t.cluster_size, lambda v: F.col(qa) * F.col(size) >= v), (t.q2, lambda v: F.col(qb) < v), (t.qdiff, lambda v: F.abs("qdiff") > v)):
        if on:
            keep = keep & rule(on)
    return keep


def log_score(p_adj: Column) -> Column:
    return F.when(p_adj <= 0, float("inf")).otherwise(-F.log10(F.when(p_adj > 0, p_adj).otherwise(1e0)))


def de_pairs(stats: DataFrame, pairs: DataFrame, thresholds: DEThresholds, method: str = "ebayes") -> DataFrame:
    """A row for each pair: score, up_score, down_score, num, up_num, down_num, up_genes, down_genes (by gene)."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    f = METHODS[method](stats, pairs).withColumns({"up": gene_filter(thresholds, True), "down": gene_filter(thresholds, False)})
    s = log_score(F.col("p_adj"))
    part = lambda c: F.sum(F.when(F.col(c), s).otherwise(0e0))
    return f.groupBy("a", "b").agg(
        (part("up") + part("down")).alias("score"), part("up").alias("up_score"), part("down").alias("down_score"),
        F.sum((F.col("up") | F.col("down")).cast("long")).alias("num"), F.sum(F.col("up").cast("long")).alias("up_num"), F.sum(F.col("down").cast("long")).alias("down_num"),
        F.sort_array(F.collect_list(F.when(F.col("up"), F.col("gene")))).alias("up_genes"), F.sort_array(F.collect_list(F.when(F.col("down"), F.col("gene")))).alias("down_genes"),
    )


class Stats:
    """Cluster statistics as arrays, for the merging loop: a few thousand clusters x genes at most."""

    def __init__(self, labels: list, genes: list, n, mean, present, var):
        self.labels, self.genes = list(labels), list(genes)
        self.n, self.mean, self.present, self.var = (np.asarray(x, float) for x in (n, mean, present, var))

    @classmethod
    def collect(cls, stats: DataFrame, most: int = 10_000_000) -> Stats:
        p: pd.DataFrame = stats.limit(most + 1).toPandas()
        if len(p) > most:
            raise ValueError(f"more than {most} statistics")
        wide = {c: p.pivot(index="cluster", columns="gene", values=c).sort_index() for c in ("n", "mean", "present", "var")}
        return cls(list(wide["mean"].index), list(wide["mean"].columns), wide["n"].iloc[:, 0], wide["mean"], wide["present"], wide["var"])

    def index(self, label) -> int:
        return self.labels.index(label)

    def merge(self, source, into, variance_merge: str = "exact") -> None:
        """Adds source's rows to into. Variances by sums of squares; `compat` leaves out the shift of the receiving cluster."""
        i, j = self.index(source), self.index(into)
        n1, n2 = self.n[i], self.n[j]
        n = n1 + n2
        mean = (self.mean[i] * n1 + self.mean[j] * n2) / n
        shift = n1 * (self.mean[i] - mean) ** 2 + (n2 * (self.mean[j] - mean) ** 2 if variance_merge == "exact" else 0)
        self.var[j] = ((n1 - 1) * self.var[i] + (n2 - 1) * self.var[j] + shift) / (n - 1)
        self.present[j] = (self.present[i] * n1 + self.present[j] * n2) / n
        self.mean[j], self.n[j] = mean, n
        self.labels.pop(i)
        for name in ("n", "mean", "present", "var"):
            setattr(self, name, np.delete(getattr(self, name), i, axis=0))

    def prior(self) -> tuple[np.ndarray, float]:
        """(moderated variance of each gene, residual degrees of freedom)."""
        df = float(self.n.sum() - len(self.labels))
        return moderated((self.n[:, None] * self.var).sum(0) / df, df)[0], df

    def de(self, pairs: list[tuple], t: DEThresholds, method: str = "ebayes") -> list[dict]:
        """As de_pairs, for the loop."""
        at = {c: k for k, c in enumerate(self.labels)}
        prior, out = self.prior() if method == "ebayes" else None, []
        for s in range(0, len(pairs), step := max(1, (1 << 20) // max(1, len(self.genes)))):
            some = pairs[s : s + step]
            i, j = (np.array([at[p[k]] for p in some], np.int64) for k in (0, 1))
            up, down, score = compared(self.side(i), self.side(j), t, method, prior)
            for r, (a, b) in enumerate(some):
                u, d = np.flatnonzero(up[r]), np.flatnonzero(down[r])
                us, ds = float(score[r, u].sum()) + 0.0, float(score[r, d].sum()) + 0.0
                out.append({"a": a, "b": b, "score": us + ds, "up_score": us, "down_score": ds, "num": len(u) + len(d), "up_num": len(u), "down_num": len(d), "up_genes": [self.genes[k] for k in u], "down_genes": [self.genes[k] for k in d]})
        return out

    def side(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, mean, present) of the clusters at these places."""
        return self.n[at], self.mean[at], self.present[at]

    def first_genes(self, t: DEThresholds, method: str, most: int) -> set:
        """The first `most` up and down genes of all pairs of clusters."""
        prior, seen = self.prior() if method == "ebayes" else None, np.zeros(len(self.genes), bool)
        i, j = np.triu_indices(len(self.labels), 1)
        for s in range(0, len(i), step := max(1, (1 << 20) // max(1, len(self.genes)))):
            for mask in compared(self.side(i[s : s + step]), self.side(j[s : s + step]), t, method, prior)[:2]:
                seen |= (mask & (mask.cumsum(1) <= most)).any(0)
        return {g for g, on in zip(self.genes, seen.tolist(), strict=True) if on}


def compared(a, b, t: DEThresholds, method: str = "ebayes", prior: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(up genes, down genes, -log10 of the adjusted p) of pairs of clusters, a row a pair and a column a gene. a, b: (n, mean,
    present) of both sides; prior: moderated variances and degrees of freedom, for ebayes."""
    (n1, mean1, q1), (n2, mean2, q2) = a, b
    n1, n2, lfc = n1[:, None], n2[:, None], mean1 - mean2
    if method == "ebayes":
        post, df = prior
        p = t_two_sided(lfc / np.sqrt(post) / np.sqrt(1 / n1 + 1 / n2), df)
    elif method == "chisq":
        yes, total = q1 * n1 + q2 * n2, n1 + n2
        bad = (yes <= 0) | (yes >= total)
        safe = np.where(bad, total / 2, yes)
        gap = np.abs(q1 * n1 - n1 * safe / total)
        p = np.where(bad, 1.0, chi2_tail((gap - np.minimum(0.5, gap)) ** 2 * total**3 / (n1 * n2 * safe * (total - safe))))
    else:
        raise ValueError(f"unknown method {method}")
    adj, top = holm_rows(p), np.maximum(q1, q2)
    qd = np.where(top == 0, 0, np.abs(q1 - q2) / np.where(top == 0, 1, top))
    kept = []
    for sign, qa, qb, size in ((1, q1, q2, n1), (-1, q2, q1, n2)):
        keep = sign * lfc > 0
        for on, ok in ((t.padj, lambda v: adj < v), (t.lfc, lambda v: np.abs(lfc) > v), (t.q1, lambda v: qa > v), (t.cluster_size, lambda v: qa * size >= v), (t.q2, lambda v: qb < v), (t.qdiff, lambda v: qd > v)):  # noqa: B023
            if on:
                keep = keep & ok(on)
        kept.append(keep)
    with np.errstate(divide="ignore"):
        return kept[0], kept[1], -np.log10(adj)


def de_pairs_in_blocks(stats: DataFrame, thresholds: DEThresholds, method: str = "ebayes", *, block: int = 32, genes_most: int = 200_000) -> DataFrame:
    """As de_pairs, for all pairs of clusters: blocks of clusters meet in pairs, a cluster being one row with its genes in order.
    So clusters are sent (clusters / block) times, pairs are never listed before they are compared, and Holm's correction
    is done in the task that has the pair. Only the gene table is broadcast; its size is checked. Statistics must be complete
    (clusters x genes), as cluster_stats gives them; an empty table gives an empty one."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    kind, gene_kind = (stats.schema[c].dataType.simpleString() for c in ("cluster", "gene"))
    fit = linear_fit(stats).orderBy("gene").limit(genes_most + 1).toPandas()
    if len(fit) > genes_most:
        raise ValueError(f"more than {genes_most} genes")
    prior = None
    if method == "ebayes" and len(fit):
        df = float(fit.df.max())
        prior = moderated(fit.sigma2.to_numpy(float), df)[0], df
    names = fit.gene.tolist()
    shared = stats.sparkSession.sparkContext.broadcast((names, prior))
    one = F.sort_array(F.collect_list(F.struct("gene", "mean", "present")))  # a row for each gene of one cluster
    wide = stats.groupBy("cluster").agg(F.max("n").cast("double").alias("n"), one.alias("s")).select("cluster", "n", F.col("s.mean").alias("mean"), F.col("s.present").alias("present"))
    blocks = F.lit(max(1, math.ceil(stats.select("cluster").distinct().count() / block)))
    wide = wide.withColumn("block", F.pmod(F.xxhash64("cluster"), blocks).cast("int"))
    ups = F.explode(F.sequence(F.col("block"), blocks - 1))
    downs = F.explode(F.sequence(F.lit(0), F.col("block")))
    left = wide.select("cluster", "n", "mean", "present", F.col("block").alias("i"), ups.alias("j"))
    right = wide.select(F.col("cluster").alias("cluster_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("present").alias("present_b"), F.col("block").alias("j_b"), downs.alias("i_b"))
    schema = f"a {kind}, b {kind}, score double, up_score double, down_score double, num long, up_num long, down_num long, up_genes array<{gene_kind}>, down_genes array<{gene_kind}>"

    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        genes, fitted = shared.value
        rows = []
        if x.num_rows and y.num_rows:
            sides = []
            for t, end in ((x, ""), (y, "_b")):
                wide_ = [np.stack([np.asarray(v) for v in t.column(c + end).to_numpy()]) for c in ("mean", "present")]
                sides.append((t.column(f"cluster{end}").to_pylist(), t.column(f"n{end}").to_numpy(), *wide_))
            same = x.column("i")[0].as_py() == x.column("j")[0].as_py()
            pairs = [(p, q) for p, a in enumerate(sides[0][0]) for q, b in enumerate(sides[1][0]) if (a < b if same else a != b)]
            for s in range(0, len(pairs), step := max(1, (1 << 20) // max(1, len(genes)))):
                some = pairs[s : s + step]
                p, q = np.array(some, np.int64).T
                flip = np.array([sides[0][0][k] > sides[1][0][m] for k, m in some])
                va, vb = ([v[k] for v in side[1:]] for side, k in ((sides[0], p), (sides[1], q)))
                first, second = ([np.where(flip if v.ndim == 1 else flip[:, None], w, v) for v, w in zip(m, n, strict=True)] for m, n in ((va, vb), (vb, va)))
                up, down, score = compared(tuple(first), tuple(second), thresholds, method, fitted)
                for r, (k, m) in enumerate(some):
                    a, b = sorted((sides[0][0][k], sides[1][0][m]))
                    u, d = np.flatnonzero(up[r]), np.flatnonzero(down[r])
                    us, ds = float(score[r, u].sum()) + 0.0, float(score[r, d].sum()) + 0.0
                    rows.append((a, b, us + ds, us, ds, len(u) + len(d), len(u), len(d), [genes[g] for g in u], [genes[g] for g in d]))
        id_kind = x.schema.field("cluster").type if "cluster" in x.column_names else y.schema.field("cluster_b").type
        gene_type = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[gene_kind]
        kinds = [id_kind, id_kind, *[pa.float64()] * 3, *[pa.int64()] * 3, *[pa.list_(gene_type)] * 2]
        names_ = [c.split()[0] for c in schema.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 10, kinds, strict=True)], names=names_)

    return left.groupBy("i", "j").cogroup(right.groupBy("i_b", "j_b")).applyInArrow(meet, schema)


def marker_genes(de: DataFrame, n_markers: int = 20) -> DataFrame:
    """Union of the first n_markers up and down genes of each pair, in gene order."""
    firsts = F.concat(F.slice("up_genes", 1, n_markers), F.slice("down_genes", 1, n_markers))
    return de.select(F.explode(firsts).alias("gene")).distinct()
