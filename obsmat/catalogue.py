"""Registry of the matrix queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsmat.functions.multitest import benjamini_hochberg, holm, rounded
from obsmat.operators import community, de, hvg, knn, merging, moments, pca
from obsmat.operators.normalize import normalize
from obsmat.plans import clustering
from obsmat.sources import matrix
from obsmat.sources.scratch import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

T = de.DEThresholds(q1=0.5, q2=0.9, cluster_size=4, qdiff=0.05, padj=0.9, lfc=0.05, score=3.0, low=1.0, min_genes=1)

_COUNTS = "counts AS (SELECT o_custkey AS obs_id, p_brand AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
_EXPR = _COUNTS + ", expr AS (SELECT obs_id, gene, ln(1 + cnt * 1e6 / sum(cnt) OVER (PARTITION BY obs_id)) AS x FROM counts)"
_DENSE = _EXPR + ", assign AS (SELECT c_custkey AS obs_id, c_mktsegment AS cluster FROM customer), dense AS (SELECT a.obs_id, a.cluster, g.gene, coalesce(e.x, 0e0) AS x FROM assign a CROSS JOIN (SELECT DISTINCT gene FROM counts) g LEFT JOIN expr e ON e.obs_id = a.obs_id AND e.gene = g.gene)"
_STATS = _DENSE + ", stats AS (SELECT cluster, gene, count(*) AS n, avg(x) AS mean, avg(CASE WHEN x > 1 THEN 1e0 ELSE 0e0 END) AS present, coalesce(var_samp(x), 0e0) AS var FROM dense GROUP BY 1, 2)"
_PAIRS = _STATS + """, pg AS (SELECT a.cluster AS a, b.cluster AS b, a.gene, a.n AS n_a, b.n AS n_b, a.mean - b.mean AS lfc, a.present AS q1, b.present AS q2,
  CASE WHEN greatest(a.present, b.present) = 0 THEN 0e0 ELSE abs(a.present - b.present) / greatest(a.present, b.present) END AS qdiff
  FROM stats a JOIN stats b ON a.gene = b.gene AND a.cluster < b.cluster)"""
_CHI = _PAIRS + """, chi AS (SELECT *, CASE WHEN q1 * n_a + q2 * n_b <= 0 OR (n_a + n_b) - (q1 * n_a + q2 * n_b) <= 0 THEN 0e0 ELSE
  pow(abs(q1 * n_a - n_a * (q1 * n_a + q2 * n_b) / (n_a + n_b)::DOUBLE) - least(0.5e0, abs(q1 * n_a - n_a * (q1 * n_a + q2 * n_b) / (n_a + n_b)::DOUBLE)), 2)
  * pow((n_a + n_b)::DOUBLE, 3) / (n_a::DOUBLE * n_b * (q1 * n_a + q2 * n_b) * ((n_a + n_b) - (q1 * n_a + q2 * n_b))) END AS stat FROM pg),
  surrogate AS (SELECT *, exp(-stat / 2) AS p FROM chi)"""
_LONG = "long AS (SELECT vec_id AS obs_id, label AS cluster, unnest(range(len(embedding)))::INT AS gene, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_CENTRE = _LONG + ", centre AS (SELECT cluster, gene, avg(x) AS mean FROM long GROUP BY 1, 2)"


def _r(sql: str) -> str:
    return f"(round({sql}, 6) + 0e0)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def m1(spark, d, target: float | None = 1e6) -> DataFrame:
    return normalize(matrix.order_counts(spark, d), target)


def m1_stats(spark, d) -> DataFrame:
    return moments.cluster_stats(m1(spark, d), matrix.customer_segments(spark, d))


def m1_pairs(spark, d) -> DataFrame:
    stats = m1_stats(spark, d)
    return de.pair_frame(stats, de.cluster_pairs(matrix.customer_segments(spark, d)))


def m2(spark, d) -> DataFrame:
    return matrix.embedding_vectors(spark, d)


def m2_centres(spark, d) -> DataFrame:
    return matrix.long_form(m2(spark, d), "cluster").groupBy("cluster", "gene").agg(F.avg("x").alias("mean"))


# --- projections, filters, sources


@query(f"WITH {_EXPR} SELECT obs_id, gene, {_r('x')} AS x FROM expr")
def normalize_log_cpm(spark, d):
    return m1(spark, d).select("obs_id", "gene", rounded(F.col("x")).alias("x"))


@query(f"WITH {_COUNTS}, t AS (SELECT obs_id, sum(cnt) AS t FROM counts GROUP BY 1), m AS (SELECT quantile_cont(t, 0.5) AS target FROM t WHERE t > 0) SELECT obs_id, gene, {_r('ln(1 + cnt * target / t)')} AS x FROM counts JOIN t USING (obs_id), m")
def normalize_median_target(spark, d):
    return m1(spark, d, None).select("obs_id", "gene", rounded(F.col("x")).alias("x"))


@query(f"WITH {_EXPR} SELECT obs_id, gene, {_r('x')} AS x FROM expr WHERE gene IN (SELECT gene FROM expr GROUP BY gene HAVING sum(CASE WHEN x > 10.3 THEN 1 ELSE 0 END) >= 400)")
def select_genes(spark, d):
    x = kept(m1(spark, d))
    genes = moments.gene_mask(moments.gene_moments(x, 1, low=10.3), 400)
    return matrix.select_genes(x, genes).select("obs_id", "gene", rounded(F.col("x")).alias("x"))


@query(f"WITH {_EXPR} SELECT obs_id, gene, {_r('x')} AS x FROM expr WHERE obs_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def select_cells(spark, d):
    obs = matrix.customer_segments(spark, d).where("cluster = 'BUILDING'")
    return matrix.select_cells(m1(spark, d), obs).select("obs_id", "gene", rounded(F.col("x")).alias("x"))


@query("SELECT obs_id, cluster FROM (SELECT c_custkey AS obs_id, c_mktsegment AS cluster, row_number() OVER (PARTITION BY c_mktsegment ORDER BY ((c_custkey + 123) * 2654435761) % 4294967296, c_custkey) AS r FROM customer) WHERE r <= 20")
def sample_cells_per_cluster(spark, d):
    return clustering.sample_clusters(matrix.customer_segments(spark, d), 20, 123)


@query("SELECT vec_id AS obs_id, 'latent-' || i AS name, x AS value FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def latent_project(spark, d):
    return pca.latent(m2(spark, d))


@query("SELECT c_custkey AS obs_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS mode FROM customer")
def known_modes_left_join(spark, d):
    c = matrix.read(spark, d, "customer")
    modes = c.where("c_acctbal > 0").select(F.col("c_custkey").alias("obs_id"), F.col("c_acctbal").alias("mode"))
    return matrix.aligned_modes(c.select(F.col("c_custkey").alias("obs_id")), modes)


@query("SELECT p_partkey AS pos, CASE WHEN n = 0 THEN p_brand ELSE p_brand || '-' || n END AS gene FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)")
def unique_gene_names(spark, d):
    return matrix.unique_names(matrix.read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("gene"))).select("pos", "gene")


@query("SELECT l_orderkey, l_linenumber, l_quantity::FLOAT::DOUBLE AS count FROM lineitem")
def cast_counts(spark, d):
    rows = matrix.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("float").alias("count"))
    return matrix.cast_same_kind(rows, "count", "double")


# --- aggregations


@query(f"WITH {_DENSE}, y AS (SELECT gene, x, exp(x) - 1 AS y FROM dense) SELECT gene, sum(CASE WHEN x > 1 THEN 1 ELSE 0 END)::BIGINT AS n_present, {_r('avg(y)')} AS mean, {_r('var_samp(y) / 1e6')} AS var_samp_m, {_r('var_pop(y) / 1e6')} AS var_pop_m FROM y GROUP BY gene")
def gene_moments(spark, d):
    x = m1(spark, d)
    n = matrix.read(spark, d, "customer").count()
    g = moments.gene_moments(x, n)
    return g.select("gene", "n_present", rounded(F.col("mean")).alias("mean"), rounded(F.col("var") / 1e6).alias("var_samp_m"), rounded(F.col("var") * (n - 1) / n / 1e6).alias("var_pop_m"))


@query(f"WITH {_EXPR} SELECT gene, sum(CASE WHEN x > 10.3 THEN 1 ELSE 0 END)::BIGINT AS n_present FROM expr GROUP BY gene HAVING sum(CASE WHEN x > 10.3 THEN 1 ELSE 0 END) >= 400")
def gene_mask(spark, d):
    return moments.gene_mask(moments.gene_moments(m1(spark, d), 1, low=10.3), 400).select("gene", "n_present")


@query(f"WITH {_STATS} SELECT cluster, gene, n, {_r('mean')} AS mean, {_r('present')} AS present, {_r('var')} AS var FROM stats")
def cluster_means(spark, d):
    return m1_stats(spark, d).select("cluster", "gene", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "present", "var")])


@query(f"WITH {_LONG} SELECT cluster, gene, count(*) AS n, {_r('avg(x)')} AS mean, {_r('avg(CASE WHEN x > 1 THEN 1e0 ELSE 0e0 END)')} AS present, {_r('coalesce(var_samp(x), 0e0)')} AS var FROM long GROUP BY 1, 2")
def cluster_means_embeddings(spark, d):
    v = m2(spark, d)
    s = moments.cluster_stats(matrix.long_form(v), v.select("obs_id", "cluster"))
    return s.select("cluster", "gene", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "present", "var")])


@query("SELECT c_mktsegment AS cluster, count(*) AS n FROM customer GROUP BY 1")
def cluster_sizes(spark, d):
    return moments.cluster_sizes(matrix.customer_segments(spark, d))


@query("SELECT c_nationkey AS cluster, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) < 60")
def small_clusters(spark, d):
    return moments.cluster_sizes(matrix.read(spark, d, "customer").select(F.col("c_nationkey").alias("cluster"))).where("n < 60")


@query("SELECT c_nationkey AS cluster, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1")
def cluster_members(spark, d):
    assign = matrix.read(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_nationkey").alias("cluster"))
    return moments.cluster_members(assign).select("cluster", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query("SELECT c_custkey AS obs_id, (c_mktsegment = 'AUTOMOBILE') AS automobile, (c_mktsegment = 'BUILDING') AS building, (c_mktsegment = 'FURNITURE') AS furniture, (c_mktsegment = 'HOUSEHOLD') AS household, (c_mktsegment = 'MACHINERY') AS machinery FROM customer")
def one_hot_clusters(spark, d):
    return moments.one_hot(matrix.customer_segments(spark, d))


@query("SELECT c_custkey AS obs_id, dense_rank() OVER (ORDER BY c_mktsegment)::INT AS cluster_id FROM customer")
def cluster_dict_ids(spark, d):
    return moments.cluster_ids(matrix.customer_segments(spark, d))


@query(f"WITH {_STATS} SELECT gene, n, {_r('mean')} AS mean, {_r('var')} AS var FROM (SELECT gene, count(*) AS n, avg(x) AS mean, var_samp(x) AS var FROM dense WHERE cluster IN ('BUILDING', 'MACHINERY') GROUP BY gene)")
def merge_two_cluster_stats(spark, d):
    mapping = spark.createDataFrame([("MACHINERY", "BUILDING")], "cluster string, into string")
    s = moments.merge_stats(m1_stats(spark, d).where("cluster IN ('BUILDING', 'MACHINERY')"), mapping)
    return s.select("gene", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("var")).alias("var"))


_FIT = _STATS + ", fit AS (SELECT gene, sum(n * var) / (sum(n) - count(*)) AS sigma2, (sum(n) - count(*))::BIGINT AS df FROM stats GROUP BY gene)"


@query(f"WITH {_FIT} SELECT gene, {_r('sigma2')} AS sigma2, df FROM fit")
def linear_fit_sigma(spark, d):
    return de.linear_fit(m1_stats(spark, d)).select("gene", rounded(F.col("sigma2")).alias("sigma2"), "df")


@query(f"WITH {_FIT} SELECT {_r('avg(ln(sigma2))')} AS z_mean, {_r('var_samp(ln(sigma2))')} AS z_var, max(df) AS df FROM fit")
def fdist_moments(spark, d):
    f = de.linear_fit(m1_stats(spark, d))
    return f.agg(rounded(F.avg(F.log("sigma2"))).alias("z_mean"), rounded(F.var_samp(F.log("sigma2"))).alias("z_var"), F.max("df").alias("df"))


@query(f"WITH {_FIT} SELECT gene, {_r('(4e0 * 0.5e0 + df * sigma2) / (df + 4e0)')} AS post FROM fit")
def moderated_variance_fixed_prior(spark, d):
    return de.linear_fit(m1_stats(spark, d)).select("gene", rounded(de.posterior(F.col("sigma2"), F.col("df"), 4.0, 0.5)).alias("post"))


@query(f"WITH {_FIT}, post AS (SELECT gene, (4e0 * 0.5e0 + df * sigma2) / (df + 4e0) AS post FROM fit), pg AS (SELECT a.cluster AS a, b.cluster AS b, a.gene, a.n AS n_a, b.n AS n_b, a.mean - b.mean AS lfc FROM stats a JOIN stats b ON a.gene = b.gene AND a.cluster < b.cluster) SELECT a, b, gene, {_r('lfc / sqrt(post) / sqrt(1e0 / n_a + 1e0 / n_b)')} AS t FROM pg JOIN post USING (gene)")
def pair_t_stat(spark, d):
    post = de.linear_fit(m1_stats(spark, d)).select("gene", de.posterior(F.col("sigma2"), F.col("df"), 4.0, 0.5).alias("post"))
    return m1_pairs(spark, d).join(F.broadcast(post), "gene").select("a", "b", "gene", rounded(de.t_statistic(F.col("post"))).alias("t"))


@query(f"WITH {_CHI} SELECT a, b, gene, {_r('stat')} AS stat FROM chi")
def pair_chisq_stat(spark, d):
    return m1_pairs(spark, d).select("a", "b", "gene", rounded(de.chi2_statistic(F.col("q1"), F.col("n_a"), F.col("q2"), F.col("n_b"))).alias("stat"))


@query(f"WITH {_PAIRS} SELECT a, b, gene, {_r('lfc')} AS lfc, {_r('qdiff')} AS qdiff FROM pg")
def qdiff_lfc(spark, d):
    return m1_pairs(spark, d).select("a", "b", "gene", rounded(F.col("lfc")).alias("lfc"), rounded(F.col("qdiff")).alias("qdiff"))


def _surrogate(spark, d):
    f = m1_pairs(spark, d)
    return f.withColumn("p", F.exp(-de.chi2_statistic(F.col("q1"), F.col("n_a"), F.col("q2"), F.col("n_b")) / 2))


_HOLM = _CHI + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p, gene) AS rk, count(*) OVER (PARTITION BY a, b) AS m FROM surrogate), adj AS (SELECT *, least(1e0, max(p * (m - rk + 1)) OVER (PARTITION BY a, b ORDER BY rk)) AS p_adj FROM ranked)"
_UP = "lfc > 0 AND p_adj < 0.9 AND abs(lfc) > 0.05 AND q1 > 0.5 AND q1 * n_a >= 4 AND q2 < 0.9 AND abs(qdiff) > 0.05"
_DOWN = "lfc < 0 AND p_adj < 0.9 AND abs(lfc) > 0.05 AND q2 > 0.5 AND q2 * n_b >= 4 AND q1 < 0.9 AND abs(qdiff) > 0.05"


@query(f"WITH {_HOLM} SELECT a, b, gene, {_r('p_adj')} AS p_adj FROM adj")
def holm_adjust(spark, d):
    return holm(_surrogate(spark, d), ["a", "b"], "gene").select("a", "b", "gene", rounded(F.col("p_adj")).alias("p_adj"))


@query(f"WITH {_CHI}, ranked AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY p, gene) AS rk, count(*) OVER (PARTITION BY a, b) AS m FROM surrogate) SELECT a, b, gene, {_r('least(1e0, min(p * m / rk) OVER (PARTITION BY a, b ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS p_adj FROM ranked")
def bh_adjust(spark, d):
    return benjamini_hochberg(_surrogate(spark, d), ["a", "b"], "gene").select("a", "b", "gene", rounded(F.col("p_adj")).alias("p_adj"))


@query(f"WITH {_HOLM} SELECT a, b, gene FROM adj WHERE {_UP}")
def de_filter_up(spark, d):
    return holm(_surrogate(spark, d), ["a", "b"], "gene").where(de.gene_filter(T, True)).select("a", "b", "gene")


@query(f"WITH {_HOLM} SELECT a, b, gene FROM adj WHERE {_DOWN}")
def de_filter_down(spark, d):
    return holm(_surrogate(spark, d), ["a", "b"], "gene").where(de.gene_filter(T, False)).select("a", "b", "gene")


@query(f"WITH {_HOLM} SELECT a, b, {_r('sum(-log10(p_adj))')} AS score FROM adj GROUP BY a, b")
def de_score(spark, d):
    return holm(_surrogate(spark, d), ["a", "b"], "gene").groupBy("a", "b").agg(rounded(F.sum(de.log_score(F.col("p_adj")))).alias("score"))


def _de(spark, d, method):
    x = de.de_pairs(m1_stats(spark, d), de.cluster_pairs(matrix.customer_segments(spark, d)), T, method)
    return x.select("a", "b", "score", "num", F.array_join("up_genes", ",").alias("up_genes"), F.array_join("down_genes", ",").alias("down_genes"))


@query()
def de_pairs_chisq(spark, d):
    return _de(spark, d, "chisq")


@query()
def de_pairs_ebayes(spark, d):
    return _de(spark, d, "ebayes")


@query()
def de_pairs_in_blocks(spark, d):
    """All pairs of the brands' customers by nation: 25 clusters in blocks of eight."""
    nations = matrix.read(spark, d, "customer").select(F.col("c_custkey").alias("obs_id"), F.col("c_nationkey").cast("int").alias("cluster"))
    x = de.de_pairs_in_blocks(kept(moments.cluster_stats(m1(spark, d), nations)), T, "ebayes", block=8)
    return x.select("a", "b", "score", "num", F.array_join("up_genes", ",").alias("up_genes"), F.array_join("down_genes", ",").alias("down_genes"))


@query()
def marker_genes(spark, d):
    return clustering.markers(m1(spark, d), matrix.customer_segments(spark, d), T, 5)


@query("SELECT DISTINCT a.c_mktsegment AS a, b.c_mktsegment AS b FROM customer a JOIN customer b ON a.c_mktsegment < b.c_mktsegment")
def cluster_pairs(spark, d):
    return de.cluster_pairs(matrix.customer_segments(spark, d))


# --- variable genes, components


_DISP = _DENSE + ", y AS (SELECT gene, exp(x) - 1 AS y FROM dense), mom AS (SELECT gene, avg(y) AS mean, var_samp(y) AS var FROM y GROUP BY gene), disp AS (SELECT gene, ln(1 + var / (mean + 1e-10)) AS dispersion FROM mom), q AS (SELECT quantile_cont(dispersion, 0.25) AS lo, quantile_cont(dispersion, 0.75) AS hi FROM disp), zs AS (SELECT gene, dispersion, (dispersion - (lo + hi) / 2) / ((hi - lo) / 1.3489795003921634) AS z FROM disp, q)"


def _z(spark, d):
    g = moments.gene_moments(m1(spark, d), matrix.read(spark, d, "customer").count())
    return hvg.robust_z(hvg.dispersion(g), "dispersion")


@query(f"WITH {_DISP} SELECT gene, {_r('dispersion')} AS dispersion, {_r('z')} AS z FROM zs")
def dispersion_zscore(spark, d):
    return _z(spark, d).select("gene", rounded(F.col("dispersion")).alias("dispersion"), rounded(F.col("z")).alias("z"))


@query(f"WITH {_DISP} SELECT gene, {_r('z')} AS z FROM zs ORDER BY z DESC, gene LIMIT 10")
def hvg_rank_no_loess(spark, d):
    return _z(spark, d).orderBy(F.desc("z"), "gene").limit(10).select("gene", rounded(F.col("z")).alias("z"))


@query()
def highly_variable_genes(spark, d):
    return hvg.highly_variable(moments.gene_moments(m1(spark, d), matrix.read(spark, d, "customer").count()), max_genes=10)


@query(f"WITH {_LONG} SELECT a.gene AS i, b.gene AS j, {_r('covar_samp(a.x, b.x)')} AS cov FROM long a JOIN long b ON a.obs_id = b.obs_id AND a.gene <= b.gene GROUP BY 1, 2")
def pca_gram(spark, d):
    n, s, xx = pca.gramian(m2(spark, d))
    cov = (xx - n * (s / n)[:, None] * (s / n)[None, :]) / (n - 1)
    out = spark.createDataFrame([(i, j, float(cov[i, j])) for i in range(len(s)) for j in range(i, len(s))], "i int, j int, cov double")
    return out.select("i", "j", rounded(F.col("cov")).alias("cov"))


@query()
def pca_loadings(spark, d):
    v, _, _, _ = pca.pca(m2(spark, d), 10)
    return pca.loadings_frame(spark, list(range(len(v))), v)


@query()
def pca_loadings_sparse(spark, d):
    """The order matrix, by passes over its sparse rows."""
    x = kept(m1(spark, d))
    genes = sorted(r.gene for r in x.select("gene").distinct().collect())  # brands
    v, _, _, _ = pca.sparse_pca(x, x.select("obs_id").distinct().count(), genes, 5)
    return pca.loadings_frame(spark, genes, v)


_W = "w AS (SELECT g.i::INT AS gene, p.k::INT AS pc, (((g.i * 7 + p.k * 3) % 11) - 5) / 10e0 AS w FROM range(64) g(i), range(5) p(k))"


@query(f"WITH {_LONG}, {_W}, mu AS (SELECT gene, avg(x) AS m FROM long GROUP BY gene) SELECT obs_id, pc, {_r('sum((x - m) * w)')} AS value FROM long JOIN mu USING (gene) JOIN w USING (gene) GROUP BY 1, 2")
def project_fixed_loadings(spark, d):
    v = m2(spark, d)
    long = matrix.long_form(v)
    w = spark.createDataFrame([(g, k, ((g * 7 + k * 3) % 11 - 5) / 10) for g in range(64) for k in range(5)], "gene int, pc int, w double")
    out = pca.project(long, v, w, long.groupBy("gene").agg(F.avg("x").alias("mean")))
    return out.select("obs_id", "pc", rounded(F.col("value")).alias("value"))


_KNOWN = "known AS (SELECT vec_id AS obs_id, embedding[1]::DOUBLE + embedding[2]::DOUBLE AS known FROM embeddings)"


@query(f"WITH {_LONG}, {_KNOWN} SELECT gene AS pc, {_r('abs(corr(x, known))')} AS similarity FROM long JOIN known USING (obs_id) GROUP BY gene HAVING abs(corr(x, known)) <= 0.5")
def filter_known_modes(spark, d):
    v = m2(spark, d)
    known = v.select("obs_id", F.lit(0).alias("mode"), (F.col("features")[0] + F.col("features")[1]).alias("known"))
    out = pca.filter_known(matrix.long_form(v).withColumnsRenamed({"gene": "pc", "x": "value"}), known, "obs_id", 0.5)
    return out.select("pc", rounded(F.col("similarity")).alias("similarity"))


@query(f"WITH {_CENTRE} SELECT pc, {_r('max(r)')} AS similarity FROM (SELECT a.cluster AS pc, b.cluster AS mode, abs(corr(a.mean, b.mean)) AS r FROM centre a JOIN centre b ON a.gene = b.gene AND b.cluster < 2 GROUP BY 1, 2) GROUP BY pc HAVING max(r) <= 0.7")
def filter_known_components(spark, d):
    c = m2_centres(spark, d)
    known = c.where("cluster < 2").select("gene", F.col("cluster").alias("mode"), F.col("mean").alias("known"))
    out = pca.filter_known(c.select("gene", F.col("cluster").alias("pc"), F.col("mean").alias("value")), known, "gene", 0.7)
    return out.select("pc", rounded(F.col("similarity")).alias("similarity"))


_BETWEEN = _CENTRE + ", between AS (SELECT gene AS pc, var_pop(mean) AS v FROM centre GROUP BY gene), ev AS (SELECT pc, v / (SELECT sum(v) FROM between) AS ev FROM between)"


def _shares(spark, d):
    """Each coordinate's share of the variance between the labels' means, over the whole embeddings."""
    v = m2_centres(spark, d).groupBy(F.col("gene").alias("pc")).agg(F.var_pop("mean").alias("v"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("v").alias("all")))).select("pc", (F.col("v") / F.col("all")).alias("ev"))


@query(f"WITH {_BETWEEN} SELECT pc, {_r('z')} AS z FROM (SELECT pc, (ev - avg(ev) OVER ()) / stddev_pop(ev) OVER () AS z FROM ev) WHERE z > 1")
def filter_ev_zscore(spark, d):
    return pca.filter_zscore(_shares(spark, d), 1.0).select("pc", rounded(F.col("z")).alias("z"))


@query(f"""WITH {_BETWEEN}, wide AS (SELECT pc, ev * 10000 AS ev FROM ev), b AS (SELECT pc, ev, row_number() OVER (ORDER BY ev DESC, pc) - 1 AS i, count(*) OVER () AS n, max(ev) OVER () AS hi, min(ev) OVER () AS lo FROM wide),
c AS (SELECT *, (n - 1) / sqrt(pow(n - 1, 2) + pow(lo - hi, 2)) AS dx, (lo - hi) / sqrt(pow(n - 1, 2) + pow(lo - hi, 2)) AS dy, ev - hi AS dr FROM b),
o AS (SELECT *, i - dx * sqrt(pow(i * dx, 2) + pow(dr * dy, 2)) AS ox, dr - dy * sqrt(pow(i * dx, 2) + pow(dr * dy, 2)) AS oy FROM c)
SELECT pc, {_r('ev')} AS ev FROM o WHERE i <= coalesce((SELECT i FROM o WHERE ox < 0 AND oy < 0 ORDER BY ox * ox + oy * oy DESC, i LIMIT 1), n)""")
def filter_ev_elbow(spark, d):
    """Shares in ten-thousandths: the elbow weighs them against ranks."""
    return pca.filter_elbow(_shares(spark, d).withColumn("ev", F.col("ev") * 10000)).select("pc", rounded(F.col("ev")).alias("ev"))


@query(f"WITH {_BETWEEN} SELECT pc FROM (SELECT pc, (ev - avg(ev) OVER ()) / stddev_pop(ev) OVER () AS z FROM ev) WHERE z > 0.5 ORDER BY pc LIMIT 5")
def filter_components(spark, d):
    r = _shares(spark, d)
    return pca.filter_components(r, r.withColumn("evr", F.col("ev")), method="zscore", z=0.5, max_pcs=5)


# --- similarity of clusters


@query(f"WITH {_CENTRE} SELECT a.cluster AS src, b.cluster AS dst, {_r('corr(a.mean, b.mean)')} AS sim FROM centre a JOIN centre b ON a.gene = b.gene AND a.cluster != b.cluster GROUP BY 1, 2")
def cluster_similarity(spark, d):
    return merging.similarity(m2_centres(spark, d)).select("src", "dst", rounded(F.col("sim")).alias("sim"))


@query(f"WITH {_STATS}, two AS (SELECT cluster, gene, mean FROM stats WHERE gene IN (SELECT DISTINCT gene FROM stats ORDER BY gene LIMIT 2)), dd AS (SELECT a.cluster AS src, b.cluster AS dst, sqrt(sum(pow(a.mean - b.mean, 2))) AS d FROM two a JOIN two b USING (gene) GROUP BY 1, 2), s AS (SELECT src, dst, 1 - d / max(d) OVER () AS sim FROM dd) SELECT src, dst, {_r('sim')} AS sim FROM s WHERE src != dst")
def cluster_distance_normalized(spark, d):
    s = m1_stats(spark, d)
    return merging.similarity(matrix.select_genes(s, s.select("gene").distinct().orderBy("gene").limit(2))).select("src", "dst", rounded(F.col("sim")).alias("sim"))


@query(f"WITH {_CENTRE}, sim AS (SELECT a.cluster AS src, b.cluster AS dst, corr(a.mean, b.mean) AS sim FROM centre a JOIN centre b ON a.gene = b.gene AND a.cluster != b.cluster GROUP BY 1, 2) SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS r FROM sim) WHERE r <= 2")
def k_nearest_clusters(spark, d):
    return merging.nearest_pairs(merging.similarity(m2_centres(spark, d)), 2)


@query(f"WITH {_CENTRE} SELECT a.cluster AS src, b.cluster AS dst, {_r('corr(a.mean, b.mean)')} AS sim FROM centre a JOIN centre b ON a.gene = b.gene AND a.cluster < b.cluster GROUP BY 1, 2 ORDER BY corr(a.mean, b.mean) DESC, 1, 2 LIMIT 1")
def most_similar_pair(spark, d):
    return merging.most_similar(merging.similarity(m2_centres(spark, d)).where("src < dst")).select("src", "dst", rounded(F.col("sim")).alias("sim"))


@query(f"WITH {_CENTRE} SELECT a.cluster AS a, b.cluster AS b, {_r('sqrt(sum(pow(a.mean - b.mean, 2)))')} AS dist FROM centre a JOIN centre b ON a.gene = b.gene AND a.cluster < b.cluster GROUP BY 1, 2")
def pairwise_centroid_distance(spark, d):
    return merging.centroid_distances(m2_centres(spark, d)).select("a", "b", rounded(F.col("dist")).alias("dist"))


@query()
def hclust_linkage(spark, d):
    v = m2(spark, d)
    return merging.hclust(moments.cluster_stats(matrix.long_form(v), v.select("obs_id", "cluster")))


# --- neighbours and graphs

K = 15


def _knn_sql(distance: str, k: int = K) -> str:
    return f"e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), nn AS (SELECT src, dst, d, r FROM (SELECT a.id AS src, b.id AS dst, {distance} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {distance}, b.id) AS r FROM e a, e b) WHERE r <= {k})"


_EUCLID = _knn_sql("list_distance(a.v, b.v)")


def _neighbours(spark, d, metric):
    n = knn.knn(m2(spark, d).select("obs_id", "features"), K, metric)
    return n.select("src", "dst", F.col("rank").cast("int").alias("rank"), rounded(F.col("distance")).alias("distance"))


@query(f"WITH {_EUCLID} SELECT src, dst, r::INT AS rank, {_r('d')} AS distance FROM nn")
def knn_euclidean(spark, d):
    return _neighbours(spark, d, "euclidean")


@query(f"WITH {_knn_sql('sqrt(greatest(0e0, 2 - 2 * CASE WHEN a.id = b.id THEN 1e0 ELSE list_cosine_similarity(a.v, b.v) END))')} SELECT src, dst, r::INT AS rank, round(d, 5) + 0e0 AS distance FROM nn")
def knn_angular(spark, d):
    n = knn.knn(m2(spark, d).select("obs_id", "features"), K, "angular")
    return n.select("src", "dst", F.col("rank").cast("int").alias("rank"), (F.round("distance", 5) + F.lit(0e0)).alias("distance"))


@query(f"WITH {_knn_sql('list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))')} SELECT src, dst, r::INT AS rank, {_r('d')} AS distance FROM nn")
def knn_manhattan(spark, d):
    return _neighbours(spark, d, "manhattan")


@query(f"WITH {_knn_sql('-list_inner_product(a.v, b.v)')} SELECT src, dst, r::INT AS rank, {_r('d')} AS distance FROM nn")
def knn_dot(spark, d):
    return _neighbours(spark, d, "dot")


@query()
def knn_approximate(spark, d):
    """A forest of random-projection trees with leaves of 256 rows, so that a small table has many leaves."""
    n = knn.approximate_knn(m2(spark, d).select("obs_id", "features"), K, shard_rows=256)
    return n.select("src", "dst", F.col("rank").cast("int").alias("rank"), rounded(F.col("distance")).alias("distance"))


_JACCARD = _EUCLID + f", sets AS (SELECT src, list(dst) AS s FROM nn GROUP BY src), edges AS (SELECT n.src, n.dst, len(list_intersect(a.s, b.s)) / (2e0 * {K} - len(list_intersect(a.s, b.s))) AS w FROM nn n JOIN sets a ON a.src = n.src JOIN sets b ON b.src = n.dst)"


def _edges(spark, d):
    return knn.jaccard_edges(kept(knn.knn(m2(spark, d).select("obs_id", "features"), K)), K)


@query(f"WITH {_JACCARD} SELECT src, dst, {_r('w')} AS w FROM edges")
def knn_jaccard(spark, d):
    return _edges(spark, d).select("src", "dst", rounded(F.col("w")).alias("w"))


@query(f"WITH {_EUCLID} SELECT src, dst, 1e0 AS w FROM nn")
def knn_uniform(spark, d):
    return knn.uniform_edges(knn.knn(m2(spark, d).select("obs_id", "features"), K))


@query(f"WITH {_JACCARD} SELECT least(src, dst) AS a, greatest(src, dst) AS b, {_r('max(w)')} AS w FROM edges GROUP BY 1, 2")
def graph_undirected_louvain(spark, d):
    return knn.undirected(_edges(spark, d), "collapse").select("a", "b", rounded(F.col("w")).alias("w"))


@query(f"WITH {_JACCARD} SELECT least(src, dst) AS a, greatest(src, dst) AS b, {_r('sum(w)')} AS w FROM edges GROUP BY 1, 2")
def graph_undirected_leiden(spark, d):
    return knn.undirected(_edges(spark, d), "sum").select("a", "b", rounded(F.col("w")).alias("w"))


@query(f"WITH {_JACCARD}, g AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(w) AS w FROM edges GROUP BY 1, 2), lab AS (SELECT vec_id AS id, label AS c FROM embeddings), e2 AS (SELECT x.c AS ca, y.c AS cb, w FROM g JOIN lab x ON x.id = a JOIN lab y ON y.id = b), deg AS (SELECT c, sum(w) AS dg FROM (SELECT ca AS c, w FROM e2 UNION ALL SELECT cb, w FROM e2) GROUP BY c), m AS (SELECT sum(w) AS m, sum(CASE WHEN ca = cb THEN w ELSE 0 END) AS i FROM e2) SELECT {_r('any_value(i) / any_value(m) - sum(pow(dg / (2 * m), 2))')} AS q FROM deg, m")
def graph_modularity(spark, d):
    part = m2(spark, d).select(F.col("obs_id").alias("node"), F.col("cluster").alias("community"))
    return knn.modularity(knn.undirected(_edges(spark, d)), part).select(rounded(F.col("q")).alias("q"))


@query("WITH v AS (SELECT c_custkey AS pos, (CASE WHEN c_acctbal < -900 THEN -1 ELSE c_nationkey END)::INT AS label FROM customer) SELECT pos, CASE WHEN label = -1 THEN (SELECT max(label) FROM v) + (sum(CASE WHEN label = -1 THEN 1 ELSE 0 END) OVER (ORDER BY pos))::INT ELSE label END AS label FROM v")
def split_outlier_labels(spark, d):
    label = F.when(F.col("c_acctbal") < -900, -1).otherwise(F.col("c_nationkey")).cast("int")
    return community.split_outliers(matrix.read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), label.alias("label")))


@query()
def louvain_communities(spark, d):
    return community.communities(_edges(spark, d), "louvain", seed=5)


@query()
def leiden_communities(spark, d):
    return community.communities(_edges(spark, d), "leiden", seed=5)


@query()
def leiden_communities_on_the_cluster(spark, d):
    return community.communities(_edges(spark, d), "leiden", local_edges=2000, seed=5)


@query()
def phenograph_clusters(spark, d):
    return community.phenograph(m2(spark, d), K, seed=5)[0]


# --- merging and the pipeline

ONE = clustering.OneStep(k=15, low=-1e9, thresholds=T.with_(low=0.5), n_markers=10, seed=5)


@query()
def merge_small_clusters(spark, d):
    import numpy as np

    s = de.Stats.collect(m1_stats(spark, d))
    into = merging.merge_small(s.labels, s.mean, dict(zip(s.labels, s.n, strict=True)), int(np.median(s.n)) + 1)
    return spark.createDataFrame(list(into.items()), "cluster string, into string")


@query()
def merge_clusters_by_de(spark, d):
    s, r = de.Stats.collect(m1_stats(spark, d)), de.Stats.collect(m1_stats(spark, d))
    return spark.createDataFrame(list(merging.merge_by_de(s, r, T.with_(score=1.0)).items()), "cluster string, into string")


@query()
def merge_clusters(spark, d):
    v = m2(spark, d)
    assign, _ = clustering.merge_clusters(matrix.long_form(v), v, v.select("obs_id", "cluster"), ONE)
    return assign


#: The order matrix from genes on: two to five components, whose variances hardly differ there.
COUNTS = clustering.OneStep(k=15, n_comps=5, pc_method=None, max_pcs=5, thresholds=T, n_markers=10, seed=5)


@query()
def onestep_clust(spark, d):
    x = m1(spark, d)
    return clustering.onestep(x, x.select("obs_id").distinct(), COUNTS)[0]


@query()
def onestep_clust_sampled_components(spark, d):
    x = m1(spark, d)
    return clustering.onestep(x, x.select("obs_id").distinct(), replace(COUNTS, pca_cells=500))[0]


@query()
def onestep_clust_latent(spark, d):
    v = m2(spark, d)
    return clustering.onestep(matrix.long_form(v), v, ONE, latent=v)[0]


@query()
def iter_clust(spark, d):
    x = m1(spark, d)
    return clustering.iterate(x, x.select("obs_id").distinct(), COUNTS, min_samples=600)[0]


@query()
def final_merge(spark, d):
    v = m2(spark, d).withColumn("cluster", F.col("cluster").cast("int"))
    return clustering.final_merge(matrix.long_form(v).withColumn("gene", F.col("gene").cast("string")), v.select("obs_id", "cluster"), {str(i) for i in range(0, 64, 4)}, ONE)[0]


@query()
def summarize_final_clusters(spark, d):
    v = m2(spark, d)
    found, _ = clustering.summarize(matrix.long_form(v), v.select("obs_id", "cluster"), T.with_(low=0.0))
    return found.select("a", "b", "score", "num", "up_num", "down_num")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
