"""Queries of the statistical operators over the star tables and events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import aggregates, allelic_mcmc, copy_ratio, coverage_mcmc, dirichlet, ordered, regression, scoring, snps
from strandline.plans.relational import micros, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as sites along an arm, with two counts."""
    chosen, count = F.col("event_type").isin("click", "view", "purchase"), F.ceil(F.col("value") / 5).cast("double")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("arm"), micros("ts").alias("place"), F.when(chosen, count).otherwise(1.0).alias("major"), F.when(chosen, 1.0).otherwise(count).alias("minor"))


@query()
def mcmc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allelic_mcmc.allelic_segments(_sites(spark, sf_dir), ["arm"], "place", "major", "minor", iterations=200, draws=3)


@query()
def mcmc_breakpoint_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allelic_mcmc.breakpoint_support(mcmc_segments(spark, sf_dir), ["arm"])


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("sample"), F.col("l_suppkey").alias("segment")).agg(
        F.sum(F.when(flagged, F.col("l_quantity")).otherwise(0.0)).alias("minor"), F.sum(F.when(flagged, 0.0).otherwise(F.col("l_quantity"))).alias("major"), F.count(F.lit(1)).alias("sites"),
    )


@query()
def dp_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirichlet.allelic_clusters(_suppliers(spark, sf_dir), ["sample"], "segment", "minor", "major", "sites")


@query("""
WITH seg AS (SELECT l_linestatus AS sample, l_suppkey, l_suppkey // 10 AS cluster, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS mi, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS ma FROM lineitem GROUP BY 1, 2),
sums AS (SELECT sample, cluster, sum(CASE WHEN mi > ma THEN ma ELSE mi END) AS a, sum(CASE WHEN mi > ma THEN mi ELSE ma END) AS b, count(*) AS n FROM seg GROUP BY 1, 2)
SELECT sample, count(*) AS clusters, round(sum(lgamma(a + 2) + lgamma(b + 2) - lgamma(a + b + 4) + lgamma(n)) + lgamma(1) - lgamma(sum(n) + 1), 2) AS loglik FROM sums GROUP BY 1
""")
def dp_overall_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _suppliers(spark, sf_dir).withColumn("cluster", F.floor(F.col("segment") / 10)).withColumn("flipped", F.col("minor") > F.col("major"))
    return dirichlet.clustering_loglik(rows, ["sample"], "cluster", "minor", "major", "flipped").withColumn("loglik", F.round("loglik", 2))


@query()
def poisson_newton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of return flags and coefficients of discount and tax."""
    items = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("n"), "l_discount", "l_tax")
    fit = regression.poisson_regression(items, "l_returnflag", "n", ["l_discount", "l_tax"])
    beta = spark.createDataFrame([(f"beta{k}", float(b)) for k, b in enumerate(fit.beta)], "l_returnflag string, mu double")
    return fit.mu.unionByName(beta)


@query()
def lnp_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("segment"), "l_quantity", "l_discount")
    return regression.fit_lnp_groups(items, ["segment"], "l_quantity", ["l_discount"], [0.1])


@query()
def coverage_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority by day as bins."""
    day = F.floor(micros("o_orderdate") / (86_400_000_000 * 30))
    bins = table(spark, sf_dir, "orders").groupBy("o_orderpriority", day.alias("place")).agg(F.count(F.lit(1)).alias("x"))
    return coverage_mcmc.coverage_segments(bins, ["o_orderpriority"], "place", "x", [], [])


@query()
def coverage_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / (86_400_000_000 * 30))
    bins = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("draw"), F.col("o_orderpriority").alias("segment"), day.alias("place")).agg(F.count(F.lit(1)).alias("x")).withColumn("base", F.lit(0.0))
    return dirichlet.coverage_clusters(bins, ["draw"], "segment", "x", "base")


@query()
def copy_ratio_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = aggregates.deviations(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_suppkey"], "l_quantity")
    return dirichlet.copy_ratio_clusters(parts, ["l_returnflag"], "l_suppkey", "n", "mean", "ssd")


@query("""
WITH days AS (SELECT l_suppkey AS chr, CAST(epoch_us(l_shipdate) // 86400000000 AS BIGINT) AS start, min(l_returnflag) AS major_cluster, min(l_linestatus) AS minor_cluster FROM lineitem GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN major_cluster IS DISTINCT FROM lag(major_cluster) OVER w OR minor_cluster IS DISTINCT FROM lag(minor_cluster) OVER w THEN 1 ELSE 0 END AS step FROM days WINDOW w AS (PARTITION BY chr ORDER BY start)),
runs AS (SELECT chr, min(start) AS start_bp, max(start + 1) AS end_bp, count(*) AS num_bins, major_cluster, minor_cluster FROM (SELECT *, sum(step) OVER (PARTITION BY chr ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY chr, island, major_cluster, minor_cluster),
valued AS (SELECT chr, start_bp, end_bp, num_bins, CASE major_cluster WHEN 'A' THEN 1.0::DOUBLE WHEN 'N' THEN 2.0 ELSE 3.0 END AS x, CASE minor_cluster WHEN 'F' THEN 0.5::DOUBLE ELSE 1.5 END AS y FROM runs),
factor AS (SELECT sum((x + y) * (end_bp - start_bp)) / sum(end_bp - start_bp) / 2 AS k FROM valued)
SELECT chr, start_bp, end_bp, num_bins, round(greatest(x, y) / k, 6) AS mu_major, round(least(x, y) / k, 6) AS mu_minor FROM valued, factor
""")
def export_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("l_shipdate") / 86_400_000_000).cast("long")
    bins = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chr"), day.alias("start")).agg(F.min("l_returnflag").alias("major_cluster"), F.min("l_linestatus").alias("minor_cluster"))
    x = F.when(F.col("major_cluster") == "A", 1.0).when(F.col("major_cluster") == "N", 2.0).otherwise(3.0)
    y = F.when(F.col("minor_cluster") == "F", 0.5).otherwise(1.5)
    bins = bins.withColumn("end", F.col("start") + 1).withColumns({"mu_major": x, "sigma_major": x / 10, "mu_minor": y, "sigma_minor": y / 10})
    out = copy_ratio.export_segments(bins)
    return out.select("chr", "start_bp", "end_bp", "num_bins", F.round("mu_major", 6).alias("mu_major"), F.round("mu_minor", 6).alias("mu_minor"))


def _two_profiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers' orders as segments until the next one, under two values."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chr"), "o_orderkey", "o_totalprice", micros("o_orderdate").alias("at"))
    days = rows.groupBy("chr", F.floor(F.col("at") / 86_400_000_000).cast("long").alias("start_bp")).agg(F.min("o_orderkey").alias("k"), F.max("o_totalprice").alias("p"))
    pairs = ordered.intervals_between(days, ["chr"], "start_bp").withColumnRenamed("start", "start_bp").withColumnRenamed("end", "end_bp").join(days, ["chr", "start_bp"])
    truth = pairs.select("chr", "start_bp", "end_bp", (1 + F.col("k") % 3).cast("double").alias("mu_major"), (F.col("k") % 2).cast("double").alias("mu_minor"))
    found = pairs.select("chr", (F.col("start_bp") + 5).alias("start_bp"), (F.col("end_bp") + 5).alias("end_bp"), (1 + F.col("p") / 100000).alias("mu_major"), (F.col("p") / 200000).alias("mu_minor"))
    return truth, found


_PROFILES = """
days AS (SELECT o_custkey AS chr, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS start_bp, min(o_orderkey) AS k, max(o_totalprice) AS p FROM orders GROUP BY 1, 2),
pairs AS (SELECT * FROM (SELECT *, lead(start_bp) OVER (PARTITION BY chr ORDER BY start_bp) AS end_bp FROM days) WHERE end_bp IS NOT NULL)
"""


@query("WITH " + _PROFILES + """
SELECT t.chr, greatest(t.start_bp, f.start_bp + 5) AS overlap_start, least(t.end_bp, f.end_bp + 5) AS overlap_end, least(t.end_bp, f.end_bp + 5) - greatest(t.start_bp, f.start_bp + 5) AS length,
  (1 + t.k % 3)::DOUBLE AS t_major, (t.k % 2)::DOUBLE AS t_minor, 1 + f.p / 100000 AS f_major, f.p / 200000 AS f_minor, t.end_bp - t.start_bp AS event_length
FROM pairs t JOIN pairs f ON t.chr = f.chr AND greatest(t.start_bp, f.start_bp + 5) < least(t.end_bp, f.end_bp + 5)
""")
def segment_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pair_segments(*_two_profiles(spark, sf_dir), width=90)


@query("WITH " + _PROFILES + """
, met AS (SELECT least(t.end_bp, f.end_bp + 5) - greatest(t.start_bp, f.start_bp + 5) AS len, 1 + t.k % 3 AS tx, t.k % 2 AS ty, 1 + f.p / 100000 AS fx, f.p / 200000 AS fy
  FROM pairs t JOIN pairs f ON t.chr = f.chr AND greatest(t.start_bp, f.start_bp + 5) < least(t.end_bp, f.end_bp + 5)),
grid AS (SELECT 0.25 * pow(16.0::DOUBLE, g / 399.0::DOUBLE) AS k FROM (SELECT unnest(generate_series(0, 399)) AS g)),
scores AS (SELECT k, sum((abs(tx - k * fx) + abs(ty - k * fy)) / 2 * len) / sum(len) AS mad FROM met, grid GROUP BY k),
best AS (SELECT min(mad) AS m FROM scores)
SELECT round(min(mad), 6) AS mad_score, round(min(k), 6) AS optimal_lower_bound, round(max(k), 6) AS optimal_upper_bound,
  (SELECT sum(end_bp - start_bp) FROM pairs)::BIGINT - (SELECT sum(len) FROM met)::BIGINT AS non_overlap_length, (SELECT sum(len) FROM met)::BIGINT AS overlap_length FROM scores, best WHERE mad <= m * 1.01
""")
def compare_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.compare(*_two_profiles(spark, sf_dir))
    return out.select(F.round("mad_score", 6).alias("mad_score"), F.round("optimal_lower_bound", 6).alias("optimal_lower_bound"), F.round("optimal_upper_bound", 6).alias("optimal_upper_bound"), F.col("non_overlap_length").cast("long").alias("non_overlap_length"), F.col("overlap_length").cast("long").alias("overlap_length"))


@query("""
WITH phase AS (SELECT l_suppkey AS chr, l_orderkey AS pos, min(l_linenumber) % 2 AS a, min(l_partkey) % 2 AS b, min(l_partkey) // 50 AS ps FROM lineitem GROUP BY 1, 2),
voted AS (SELECT chr, ps, sum(CASE WHEN 1 - b = 1 AND a = 1 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN 1 - b = 1 OR a = 1 THEN 1 ELSE 0 END), 1)
   > sum(CASE WHEN b = 1 AND a = 1 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN b = 1 OR a = 1 THEN 1 ELSE 0 END), 1) AS flip FROM phase GROUP BY 1, 2)
SELECT chr, pos, CASE WHEN flip THEN 1 - b ELSE b END AS allele_a, CASE WHEN flip THEN b ELSE 1 - b END AS allele_b, 0.0::DOUBLE AS misphase_prob FROM phase JOIN voted USING (chr, ps)
""")
def phase_set_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sites: one parity imputed, another in phase sets."""
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("pos")).agg((F.min("l_linenumber") % 2).alias("a"), F.min("l_partkey").alias("p"))
    b = F.col("p") % 2
    imputed = base.select("chr", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.col("a").cast("long").alias("allele_a"), (1 - F.col("a")).cast("long").alias("allele_b"), F.lit(True).alias("phased"), F.lit(0.001).alias("misphase_prob"))
    backed = base.select("chr", "pos", F.lit("A").alias("ref"), F.lit("C").alias("alt"), b.alias("allele_a"), (1 - b).alias("allele_b"), F.lit(True).alias("phased"), F.floor(F.col("p") / 50).alias("ps"))
    return snps.merge_readbacked(imputed, backed).select("chr", "pos", "allele_a", "allele_b", "misphase_prob")


@query("""
SELECT l_suppkey, segment_n, removed_n, round(mean, 6) AS mean, round(ssd, 4) AS ssd FROM (
SELECT l_suppkey, count(*) AS segment_n, count(*) FILTER (l_returnflag = 'R') AS removed_n, avg(l_quantity) FILTER (l_returnflag != 'R') AS mean, var_pop(l_quantity) FILTER (l_returnflag != 'R') * count(*) FILTER (l_returnflag != 'R') AS ssd FROM lineitem GROUP BY 1)
""")
def ssd_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    whole = aggregates.deviations(items, ["l_suppkey"], "l_quantity")
    part = aggregates.deviations(items.filter("l_returnflag = 'R'"), ["l_suppkey"], "l_quantity").select("l_suppkey", F.col("n").alias("k"), F.col("mean").alias("m"), F.col("ssd").alias("s"))
    met = whole.join(part, "l_suppkey", "left").fillna(0, ["k", "m", "s"])
    _, mean, ssd = aggregates.remove_deviations((F.col("n"), F.col("mean"), F.col("ssd")), (F.col("k"), F.col("m"), F.col("s")))
    return met.select("l_suppkey", F.col("n").alias("segment_n"), F.col("k").alias("removed_n"), F.round(mean, 6).alias("mean"), F.round(ssd, 4).alias("ssd"))


@query()
def pseudo_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _suppliers(spark, sf_dir).select("sample", "segment", F.lit(1).alias("allele"), F.log(F.col("sites") + 1.0).alias("mu"), F.lit(0.1).alias("sigma"), F.col("major").alias("own"), F.col("minor").alias("other"), F.col("sites").alias("bins"))
    return copy_ratio.grey_segments(copy_ratio.pseudo_observations(rows, ["sample"]))


@query()
def nb_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("x"))
    return regression.negative_binomial_outliers(counts, "x").groupBy("nb_outlier").agg(F.count(F.lit(1)).alias("n"))
