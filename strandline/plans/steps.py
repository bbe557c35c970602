"""Queries of single steps: each calls one operator on the star tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import conversion, copy_ratio, coverage, intervals, ordered, purity, scoring, snps
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


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: (chr, bin_id, start, priority, price)."""
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chr"), F.col("o_orderkey").alias("bin_id"), day.alias("start"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


_DAYS = "days AS (SELECT o_custkey AS chr, o_orderkey AS bin_id, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS start, o_orderpriority AS priority, o_totalprice AS price FROM orders)"


# -- sites -------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, (l_linenumber % 3)::TINYINT AS allele_a, (l_suppkey % 2)::TINYINT AS allele_b, l_linestatus = 'O' AS phased FROM lineitem
WHERE NOT (l_linestatus = 'O' AND l_linenumber % 3 = 1 AND l_suppkey % 2 = 1)
""")
def haplotype_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hap = F.concat((F.col("l_linenumber") % 3).cast("string"), F.when(F.col("l_linestatus") == "O", "|").otherwise("/"), (F.col("l_suppkey") % 2).cast("string"), F.lit(":30"))
    calls = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", hap.alias("hap"))
    return snps.drop_homozygous(snps.parse_haplotypes(calls)).drop("hap")


@query("""
SELECT l_suppkey, sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE l_linenumber END)::DOUBLE AS major,
  sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber ELSE l_quantity END)::DOUBLE AS minor, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS flips
FROM lineitem GROUP BY l_suppkey
""")
def phase_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("l_linestatus") == "O").cast("int")
    sites = _items(spark, sf_dir).select("l_suppkey", a.alias("allele_a"), (1 - a).alias("allele_b"), F.lit(True).alias("phased"), F.col("l_quantity").alias("alt_count"), F.col("l_linenumber").cast("double").alias("ref_count"))
    return snps.orient(sites).groupBy("l_suppkey").agg(F.sum("maj_count").alias("major"), F.sum("min_count").alias("minor"), F.count_if("aidx").alias("flips"))


@query("""
WITH sites AS (SELECT DISTINCT l_orderkey AS chr, l_linenumber AS pos, l_linestatus = 'O' AS phased FROM lineitem),
counted AS (SELECT l_orderkey AS chr, l_linenumber AS pos, l_quantity AS alt, l_suppkey AS ref FROM lineitem WHERE l_returnflag = 'R')
SELECT chr, count(*) AS sites, sum(CASE WHEN chr % 2 = 1 THEN alt ELSE ref END)::DOUBLE AS major FROM sites JOIN counted USING (chr, pos) WHERE phased GROUP BY 1
""")
def counts_at_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumnsRenamed({"l_orderkey": "chr", "l_linenumber": "pos"})
    a = F.col("chr") % 2
    sites = items.select("chr", "pos", a.alias("allele_a"), (1 - a).alias("allele_b"), (F.col("l_linestatus") == "O").alias("phased")).distinct()
    counts = items.filter("l_returnflag = 'R'").select("chr", "pos", F.col("l_quantity").alias("alt_count"), F.col("l_suppkey").cast("double").alias("ref_count"))
    return snps.orient(snps.with_counts(sites, counts)).groupBy("chr").agg(F.count(F.lit(1)).alias("sites"), F.sum("maj_count").alias("major"))


@query("""
WITH phase AS (SELECT l_suppkey AS chr, l_orderkey AS pos, min(l_linenumber) % 2 AS a, min(l_partkey) % 2 AS b, min(l_partkey) // 50 AS ps FROM lineitem GROUP BY 1, 2),
voted AS (SELECT chr, ps, sum(CASE WHEN 1 - b = 1 AND a = 1 AND pos % 3 != 0 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN pos % 3 != 0 AND (1 - b = 1 OR a = 1) THEN 1 ELSE 0 END), 1)
   > sum(CASE WHEN b = 1 AND a = 1 AND pos % 3 != 0 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN pos % 3 != 0 AND (b = 1 OR a = 1) THEN 1 ELSE 0 END), 1) AS flip FROM phase GROUP BY 1, 2)
SELECT pos % 3 = 0 AS added, count(*) AS n, sum(CASE WHEN flip THEN 1 - b ELSE b END)::BIGINT AS alternate, sum(chr)::BIGINT AS chr FROM phase JOIN voted USING (chr, ps) GROUP BY 1
""")
def readbacked_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the sites stand in phase sets alone and are added."""
    base = _items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("pos")).agg((F.min("l_linenumber") % 2).cast("long").alias("a"), F.min("l_partkey").alias("p"))
    b = (F.col("p") % 2).cast("long")
    named = [F.lit("A").alias("ref"), F.lit("C").alias("alt")]
    imputed = base.filter("pos % 3 != 0").select("chr", "pos", *named, F.col("a").alias("allele_a"), (1 - F.col("a")).alias("allele_b"), F.lit(True).alias("phased"), F.lit(0.001).alias("misphase_prob"))
    backed = base.select("chr", "pos", *named, b.alias("allele_a"), (1 - b).alias("allele_b"), F.lit(True).alias("phased"), F.floor(F.col("p") / 50).alias("ps"))
    out = snps.merge_readbacked(imputed, backed)
    return out.groupBy((F.col("pos") % 3 == 0).alias("added")).agg(F.count(F.lit(1)).alias("n"), F.sum("allele_a").alias("alternate"), F.sum("chr").alias("chr"))


@query("""
SELECT l_suppkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity / 0.5::DOUBLE ELSE l_quantity END) AS alt, sum(CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_linenumber * 0.5::DOUBLE END) AS ref FROM lineitem GROUP BY 1
""")
def reference_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _items(spark, sf_dir).select("l_suppkey", F.lit(1).alias("allele_a"), F.lit(0).alias("allele_b"), F.lit(True).alias("phased"), F.col("l_quantity").alias("alt_count"), F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(F.col("l_linenumber")).alias("ref_count"))
    return snps.apply_reference_bias(sites, 0.5).groupBy("l_suppkey").agg(F.sum("maj_count").alias("alt"), F.sum("min_count").alias("ref"))


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber / l_quantity::DOUBLE <= 0.05 AND 1 - (l_partkey % 40 + l_suppkey % 10) / l_quantity::DOUBLE <= 0.1 AND l_partkey % 40 > 8
""")
def call_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0)
    calls = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 40).alias("t_refcount"), zero.alias("t_altcount"), (F.col("l_suppkey") % 10).alias("n_refcount"), zero.alias("n_altcount"), F.col("l_linenumber").alias("mapq0_reads"), F.col("l_quantity").alias("total_reads"))
    return snps.quality_calls(calls).select("l_orderkey", "l_linenumber")


@query("""
WITH visits AS (SELECT user_id AS arm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, event_type, value FROM events)
SELECT arm, k // 50 AS part, (CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) AS allele, round(sum(value), 4) AS ref, count(*)::BIGINT AS alt, count(*) AS n_snp FROM visits GROUP BY ALL
""")
def segment_alleles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as sites; every 50 of them a segment."""
    placed = ordered.row_ids(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "snp_id")
    first = placed.groupBy("user_id").agg(F.min("snp_id").alias("first"), F.max("snp_id").alias("last"))
    sites = placed.select(F.col("user_id").alias("arm"), "snp_id", (F.col("event_type") == "click").alias("aidx"), F.col("value").alias("ref_count"), F.lit(1).cast("long").alias("alt_count"))
    breaks = first.select(F.col("user_id").alias("arm"), F.explode(F.expr("sequence(first, last, 50)")).alias("start"), "last").select("arm", "start", F.least(F.col("start") + 50, F.col("last") + 1).alias("end"))
    named = ordered.row_ids(breaks, ["arm"], ["start"], "segment").select("segment", "arm", "start")
    low = named.groupBy("arm").agg(F.min("start").alias("low"))
    out = snps.segment_alleles(sites, breaks).join(named.join(low, "arm"), "segment")
    return out.select("arm", F.floor((F.col("start") - F.col("low")) / 50).alias("part"), "allele", F.round("ref", 4).alias("ref"), "alt", "n_snp")


# -- bins --------------------------------------------------------------------------


@query("""
SELECT l_orderkey, min(l_linestatus) AS status, arg_min(l_suppkey, l_linenumber::BIGINT * 1000000000 + l_suppkey) AS first_supplier, count(*) AS n
FROM lineitem GROUP BY 1 HAVING min(l_linestatus) = max(l_linestatus)
""")
def unanimous_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir)
    site = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")
    sites = items.select(F.col("l_orderkey").alias("bin_id"), site.alias("snp_id"), F.col("l_linestatus").alias("seg_idx"), F.col("l_suppkey").alias("cluster"), F.lit(1).alias("min_count"), F.lit(1).alias("maj_count"))
    bins = items.select(F.col("l_orderkey").alias("bin_id")).distinct()
    return coverage.assign_segments(bins, sites).select(F.col("bin_id").alias("l_orderkey"), F.col("seg_idx").alias("status"), F.col("allelic_cluster").alias("first_supplier"), F.col("min_count").alias("n"))


@query("WITH " + _DAYS + """
, outer_ AS (SELECT chr, bin_id AS seg, start AS low, start + 120 AS high FROM days WHERE priority = '1-URGENT'),
found AS (SELECT i.bin_id, max(o.seg) AS seg FROM days i JOIN outer_ o ON o.chr = i.chr AND i.start >= o.low AND i.start + 10 <= o.high WHERE i.priority != '1-URGENT' GROUP BY 1)
SELECT d.bin_id, CASE WHEN priority = '1-URGENT' THEN d.bin_id ELSE f.seg END AS seg_idx, CASE WHEN priority = '1-URGENT' THEN 0 ELSE f.seg % 7 END AS allelic_cluster FROM days d LEFT JOIN found f USING (bin_id)
""")
def bins_from_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    urgent = F.col("priority") == "1-URGENT"
    bins = days.select("chr", "start", (F.col("start") + 10).alias("end"), "bin_id", F.when(urgent, F.col("bin_id")).alias("seg_idx"), F.when(urgent, F.lit(0).cast("long")).alias("allelic_cluster"))
    extents = days.filter(urgent).select("chr", F.col("bin_id").alias("seg_idx"), F.col("start").alias("low"), (F.col("start") + 120).alias("high"), (F.col("bin_id") % 7).alias("cluster"))
    return coverage.fill_from_segments(bins, extents, 120).select("bin_id", "seg_idx", "allelic_cluster")


@query("""
WITH sized AS (SELECT o_orderkey, o_totalprice AS p, o_custkey % 100 AS q, count(*) OVER (PARTITION BY o_custkey) <= 10 AS few, o_orderpriority AS c FROM orders)
SELECT o_orderkey, round(CASE WHEN few THEN avg(p) OVER (PARTITION BY c) ELSE p END, 4) AS min_count, round(CASE WHEN few THEN avg(q) OVER (PARTITION BY c) ELSE q END, 6)::DOUBLE AS maj_count FROM sized
""")
def counts_of_small_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("seg_idx"), F.col("o_orderpriority").alias("allelic_cluster"), F.col("o_totalprice").alias("min_count"), (F.col("o_custkey") % 100).alias("maj_count"))
    return coverage.fallback_counts(bins).select("o_orderkey", F.round("min_count", 4).alias("min_count"), F.round("maj_count", 6).alias("maj_count"))


@query("WITH " + _DAYS + """
, track AS (SELECT chr, start AS s, start + 30 AS e, round(price) AS v FROM days WHERE priority = '2-HIGH')
SELECT d.bin_id, (SELECT min(v) FROM track t WHERE t.chr = d.chr AND d.start + 5 >= t.s AND d.start + 5 < t.e AND t.s = (SELECT min(u.s) FROM track u WHERE u.chr = d.chr AND d.start + 5 >= u.s AND d.start + 5 < u.e)) AS signal FROM days d WHERE priority = '1-URGENT'
""")
def track_at_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    bins = days.filter("priority = '1-URGENT'").select("bin_id", "chr", "start", (F.col("start") + 10).alias("end"), (F.col("start") + 5).alias("midpoint"))
    track = days.filter("priority = '2-HIGH'").select("chr", "start", (F.col("start") + 30).alias("end"), F.round("price").alias("signal"))
    return coverage.join_track(bins, track, ["signal"], 30).select("bin_id", "signal")


@query("WITH " + _DAYS + """
, n AS (SELECT chr, start, max(price) AS price FROM days WHERE priority = '2-HIGH' GROUP BY 1, 2)
SELECT bin_id, d.price AS covcorr, n.price AS "covcorr_N" FROM days d LEFT JOIN n USING (chr, start)
""")
def normal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).withColumn("end", F.col("start") + 10)
    normal = days.filter("priority = '2-HIGH'").groupBy("chr", "start", "end").agg(F.max("price").alias("covcorr"))
    return coverage.join_normal(days.select("bin_id", "chr", "start", "end", F.col("price").alias("covcorr")), normal).select("bin_id", "covcorr", "covcorr_N")


# -- segments ----------------------------------------------------------------------


@query("""
SELECT allele, l_returnflag, count(*) AS n, sum(CASE WHEN allele = 1 THEN l_quantity ELSE l_linenumber END)::DOUBLE AS total
FROM (SELECT -1 AS allele, * FROM lineitem UNION ALL SELECT 1, * FROM lineitem) GROUP BY 1, 2
""")
def allele_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = copy_ratio.allele_rows(_items(spark, sf_dir).select("l_returnflag", "l_quantity", "l_linenumber"))
    return both.groupBy("allele", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("allele") == 1, F.col("l_quantity")).otherwise(F.col("l_linenumber").cast("double"))).alias("total"))


@query("""
WITH seg AS (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS m, sqrt(var_pop(l_quantity)) AS sd FROM lineitem GROUP BY 1),
line AS (SELECT regr_slope(sd, m) AS b, regr_intercept(sd, m) AS a FROM seg)
SELECT l_partkey, n < 3 OR sd > 1.2 * (a + b * m) AS grey FROM seg, line
""")
def grey_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _items(spark, sf_dir).groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean"), F.var_pop("l_quantity").alias("v"))
    return copy_ratio.grey_segments(seg.withColumn("ssd", F.col("v") * F.col("n")), sds=1.2).select("l_partkey", "grey")


@query("""
SELECT l_linestatus, l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd, sum(l_partkey - l_linenumber)::BIGINT AS territory, count(*) AS n FROM lineitem GROUP BY 1, 2
""")
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select("l_linestatus", "l_suppkey", F.col("l_quantity").alias("mean"), F.col("l_linenumber").cast("long").alias("start_bp"), F.col("l_partkey").alias("end_bp"))
    return copy_ratio.cluster_summary(rows, ["l_linestatus"], "l_suppkey").withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("""
WITH c AS (SELECT DISTINCT o_orderpriority, o_custkey, o_orderstatus != 'F' AS subclonal FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT o_orderpriority, subclonal, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY subclonal, o_custkey) - 1 AS cluster FROM c
""")
def merge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("cluster"), "o_orderstatus")
    of = lambda s: orders.filter(F.col("o_orderstatus") == s).drop("o_orderstatus").distinct()
    return copy_ratio.merge_classes(of("F"), of("O"), ["o_orderpriority"], "cluster").withColumn("cluster", F.col("cluster").cast("long"))


_SEGMENTS = """
seg AS (SELECT l_suppkey AS chr, l_orderkey AS start_bp, l_orderkey + l_partkey AS end_bp, l_linenumber AS num_bins, l_quantity / 10 AS x, l_tax * 10 AS y, l_partkey % 9 AS h FROM lineitem WHERE l_linenumber = 1)
"""


@query("WITH " + _SEGMENTS + """
SELECT chr, start_bp, end_bp, num_bins::BIGINT AS n_probes, end_bp - start_bp AS length, h AS n_hets, round(y / (x + y), 6) AS f, round(x + y, 6) AS tau, CASE WHEN y < 0.1 AND abs(x + y - 2) < 0.25 THEN 2 ELSE 1 END::BIGINT AS seg_label_cnloh FROM seg
""")
def absolute_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = _items(spark, sf_dir).filter("l_linenumber = 1").select(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("start_bp"), (F.col("l_orderkey") + F.col("l_partkey")).alias("end_bp"), F.col("l_linenumber").cast("long").alias("num_bins"), (F.col("l_quantity") / 10).alias("mu_major"), F.lit(0.1).alias("sigma_major"), (F.col("l_tax") * 10).alias("mu_minor"), F.lit(0.1).alias("sigma_minor"), (F.col("l_partkey") % 9).alias("n_hets"))
    out = copy_ratio.absolute_segments(seg)
    return out.select("chr", "start_bp", "end_bp", "n_probes", "length", "n_hets", F.round("f", 6).alias("f"), F.round("tau", 6).alias("tau"), "seg_label_cnloh")


@query("""
WITH rows AS (SELECT 'copies' AS tool, l_suppkey AS chr, l_linenumber AS a, l_partkey % 3 AS b FROM lineitem UNION ALL SELECT 'total', l_suppkey, l_linenumber - l_partkey % 3, l_partkey % 3 FROM lineitem)
SELECT tool, chr, sum(a)::DOUBLE AS major, sum(b)::DOUBLE AS minor, round(sum(a / 10::DOUBLE), 6) AS sigma FROM rows GROUP BY 1, 2
""")
def tool_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tools' formats in the common one."""
    place = [F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("start_bp"), (F.col("l_orderkey") + 1).alias("end_bp")]
    items, b = _items(spark, sf_dir), F.col("l_partkey") % 3
    copies = scoring.from_copy_numbers(items.select(*place, F.col("l_linenumber").alias("n_major"), b.alias("n_minor"))).withColumn("tool", F.lit("copies"))
    total = scoring.from_total_and_minor(items.select(*place, F.col("l_linenumber").alias("total"), b.alias("lesser"))).withColumn("tool", F.lit("total"))
    return copies.unionByName(total).groupBy("tool", "chr").agg(F.sum("mu_major").alias("major"), F.sum("mu_minor").alias("minor"), F.round(F.sum("sigma_major"), 6).alias("sigma"))


@query("""
SELECT l_suppkey AS chr, round(sum(2 * pow(2::DOUBLE, l_tax) * (1 - l_discount)), 4) AS major, round(sum(2 * pow(2::DOUBLE, l_tax) * l_discount), 4) AS minor FROM lineitem GROUP BY 1
""")
def log_ratio_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).select(F.col("l_suppkey").alias("chr"), F.col("l_orderkey").alias("start_bp"), F.col("l_orderkey").alias("end_bp"), F.col("l_tax").alias("log_ratio"), F.col("l_discount").alias("maf"))
    return scoring.from_log_ratio(rows).groupBy("chr").agg(F.round(F.sum("mu_major"), 4).alias("major"), F.round(F.sum("mu_minor"), 4).alias("minor"))


@query("""
WITH bins AS (SELECT l_suppkey AS chr, CAST(epoch_us(l_shipdate) // 86400000000 AS BIGINT) AS start, min(l_returnflag) AS cluster FROM lineitem GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN cluster IS DISTINCT FROM lag(cluster) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS step FROM bins WINDOW w AS (PARTITION BY chr ORDER BY start)),
runs AS (SELECT chr, cluster, min(start) AS start_bp, max(start) + 1 AS end_bp FROM (SELECT *, sum(step) OVER (PARTITION BY chr ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM marked) GROUP BY chr, cluster, island)
SELECT chr, start_bp, end_bp, (CASE cluster WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::DOUBLE AS mu_major, (CASE cluster WHEN 'A' THEN 1 WHEN 'N' THEN 0 ELSE 2 END)::DOUBLE AS mu_minor FROM runs
""")
def segments_from_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("l_shipdate") / 86_400_000_000).cast("long")
    bins = _items(spark, sf_dir).groupBy(F.col("l_suppkey").alias("chr"), day.alias("start")).agg(F.min("l_returnflag").alias("cluster")).withColumn("end", F.col("start") + 1)
    copies = spark.createDataFrame([("A", 1, 1), ("N", 2, 0), ("R", 3, 2)], "cluster string, n_major int, n_minor int")
    return scoring.from_bins(bins, copies).select("chr", "start_bp", "end_bp", "mu_major", "mu_minor")


@query("WITH " + _DAYS + """
, truth AS (SELECT chr, start, start + 40 AS stop, (bin_id % 5)::DOUBLE AS x, (bin_id % 3)::DOUBLE AS y FROM days WHERE priority = '1-URGENT')
SELECT d.bin_id, t.x AS t_major, t.y AS t_minor FROM days d JOIN truth t ON t.chr = d.chr AND d.start + 7 >= t.start AND d.start + 7 < t.stop
""")
def truth_at_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    truth = days.filter("priority = '1-URGENT'").select("chr", F.col("start").alias("start_bp"), (F.col("start") + 40).alias("end_bp"), (F.col("bin_id") % 5).cast("double").alias("mu_major"), (F.col("bin_id") % 3).cast("double").alias("mu_minor"))
    points = days.select("bin_id", "chr", F.col("start").alias("start_bp"), (F.col("start") + 15).alias("end_bp"))
    return scoring.truth_at(points, truth, 40).select("bin_id", "t_major", "t_minor")


@query("""
SELECT (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 30 THEN 1 ELSE 0 END) AS length_bin, CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END AS ccf_bin, l_linenumber / 10::DOUBLE AS purity,
  CASE WHEN l_linenumber / 10::DOUBLE >= CASE WHEN l_linestatus = 'O' THEN 0.2 ELSE 0.3 END THEN 'clustered' ELSE 'unclustered' END AS method, round(sum(l_tax * l_quantity) / sum(l_quantity), 6) AS error FROM lineitem GROUP BY ALL
""")
def error_by_length_and_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    purity = F.col("l_linenumber") / 10
    method = scoring.method_of_purity(purity, F.when(F.col("l_linestatus") == "O", "WES").otherwise("WGS"))
    pairs = _items(spark, sf_dir).select(F.col("l_quantity").alias("event_length"), F.col("l_discount").alias("ccf"), purity.alias("purity"), method.alias("method"), F.col("l_tax").alias("error"), F.col("l_quantity").alias("length"))
    return scoring.error_map(pairs, [10, 30], [0.05]).withColumn("error", F.round("error", 6))


# -- conversions -------------------------------------------------------------------


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount >= 0.1)")
def semi_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 2).alias("chr"), F.col("s_suppkey").alias("pos"), "s_name")
    listed = _items(spark, sf_dir).filter("l_returnflag = 'R' and l_discount >= 0.1").select((F.col("l_suppkey") % 2).alias("chr"), F.col("l_suppkey").alias("pos"))
    return conversion.known_sites(calls, listed).select(F.col("pos").alias("s_suppkey"), "s_name")


@query("""
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('N') AND l_linenumber != 3 AND NOT (l_suppkey % 2 = 1 AND l_partkey % 2 = 1)
""")
def plain_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hap = F.concat((F.col("l_suppkey") % 2).cast("string"), F.lit("|"), (F.col("l_partkey") % 2).cast("string"))
    calls = _items(spark, sf_dir).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("contig"), F.lit("A").alias("ref"), F.when(F.col("l_linenumber") == 3, "CT").otherwise("C").alias("alt"), hap.alias("hap"))
    return conversion.substitutions(conversion.without_contigs(calls, ["N"])).select("l_orderkey", "l_linenumber")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS p, max(l_quantity) AS r, max(l_partkey) AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), n AS (SELECT l_orderkey AS k, l_linenumber AS p, max(l_suppkey) AS r, max(l_quantity) AS a FROM lineitem GROUP BY 1, 2)
SELECT k AS "Chromosome", p AS "Position", n.r AS "File1R", n.a::BIGINT AS "File1A", coalesce(t.r, 0)::BIGINT AS "File2R", coalesce(t.a, 0) AS "File2A", 0::BIGINT AS "File2D" FROM n LEFT JOIN t USING (k, p)
""")
def pileup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumnsRenamed({"l_orderkey": "chr", "l_linenumber": "pos"})
    tumour = items.filter("l_returnflag = 'R'").groupBy("chr", "pos").agg(F.max("l_quantity").alias("ref_count"), F.max("l_partkey").alias("alt_count"))
    normal = items.groupBy("chr", "pos").agg(F.max("l_suppkey").alias("ref_count"), F.max("l_quantity").alias("alt_count")).withColumn("ref", F.lit("A")).withColumn("alt", F.lit("C"))
    return conversion.pileup_counts(tumour, normal).select("Chromosome", "Position", "File1R", "File1A", "File2R", "File2A", "File2D")


@query("""
WITH t AS (SELECT l_orderkey AS k, l_linenumber AS p, max(l_quantity) AS r, max(l_partkey)::DOUBLE AS a FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), s AS (SELECT l_orderkey AS k, l_linenumber AS p, max(l_suppkey) AS b FROM lineitem GROUP BY 1, 2)
SELECT k AS chr, p AS pos, coalesce(r, CASE WHEN b % 3 != 0 THEN (b * 2)::DOUBLE END, 0) AS ref_count, coalesce(a, 0) AS alt_count FROM s LEFT JOIN t USING (k, p)
""")
def refilled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir).withColumnsRenamed({"l_orderkey": "chr", "l_linenumber": "pos"})
    simulated = items.filter("l_returnflag = 'R'").groupBy("chr", "pos").agg(F.max("l_quantity").alias("ref_count"), F.max("l_partkey").cast("double").alias("alt_count"))
    sites = items.groupBy("chr", "pos").agg(F.max("l_suppkey").alias("bin_id"))
    bins = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("bin_id"), (F.col("s_suppkey") * 2).cast("double").alias("depth"))
    return conversion.refilled_counts(sites, simulated, bins).select("chr", "pos", "ref_count", "alt_count")


@query("WITH " + _DAYS + """
, t AS (SELECT DISTINCT chr, start FROM days)
SELECT chr, start, coalesce(lead(start) OVER (PARTITION BY chr ORDER BY start), 99999) AS "end" FROM t
""")
def threshold_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir).select("chr", F.col("start").alias("threshold")).distinct()
    return conversion.threshold_intervals(days, days.select("chr").distinct().withColumn("length", F.lit(99999).cast("long")))


@query("WITH " + _DAYS + """
, i AS (SELECT chr, start, row_number() OVER (PARTITION BY chr ORDER BY start) - 1 AS k FROM (SELECT DISTINCT chr, start FROM days)),
t AS (SELECT chr, priority, row_number() OVER (PARTITION BY chr ORDER BY priority) - 1 AS k, n FROM (SELECT chr, priority, count(*) AS n FROM days GROUP BY 1, 2))
SELECT chr, start, priority, n FROM i JOIN t USING (chr, k)
""")
def totals_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    counts = ordered.renumber(days.groupBy("chr", "priority").agg(F.count(F.lit(1)).alias("n")), ["chr"], ["priority"], "k")
    return conversion.interval_totals(days.select("chr", "start").distinct(), counts)


@query("""
SELECT regexp_extract(path, '_(0\\.\\d+)_', 1)::DOUBLE AS purity, 'strand' AS method, round(avg(p), 4) AS mad_score, count(*) AS n
FROM (SELECT 'out/p' || o_custkey || '_0.' || (1 + o_orderkey % 9) || '_wgs/strand.tsv' AS path, o_totalprice AS p FROM orders) GROUP BY 1
""")
def best_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("out/p"), F.col("o_custkey"), F.lit("_0."), 1 + F.col("o_orderkey") % 9, F.lit("_wgs/strand.tsv"))
    rows = table(spark, sf_dir, "orders").select(path.alias("path"), F.col("o_totalprice").alias("mad_score"))
    return conversion.best_of_results(rows).withColumn("mad_score", F.round("mad_score", 4))


@query("SELECT l_returnflag AS sample, sum(l_linenumber)::BIGINT AS reads, round(log2(sum(l_linenumber) / 7::DOUBLE), 6) AS ratio FROM lineitem GROUP BY 1")
def sample_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = conversion.sample_totals(_items(spark, sf_dir).select(F.col("l_returnflag").alias("sample"), F.col("l_linenumber").alias("reads")))
    return totals.withColumn("ratio", F.round(conversion.log_ratio(F.col("reads"), F.lit(7.0)), 6))


# -- order -------------------------------------------------------------------------


@query("""
SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE k > 1 AND event_type IS DISTINCT FROM before
""")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.breakpoints(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


@query("SELECT n_nationkey, n_regionkey, coalesce(sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_offset FROM nation")
def cumulative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.cumulative_offsets(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "n_nationkey", "n_regionkey", "n_offset").withColumn("n_offset", F.col("n_offset").cast("long"))


@query("WITH " + _DAYS + """
, spans AS (SELECT chr, bin_id, start AS low, start + 40 AS high FROM days WHERE priority = '1-URGENT')
SELECT d.bin_id, s.bin_id AS span FROM days d JOIN spans s ON s.chr = d.chr AND d.start >= s.low AND d.start < s.high
""")
def points_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    spans = days.filter("priority = '1-URGENT'").select("chr", F.col("bin_id").alias("span"), F.col("start").alias("low"), (F.col("start") + 40).alias("high"))
    return intervals.point_in_interval(days.select("bin_id", "chr", "start"), spans, ["chr"], "start", "low", "high", 40).select("bin_id", "span")


@query("""
WITH segments AS (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) AS a, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS b FROM lineitem GROUP BY 1),
levels AS (SELECT na, tau FROM (SELECT unnest(generate_series(1, 7)) AS tau) t, (SELECT unnest(generate_series(1, 7)) AS na) n WHERE 2 * na >= tau AND na <= tau),
fractions AS (SELECT (1 + 0.6::DOUBLE * (na - 1)) / (2 * (1 - 0.6::DOUBLE) + tau * 0.6::DOUBLE) AS x FROM levels)
SELECT l_suppkey, a AS n_major, b AS n_minor, round(max(a * ln(x) + b * ln(1 - x)) - any_value(lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2)), 6) AS score FROM segments, fractions GROUP BY ALL
""")
def scores_at_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = F.col("l_returnflag") == "R"
    counts = _items(spark, sf_dir).groupBy("l_suppkey").agg(F.count(F.when(~returned, 1)).alias("n_major"), F.count(F.when(returned, 1)).alias("n_minor"))
    return purity.scored_at(counts, "n_major", "n_minor", 0.6).withColumn("score", F.round("score", 6))


@query("""
WITH clusters AS (SELECT l_linenumber, avg(l_quantity) AS m, 1 + stddev_pop(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1),
grid AS (SELECT 1 + k / 4.0::DOUBLE AS k FROM (SELECT unnest(generate_series(0, 60)) AS k)),
best AS (SELECT k, n * max(-0.5 * ((m - (0.3 + 0.7 * c::DOUBLE) * k) / s) * ((m - (0.3 + 0.7 * c::DOUBLE) * k) / s) - ln(s) - 0.5 * ln(2 * pi())) AS p FROM clusters, grid, (SELECT unnest(generate_series(0, 5)) AS c) GROUP BY k, l_linenumber, n)
SELECT k, round(sum(p), 3) AS score FROM best GROUP BY k
""")
def coverage_comb_at_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = _items(spark, sf_dir).groupBy("l_linenumber").agg(F.avg("l_quantity").alias("m"), (1 + F.stddev_pop("l_quantity")).alias("s"), F.count(F.lit(1)).alias("n"))
    return purity.coverage_comb(clusters, "m", "s", [1 + k / 4 for k in range(61)], purity=0.7, weight="n").select("k", F.round("score", 3).alias("score"))
