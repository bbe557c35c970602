"""Queries over the star tables and events, each with its DuckDB SQL.

The tables stand in for genomic inputs: line items for allele counts, events
of a user for sites along a chromosome arm, orders of a customer for bins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import aggregates, intervals, ordered, purity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Since 1970, of a timestamp without time zone: the session's is not used."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


HOUR = 3600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", F.floor(micros("ts") / 1_000_000).cast("long").alias("at"))


def _visits(events: DataFrame) -> DataFrame:
    """Six hours from each purchase: (user_id, visit, start, stop)."""
    return events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("visit"), F.col("at").alias("start"), (F.col("at") + 6 * HOUR).alias("stop"))


EVENTS_SQL = "events_at AS (SELECT event_id, user_id, event_type, value, ts, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec FROM events)"
VISITS_SQL = EVENTS_SQL + ", visits AS (SELECT user_id, event_id AS visit, sec AS start, sec + 21600 AS stop FROM events_at WHERE event_type = 'purchase')"


@query("""
SELECT o_orderpriority AS arm, l_linestatus AS haplotype, sum(ma) AS major, sum(mi) AS minor, count(*) AS n,
  round(lgamma(sum(ma) + 1) + lgamma(sum(mi) + 1) - lgamma(sum(ma) + sum(mi) + 2), 3) AS log_evidence
FROM (SELECT o_orderpriority, l_linestatus, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS ma, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS mi
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1, 2
""")
def allele_betaln_by_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", "l_quantity")
    arms = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("arm"))
    flagged = F.col("l_returnflag") == "R"
    sites = items.join(arms, "l_orderkey").select("arm", F.col("l_linestatus").alias("haplotype"), F.when(flagged, F.col("l_quantity")).otherwise(0.0).alias("ma"), F.when(flagged, 0.0).otherwise(F.col("l_quantity")).alias("mi"))
    out = aggregates.allele_evidence(sites, ["arm", "haplotype"], "ma", "mi")
    return out.withColumn("log_evidence", F.round("log_evidence", 3))


@query("""
WITH imputed AS (SELECT c_custkey AS site, c_acctbal AS value FROM customer WHERE c_mktsegment = 'BUILDING'),
backed AS (SELECT o_custkey AS site, max(o_totalprice) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT i.site, coalesce(b.value, i.value) AS value, b.site IS NOT NULL AS backed FROM imputed i LEFT JOIN backed b USING (site)
UNION ALL SELECT site, value, TRUE FROM backed WHERE NOT EXISTS (SELECT 1 FROM imputed i WHERE i.site = backed.site)
""")
def rbp_antijoin_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    imputed = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("site"), F.col("c_acctbal").alias("value"))
    backed = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("site")).agg(F.max("o_totalprice").alias("better"))
    updated = imputed.join(backed, "site", "left").select("site", F.coalesce("better", "value").alias("value"), F.col("better").isNotNull().alias("backed"))
    added = backed.join(imputed, "site", "left_anti").select("site", F.col("better").alias("value"), F.lit(True).alias("backed"))
    return updated.unionByName(added)


@query("WITH " + VISITS_SQL + """
SELECT event_id, coalesce(min(visit), -1) AS visit FROM events_at e LEFT JOIN visits v ON e.user_id = v.user_id AND sec >= start AND sec < stop GROUP BY event_id
""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return intervals.first_interval(events.select("event_id", "user_id", "at"), _visits(events), ["user_id"], "at", "start", "stop", "visit", 6 * HOUR, ["event_id"])


@query("WITH " + VISITS_SQL + """
, inside AS (SELECT event_id, min(visit) AS visit FROM events_at e JOIN visits v ON e.user_id = v.user_id AND sec >= start AND sec < stop GROUP BY event_id),
padded AS (SELECT event_id, min(visit) AS visit FROM events_at e JOIN visits v ON e.user_id = v.user_id AND sec >= start - 7200 AND sec < stop + 7200 GROUP BY event_id)
SELECT e.event_id, coalesce(i.visit, p.visit, -1) AS visit FROM events_at e LEFT JOIN inside i USING (event_id) LEFT JOIN padded p USING (event_id)
""")
def padded_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    return intervals.padded_interval(events.select("event_id", "user_id", "at"), _visits(events), ["user_id"], "at", "start", "stop", "visit", 6 * HOUR, 2 * HOUR, ["event_id"])


@query("""
WITH spans AS (SELECT o_custkey, o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day FROM orders)
SELECT a.o_orderkey AS first_order, b.o_orderkey AS second_order, least(a.day, b.day) + 30 - greatest(a.day, b.day) AS days
FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND greatest(a.day, b.day) < least(a.day, b.day) + 30
""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("day"))
    left = spans.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.col("day").alias("a"), (F.col("day") + 30).alias("b"))
    right = spans.select("o_custkey", F.col("o_orderkey").alias("second_order"), F.col("day").alias("c"), (F.col("day") + 30).alias("d"))
    met = intervals.overlaps(left, right, ["o_custkey"], ("a", "b"), ("c", "d"), 30).filter("first_order < second_order")
    return met.select("first_order", "second_order", (F.col("overlap_end") - F.col("overlap_start")).alias("days"))


@query("""
WITH days AS (SELECT o_custkey, o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day FROM orders),
target AS (SELECT o_custkey, day FROM days JOIN orders USING (o_orderkey, o_custkey) WHERE o_orderpriority = '1-URGENT'),
met AS (SELECT o_orderkey, t.day AS near, abs(t.day - d.day) AS gap FROM days d JOIN target t ON d.o_custkey = t.o_custkey AND abs(t.day - d.day) <= 60)
SELECT o_orderkey, arg_min(near, gap * 1000000 + near) AS near FROM met GROUP BY 1
""")
def nearest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    days = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", day.alias("day"))
    target = days.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("day").alias("near"))
    return intervals.nearest_within(days.select("o_custkey", "o_orderkey", "day"), target, ["o_custkey"], "day", "near", 60, ["o_orderkey"])


@query("""
WITH spans AS (SELECT o_custkey, o_orderkey, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS day, CASE WHEN o_orderpriority = '1-URGENT' THEN 120 ELSE 10 END AS long FROM orders)
SELECT a.o_orderkey AS inner_order, max(b.o_orderkey) AS outer_order FROM spans a JOIN spans b
ON a.o_custkey = b.o_custkey AND b.long = 120 AND a.long = 10 AND a.day >= b.day AND a.day < b.day + 120 AND a.day + 10 <= b.day + 120 GROUP BY 1
""")
def contained_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    spans = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", day.alias("day"))
    inner = spans.filter("o_orderpriority != '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("inner_order"), F.col("day").alias("a"), (F.col("day") + 10).alias("b"))
    outer = spans.filter("o_orderpriority = '1-URGENT'").select("o_custkey", F.col("o_orderkey").alias("outer_order"), F.col("day").alias("c"), (F.col("day") + 120).alias("d"))
    return intervals.contained(inner, outer, ["o_custkey"], "a", "b", "c", "d", "outer_order", 120, ["inner_order"])


@query("""
SELECT event_id, round(sum(w * value) OVER five / sum(w) OVER five, 6) AS mean5, round(sum(w * value) OVER eleven / sum(w) OVER eleven, 6) AS mean11
FROM (SELECT *, 1 + event_id % 7 AS w FROM events)
WINDOW five AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), eleven AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
""")
def moving_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("w", (1 + F.col("event_id") % 7).cast("double"))
    for width in (5, 11):
        rows = ordered.moving_weighted_mean(rows, ["user_id"], ["ts", "event_id"], "value", "w", width, f"mean{width}")
    return rows.select("event_id", F.round("mean5", 6).alias("mean5"), F.round("mean11", 6).alias("mean11"))


@query("""
WITH rated AS (SELECT l_returnflag, l_quantity / l_extendedprice AS rate, l_discount FROM lineitem),
scaled AS (SELECT r.*, (rate - m) / s AS z FROM rated r, (SELECT avg(rate) AS m, stddev_pop(rate) AS s FROM rated))
SELECT l_returnflag, count(*) AS n, round(sum(z), 4) AS sum_z, round(max(z), 6) AS max_z FROM scaled WHERE abs(z) < 2 GROUP BY 1
""")
def zscore_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") / F.col("l_extendedprice")).alias("rate"))
    kept = aggregates.standardise(rated, ["rate"]).filter(F.abs("rate_z") < 2)
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate_z"), 4).alias("sum_z"), F.round(F.max("rate_z"), 6).alias("max_z"))


@query("""
WITH logs AS (SELECT p_partkey, ln(1 + p_retailprice) AS l, p_size::DOUBLE AS x FROM part)
SELECT p_partkey, round((l - ml) / sl, 6) AS price_lz, round((x - mx) / sx, 6) AS size_z FROM logs, (SELECT avg(l) AS ml, stddev_pop(l) AS sl, avg(x) AS mx, stddev_pop(x) AS sx FROM logs)
""")
def covariate_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    scaled = aggregates.standardise(aggregates.log_standardise(parts, ["price"]), ["size"])
    return scaled.select("p_partkey", F.round("price_lz", 6).alias("price_lz"), F.round("size_z", 6).alias("size_z"))


@query("""
WITH marked AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS step, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum(CASE WHEN k = 1 THEN 0 ELSE step END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM marked)
SELECT user_id, island, event_type, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM numbered GROUP BY ALL
""")
def gaps_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.collapse(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"], [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n")])


@query("""
WITH numbered AS (SELECT l_suppkey, CAST(epoch_us(l_shipdate) // 86400000000 AS BIGINT) AS day FROM lineitem GROUP BY ALL),
runs AS (SELECT l_suppkey, min(day) AS start, max(day) AS stop, count(*) AS n FROM (SELECT *, day - row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS run FROM numbered) GROUP BY l_suppkey, run)
SELECT * FROM runs WHERE n >= 3
""")
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").select("l_suppkey", F.floor(micros("l_shipdate") / 86_400_000_000).cast("long").alias("day")).distinct()
    return ordered.consecutive_runs(days, ["l_suppkey"], "day", 3)


@query("""
WITH sized AS (SELECT o_orderpriority, count(*) AS n, count(*) // 97 AS whole FROM orders GROUP BY 1),
counted AS (SELECT *, CASE WHEN whole > 0 AND n - whole * 97 < 97 * 0.05 THEN whole ELSE whole + 1 END AS chunks FROM sized)
SELECT o_orderpriority, chunk, chunk * 97 AS start, CASE WHEN chunk = chunks - 1 THEN n ELSE (chunk + 1) * 97 END AS "end" FROM (SELECT *, unnest(generate_series(0, chunks - 1)) AS chunk FROM counted)
""")
def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.chunk_ranges(table(spark, sf_dir, "orders"), ["o_orderpriority"], 97)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS site FROM orders")
def dense_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.row_ids(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], ["o_orderkey"], "site").select("o_orderkey", "site")


@query("""
WITH counts AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('click', 'view') THEN ceil(value / 10) ELSE 0 END AS a, CASE WHEN event_type IN ('click', 'view') THEN 0 ELSE ceil(value / 10) END AS b FROM events),
sums AS (SELECT event_id, user_id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY user_id) AS ta, sum(b) OVER (PARTITION BY user_id) AS tb FROM counts WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT *, lgamma(ca + 2) + lgamma(cb + 2) - lgamma(ca + cb + 4) + lgamma(ta - ca + 2) + lgamma(tb - cb + 2) - lgamma(ta - ca + tb - cb + 4) AS s FROM sums),
topped AS (SELECT *, max(s) OVER (PARTITION BY user_id) AS top FROM scored)
SELECT event_id, round(s - top - ln(sum(exp(s - top)) OVER (PARTITION BY user_id)), 4) AS log_posterior FROM topped
""")
def split_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, count = F.col("event_type").isin("click", "view"), F.ceil(F.col("value") / 10).cast("double")
    sites = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(chosen, count).otherwise(0.0).alias("a"), F.when(chosen, 0.0).otherwise(count).alias("b"))
    return ordered.split_posterior(sites, ["user_id"], ["ts", "event_id"], "a", "b").select("event_id", F.round("log_posterior", 4).alias("log_posterior"))


@query("""
WITH rows_ AS (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
stats AS (SELECT o_custkey, max(n) AS n, avg(v) FILTER (k > 1 AND k < n) AS m, stddev_pop(v) FILTER (k > 1 AND k < n) AS s, max(v) FILTER (k = 1) AS a, max(v) FILTER (k = 2) AS a2, max(v) FILTER (k = n) AS z, max(v) FILTER (k = n - 1) AS z2 FROM rows_ GROUP BY 1)
SELECT o_custkey, n, coalesce(abs(a - m) > 1.5 * s AND abs(a - m) > abs(a2 - m) AND n >= 4, FALSE) AS first_out, coalesce(abs(z - m) > 1.5 * s AND abs(z - m) > abs(z2 - m) AND n >= 4, FALSE) AS last_out FROM stats
""")
def edge_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.edge_outliers(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 1.5)


@query("SELECT l_suppkey, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity) * count(*), 4) AS ssd FROM lineitem GROUP BY 1")
def ssd_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = aggregates.deviations(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity")
    return aggregates.merge_deviations(parts, ["l_suppkey"]).select("l_suppkey", "n", F.round("mean", 6).alias("mean"), F.round("ssd", 4).alias("ssd"))


@query("""
SELECT round(regr_slope(s, m), 6) AS slope, round(regr_intercept(s, m), 5) AS intercept, round(median(m), 6) AS median_mean, round(median(s), 6) AS median_sd, count(*) AS groups
FROM (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY l_partkey)
""")
def mean_std_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = aggregates.spread_line(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity")
    return line.select(F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("median_mean", 6).alias("median_mean"), F.round("median_sd", 6).alias("median_sd"), "groups")


_COMB = """
segments AS (SELECT l_suppkey, floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)) AS a, floor(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END)) AS b FROM lineitem GROUP BY 1),
levels AS (SELECT na, tau FROM (SELECT unnest(generate_series(1, 7)) AS tau) t, (SELECT unnest(generate_series(1, 7)) AS na) n WHERE 2 * na >= tau AND na <= tau),
grid AS (SELECT k / 10001.0::DOUBLE AS purity FROM (SELECT unnest(generate_series(1, 10000)) AS k)),
fractions AS (SELECT purity, (1 + purity * (na - 1)) / (2 * (1 - purity) + tau * purity) AS x FROM grid, levels),
best AS (SELECT l_suppkey, purity, max(a * ln(x) + b * ln(1 - x)) - any_value(lgamma(a + 1) + lgamma(b + 1) - lgamma(a + b + 2)) AS p FROM segments, fractions WHERE x > 0 AND x < 1 GROUP BY 1, 2)
"""


@query("WITH " + _COMB + "SELECT round(purity, 9) AS purity, round(sum(p), 2) AS score FROM best GROUP BY purity")
def purity_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = F.col("l_returnflag") == "R"
    segments = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.floor(F.sum(F.when(flagged, F.col("l_quantity")).otherwise(0.0))).alias("a"), F.floor(F.sum(F.when(flagged, 0.0).otherwise(F.col("l_quantity")))).alias("b"))
    comb = purity.purity_comb(segments, "a", "b")
    return comb.select(F.round("purity", 9).alias("purity"), F.round("score", 2).alias("score"))


@query("""
WITH clusters AS (SELECT l_shipdate, avg(l_quantity) AS m, 1 + stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1),
grid AS (SELECT 1 + k / 4.0::DOUBLE AS k FROM (SELECT unnest(generate_series(0, 60)) AS k)),
best AS (SELECT k, max(-0.5 * ((m - c * k) / s) * ((m - c * k) / s) - ln(s) - 0.5 * ln(2 * pi())) AS p FROM clusters, grid, (SELECT unnest(generate_series(0, 5)) AS c) GROUP BY k, l_shipdate)
SELECT k, round(sum(p), 4) AS score FROM best GROUP BY k
""")
def coverage_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.avg("l_quantity").alias("m"), (1 + F.stddev_pop("l_quantity")).alias("s"))
    return purity.coverage_comb(clusters, "m", "s", [1 + k / 4 for k in range(61)]).select("k", F.round("score", 4).alias("score"))


@query("""
WITH options AS (SELECT * FROM (VALUES (0, 12.0, 4.0), (1, 25.0, 3.0), (2, 40.0, 5.0)) t(c, m, s)),
means AS (SELECT l_partkey, avg(l_quantity) AS x FROM lineitem GROUP BY 1),
scored AS (SELECT l_partkey, c, -0.5 * ((x - m) / s) * ((x - m) / s) - ln(s) - 0.5 * ln(2 * pi()) AS l FROM means, options UNION ALL SELECT l_partkey, -1, -ln(60.0) FROM means)
SELECT l_partkey, arg_max(c, l) AS cluster, round(max(l), 6) AS loglik FROM scored GROUP BY 1
""")
def reassign_or_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("x"))
    out = purity.assign(means, ["l_partkey"], "x", [(0, 12.0, 4.0), (1, 25.0, 3.0), (2, 40.0, 5.0)], 0.0, 60.0)
    return out.withColumn("loglik", F.round("loglik", 6))


@query("""
WITH scored AS (SELECT p_size AS score, sum(p_retailprice) AS w FROM part GROUP BY 1),
run AS (SELECT score, sum(w) OVER (ORDER BY score) / sum(w) OVER () AS share, min(score) OVER () AS a, max(score) OVER () AS z FROM scored)
SELECT score, round(share, 8) AS share, round(share - (score - a)::DOUBLE / (z - a), 8) + 0.0 AS bend FROM run
""")
def elbow_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.elbow(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(F.col("p_size").alias("score"), F.round("share", 8).alias("share"), (F.round("bend", 8) + 0.0).alias("bend"))


@query("""
WITH draws AS (SELECT user_id AS draw, round(sum(value), 6) AS loglik, count(*) AS n FROM events GROUP BY 1)
SELECT draw, n, loglik FROM draws ORDER BY loglik DESC, draw LIMIT 1
""")
def map_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("draw")).agg(F.round(F.sum("value"), 6).alias("loglik"), F.count(F.lit(1)).alias("n"))
    return aggregates.best_row(draws, [], "loglik", ["draw", "n"])


@query("SELECT DISTINCT event_type, user_id, date_trunc('day', ts) AS day, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id, date_trunc('day', ts)) - 1 AS segment FROM events")
def renumber_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = table(spark, sf_dir, "events").select("event_type", "user_id", F.date_trunc("day", "ts").alias("day")).distinct()
    return ordered.renumber(local, ["event_type"], ["user_id", "day"], "segment").withColumn("segment", F.col("segment").cast("long"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice) / 2, 6) AS factor FROM lineitem GROUP BY 1")
def scale_to_ploidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.scale_to_ploidy(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity").withColumn("factor", F.round("factor", 6))


@query("""
SELECT (CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 25 THEN 1 ELSE 0 END + CASE WHEN l_quantity >= 40 THEN 1 ELSE 0 END) AS length_bin,
  (CASE WHEN l_tax >= 0.02 THEN 1 ELSE 0 END + CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END) AS ccf_bin, l_returnflag,
  round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS error FROM lineitem GROUP BY ALL
""")
def heatmap_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumn("length_bin", aggregates.bucketed(F.col("l_quantity"), [10, 25, 40])).withColumn("ccf_bin", aggregates.bucketed(F.col("l_tax"), [0.02, 0.05]))
    return items.groupBy("length_bin", "ccf_bin", "l_returnflag").agg(F.round(aggregates.weighted_mean(F.col("l_discount"), F.col("l_extendedprice")), 6).alias("error"))


@query("""
WITH cells AS (SELECT o_orderpriority, floor(o_totalprice / 5000) AS cell, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS bins, round(-sum(p * ln(p)), 6) AS entropy FROM (SELECT *, n / sum(n) OVER (PARTITION BY o_orderpriority) AS p FROM cells) GROUP BY 1
""")
def entropy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram_entropy(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", 5000).withColumn("entropy", F.round("entropy", 6))
