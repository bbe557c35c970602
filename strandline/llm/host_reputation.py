"""Empirical-Bayes host reputation for filtering urls.

Labelled pages (good or bad) give each host a count of bad among labelled.
Few labels say little about a host, so its rate is shrunk: the suffix's rate
is drawn towards the rate of all pages, the registered domain's towards its
suffix's, the host's towards its domain's. Each level is beta-binomial; how
strongly it shrinks is fitted by moments from the spread between the groups
of that level beyond what chance gives. A host is blocked when the lower
bound of its posterior bad rate lies above a limit, so that neither a few bad
labels nor none block it. Hosts without any label take their domain's
posterior, down to that of all pages.

Fixed allow and block rules on host and path come before the reputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.shared import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


#: Rules of the registered query.
RULES = tuple(rule(*x) for x in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")))
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "org.uk")
LEVELS = ("suffix", "domain", "host")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*", 0), F.lit("")))


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def registered_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The suffix and one label; addresses and names of one label stay whole."""
    two = "|".join(s.replace(".", r"\.") for s in suffixes)
    name = F.regexp_extract(host, rf"([^.:]+\.(?:{two}|[^.:]+))(?::\d*)?$", 1)
    return F.when(host.rlike(r"^[0-9.]+(:\d*)?$") | (name == ""), host).otherwise(name)


def suffix(domain: Column) -> Column:
    return F.when(domain.rlike(r"^[0-9.]+(:\d*)?$"), "").otherwise(F.regexp_extract(domain, r"^[^.]*\.(.*)$", 1))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """The longest rule that fits: its name or verdict, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, getattr(r, field)).otherwise(out)
    return out


def _strengths(levels: list[DataFrame]) -> list[tuple[float, float]]:
    """(prior strength, rate) of each level from (k, n) of its groups.

    The levels' moments are a few sums; they come to the driver as one row
    for each level. Without labels the rate is 0.
    """
    rows = [level.select(F.lit(i).alias("level"), "k", "n") for i, level in enumerate(levels)]
    total = rows[0].union(rows[1]).union(rows[2]).groupBy("level").agg(
        F.sum("k").cast("double").alias("k"), F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"),
        F.count(F.lit(1)).cast("double").alias("g"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk"),
    )
    out = [(1e4, 0.0)] * len(levels)
    for r in total.collect():
        p, spread = r.k / r.n, r.n - r.nn / r.n
        noise = p * (1 - p)
        between = (r.kk - r.k * p - (r.g - 1) * noise) / spread if spread else 0.0
        out[r.level] = (min(max(noise / between - 1 if r.g > 1 and between > 0 else 1e4, 1.0), 1e4), p)
    return out


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior (a, b) of hosts, domains, suffixes and all, from (host, bad).

    ``bad``: 0 or 1, null where a page has no label. Counting by host before
    anything else keeps a host with most of the pages to one row for a task.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("bad").alias("k"), F.count("bad").alias("n")).filter("n > 0")
    hosts = stored(hosts.withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix(F.col("domain"))), "host-counts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    by_suffix = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    (s0, rate), (s1, _), (s2, _) = _strengths([by_suffix, domains, hosts])

    def shrunk(level: DataFrame, key: str, mean: Column, strength: float) -> DataFrame:
        return level.select(key, (mean * strength + F.col("k")).alias("a"), ((1 - mean) * strength + F.col("n") - F.col("k")).alias("b"))

    def under(level: DataFrame, key: str, parent: DataFrame, on: str, strength: float) -> DataFrame:
        rows = level.join(parent.select(on, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), on)
        return shrunk(rows, key, F.col("mean"), strength)

    everything = rate * s0, (1 - rate) * s0
    of_suffix = shrunk(by_suffix, "suffix", F.lit(everything[0] / (everything[0] + everything[1])), s0)
    of_domain = under(domains, "domain", of_suffix, "suffix", s1)
    return under(hosts, "host", of_domain, "domain", s2), of_domain, of_suffix, everything


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Mean less z standard deviations of Beta(a, b)."""
    total = a + b
    return a / total - z * F.sqrt(a * b / (total * total * (total + 1)))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, limit: float = 0.5, z: float = 1.645, page_id: str = "page_id", url: str = "url", suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every page.

    ``suffixes``: those of two labels under which names are registered, as a
    public list has them. ``labels``: (page_id, bad). Several labels of a page all count; labels
    without a page, null ids and null outcomes do not. Pages with equal or
    null ids each keep their row, and urls may have any length. Without labels
    all hosts are allowed. Other columns of ``pages`` and ``labels`` are not
    looked at, whatever their names. An empty table of pages stays empty.
    """
    cut = pages.select(page_id, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    labelled = cut.select(page_id, "host").join(labels.select(page_id, "bad").filter(F.col("bad").isNotNull()), page_id)
    of_host, of_domain, of_suffix, everything = reputations(labelled.select("host", "bad"), suffixes)
    # verdicts by host before they meet the pages: a row for each host
    hosts = cut.select("host").distinct().withColumn("domain", registered_domain(F.col("host"), suffixes)).withColumn("suffix", suffix(F.col("domain")))
    bounded = lambda t, key, name: t.select(key, lower_bound(F.col("a"), F.col("b"), z).alias(name))
    hosts = hosts.join(bounded(of_host, "host", "b0"), "host", "left").join(bounded(of_domain, "domain", "b1"), "domain", "left").join(bounded(of_suffix, "suffix", "b2"), "suffix", "left")
    last = lower_bound(F.lit(everything[0]), F.lit(everything[1]), z)
    # written down, so that Spark can split a host with most of the pages
    blocked = stored(hosts.filter(F.coalesce("b0", "b1", "b2", last) > limit).select("host", F.lit("block").alias("_reputation")), "host-blocked")
    judged = cut.join(blocked, "host", "left")
    return judged.select(
        page_id, "host", "path", matching_rule(F.col("host"), F.col("path"), rules, "name").alias("rule"),
        F.coalesce(matching_rule(F.col("host"), F.col("path"), rules, "verdict"), F.col("_reputation"), F.lit("allow")).alias("verdict"),
    )


_TWO = "|".join(s.replace(".", r"\.") for s in TWO_LABEL_SUFFIXES)
ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
named AS (
  SELECT *, CASE WHEN regexp_matches(host, '^[0-9.]+(:[0-9]*)?$') OR regexp_extract(host, '([^.:]+\.(?:@TWO|[^.:]+))(:[0-9]*)?$', 1) = '' THEN host ELSE regexp_extract(host, '([^.:]+\.(?:@TWO|[^.:]+))(:[0-9]*)?$', 1) END AS domain
  FROM cut),
placed AS (SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+(:[0-9]*)?$') THEN '' ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix FROM named),
bad AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL),
hosts AS (SELECT host, domain, suffix, sum(bad)::BIGINT AS k, count(*) AS n FROM placed JOIN bad ON page_id = doc_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(k)::BIGINT AS k, sum(n)::BIGINT AS n FROM domains GROUP BY ALL),
moments AS (
  SELECT lvl, sum(k)::DOUBLE AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, count(*)::DOUBLE AS g, sum(k::DOUBLE * k / n) AS kk
  FROM (SELECT 0 AS lvl, k, n FROM suffixes UNION ALL SELECT 1, k, n FROM domains UNION ALL SELECT 2, k, n FROM hosts) GROUP BY lvl),
spread AS (SELECT lvl, g, k / n AS p, (k / n) * (1 - k / n) AS noise, (kk - k * (k / n) - (g - 1) * ((k / n) * (1 - k / n))) / nullif(n - nn / n, 0) AS tau FROM moments),
strength AS (SELECT lvl, p, least(greatest(CASE WHEN g > 1 AND tau > 0 THEN noise / tau - 1 ELSE 1e4 END, 1.0), 1e4) AS s FROM spread),
everything AS (SELECT p * s AS a, (1 - p) * s AS b FROM strength WHERE lvl = 0),
of_suffix AS (SELECT suffix, e.a / (e.a + e.b) * s + k AS a, (1 - e.a / (e.a + e.b)) * s + n - k AS b FROM suffixes, everything e, strength WHERE lvl = 0),
of_domain AS (SELECT domain, u.a / (u.a + u.b) * s + k AS a, (1 - u.a / (u.a + u.b)) * s + n - k AS b FROM domains JOIN of_suffix u USING (suffix), strength WHERE lvl = 1),
of_host AS (SELECT host, u.a / (u.a + u.b) * s + k AS a, (1 - u.a / (u.a + u.b)) * s + n - k AS b FROM hosts JOIN of_domain u USING (domain), strength WHERE lvl = 2),
bounds AS (
  SELECT host, coalesce(
    (SELECT a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) FROM of_host h WHERE h.host = p.host),
    (SELECT a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) FROM of_domain d WHERE d.domain = p.domain),
    (SELECT a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) FROM of_suffix s WHERE s.suffix = p.suffix),
    (SELECT a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) FROM everything)) AS low
  FROM (SELECT DISTINCT host, domain, suffix FROM placed) p),
rules(verdict, name, rh, rp) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
ruled AS (
  SELECT host, path, arg_max(name, length(name)) AS rule, arg_max(verdict, length(name)) AS verdict
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, c.host, c.path, r.rule, coalesce(r.verdict, CASE WHEN b.low > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM cut c LEFT JOIN ruled r USING (host, path) LEFT JOIN bounds b ON b.host = c.host
""".replace("@TWO", _TWO)
