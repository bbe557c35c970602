import math
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import host_reputation as h
from strandline.llm import registry

PAGES, LABELS = "page_id long, url string", "page_id long, bad int"


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        path = f"{sf}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    got = registry.op9_host_reputation(spark, sf)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(map(tuple, got.collect())) == Counter(con.sql(h.ORACLE_SQL).fetchall())


def judged(spark, pages, labels, **options):
    rows = h.judge(spark.createDataFrame(pages, PAGES), spark.createDataFrame(labels, LABELS), **options).collect()
    return sorted(rows, key=lambda r: (r.page_id is None, r.page_id, r.host))


def test_urls_and_rules(spark):
    urls = [
        None, "", "no scheme/en/", "http://A.Example.COM/en/7x?q#f", "https://example.com#top", "x://b.net/de/8", "http://example.net/de/8", "http://sub.example.net/de/80?x", "http://notexample.net/de/8",
        "http://q.org/es/", "http://com/en/", "http://user@h.com:80/en/", "a://b://c/d", "http://é.org/es/\nx?y",
    ]
    rows = judged(spark, list(enumerate(urls)), [])
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("example.com", "", None, "allow"),
        ("b.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("sub.example.net", "/de/80", "example.net/de/8", "block"), ("notexample.net", "/de/8", "net/de/", "allow"),
        ("q.org", "/es/", "org/es/", "block"), ("com", "/en/", "com/en/", "block"), ("user@h.com:80", "/en/", None, "allow"), ("b:", "//c/d", None, "allow"), ("é.org", "/es/\nx", "org/es/", "block"),
    ]


def test_shrinks_through_domain_and_suffix(spark):
    pages, labels = [], []

    def add(host, bad, good, open_=0):
        for k in range(bad + good + open_):
            pages.append((len(pages), f"http://{host}/{k}"))
            if k < bad + good:
                labels.append((len(pages) - 1, int(k < bad)))

    add("farm.spam.biz", 40, 1)
    add("a.spam.biz", 30, 1)
    add("new.spam.biz", 0, 0, 3)  # takes its domain's reputation
    add("one.good.org", 1, 0)  # one bad label does not block
    for k in range(12):
        add(f"h{k}.good.org", 1, 30)
        add(f"h{k}.site{k}.com", 2, 25)
    add("unseen.net", 0, 0, 2)
    verdict = {r.host: r.verdict for r in judged(spark, pages, labels, rules=())}
    blocked = {x for x, v in verdict.items() if v == "block"}
    assert blocked == {"farm.spam.biz", "a.spam.biz", "new.spam.biz"}


def test_bound_and_domains(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.com",), ("x",), ("1.2.3.4",), ("a.b.com:80",), ("",)], "host string")
    rows = df.select(h.registered_domain(F.col("host")).alias("d")).select("d", h.suffix(F.col("d")).alias("s")).collect()
    assert [tuple(r) for r in rows] == [("b.co.uk", "co.uk"), ("b.com", "com"), ("x", ""), ("1.2.3.4", ""), ("b.com", "com"), ("", "")]
    low = df.limit(1).select(h.lower_bound(F.lit(8.0), F.lit(2.0), 1.5)).first()[0]
    assert low == pytest.approx(0.8 - 1.5 * math.sqrt(0.8 * 0.2 / 11))


def test_ties_repeats_nulls_and_empty(spark):
    pages = [(None, "http://a.com/"), (1, "http://a.com/"), (1, "http://a.com/"), (2, None)]
    labels = [(1, 1), (1, 0), (None, 1), (2, None), (99, 1)]
    assert [r.verdict for r in judged(spark, pages, labels)] == ["allow"] * 4
    assert judged(spark, [], labels) == [] and len(judged(spark, pages, [])) == 4
