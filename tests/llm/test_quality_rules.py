import re
import string
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm import quality_rules as q
from tests.llm.samples import SCHEMA, awkward, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measure(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines), sum(c in string.punctuation for c in text)


def cell(v):
    return v if v < 256 else v >> (v.bit_length() - 8) << (v.bit_length() - 8)


def quartiles(values):
    cells = sorted(map(cell, values))
    at = lambda p: next(c for k, c in enumerate(cells, 1) if 4 * k >= p * len(cells))
    return len(cells), at(1), at(3)


def brute(rows, width=3, weight=200):
    counted = [(r, dict(zip(q.BASE, measure(r[1])))) for r in rows]
    rate = lambda m, k: q.RATES[k][2] * m[q.RATES[k][0]] // m[q.RATES[k][1]]
    failed = lambda m: m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
    pools = defaultdict(list)
    for r, m in counted:
        if not failed(m):
            for k in q.RATES:
                if rate(m, k) > 0 or not q.RATES[k].sparse:
                    for g in ((r[2], r[3]), (r[2],), ()):
                        pools[(g, k)].append(rate(m, k))

    def fence(r, k):
        q1 = q3 = None
        for g in ((), (r[2],), (r[2], r[3])):
            if pools[(g, k)]:
                n, low, high = quartiles(pools[(g, k)])
                q1, q3 = (low, high) if q1 is None else ((n * low + weight * q1) // (n + weight), (n * high + weight * q3) // (n + weight))
        return (0, 10**9) if q1 is None else (q1 - width * (q3 - q1), q3 + width * (q3 - q1))

    fences = {}
    out = []
    for r, m in counted:
        kept = False
        if not failed(m):
            kept = True
            for k in q.RATES:
                if (r[2], r[3], k) not in fences:
                    fences[(r[2], r[3], k)] = fence(r, k)
                low, high = fences[(r[2], r[3], k)]
                v = rate(m, k)
                kept &= (v == 0 or cell(v) <= high) if q.RATES[k].sparse else low <= cell(v) <= high
        out.append((r[0], *[m[k] for k in q.BASE[:5]], failed(m), kept))
    return sorted(out, key=repr)


def got(docs, **options):
    judged = q.judge(q.measures(docs, ["doc_id", "lang", "source"]), **options)
    return sorted(map(tuple, judged.select("doc_id", *q.BASE[:5], "base_failed", "kept").collect()), key=repr)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    for weight in (1, 200, 10_000):
        assert got(docs, weight=weight) == brute(rows, weight=weight)


def test_quantile_width_decides(spark, sf):
    """Without the interquartile width most documents lie beyond a fence; a
    wider one keeps more: no other threshold stands behind it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = q.measures(docs, ["doc_id", "lang", "source"]).cache()
    kept = [q.judge(counts, width=w).filter("kept").count() for w in (0, 1, 3)]
    passing = counts.filter(~q.base_failed()).count()
    assert kept[0] < passing / 2 < kept[1] < kept[2] < passing


def test_verdicts_change_smoothly_with_the_size_of_a_group(spark):
    """A language of long words is judged alike at 199 and 200 documents."""
    text = lambda w, i: " ".join(w + "x" * ((i + k) % 3) for k in range(30))
    for n in (199, 200):
        rows = [(i, text("abc", i), "en", "s", 0) for i in range(1000)] + [(1000 + i, text("abcdefghij", i), "xx", "s", 0) for i in range(n)]
        docs = spark.createDataFrame(rows, SCHEMA)
        found = got(docs)
        assert found == brute(rows)
        assert all(r[-1] for r in found if r[0] >= 1000) == all(r[-1] for r in brute(rows) if r[0] >= 1000)


def test_awkward_rows(spark):
    assert got(frame(spark), weight=10) == brute(awkward(), weight=10)
    clash = frame(spark).withColumn("n_words", F.lit("clash"))
    assert q.measures(clash, ["doc_id", "n_words"]).columns == ["doc_id", *q.BASE]
    taken = q.measures(frame(spark), ["doc_id", "lang", "source"]).withColumn("kept", F.lit(7)).withColumn("_lang", F.lit(7)).withColumn("marks_low", F.lit(10**9))
    assert q.judge(taken).filter("kept").count() == sum(r[-1] for r in brute(awkward()))
    assert got(frame(spark, [(1, None, None, None, None)] * 3)) == [(1, 0, 0, 0, 0, 0, True, False)] * 3


def test_text_of_several_megabytes(spark):
    words = " ".join(f"w{k}," for k in range(400_000))
    rows = [(1, words, "en", "s", 0), (2, words + "\n" + words, "en", "s", 0)]
    assert len(words) > 3 << 20
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_empty_and_all_failing(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    few = [(1, "short", "en", "s", 5), (1, "short", "en", "s", 5), (None, None, None, None, None)]
    assert got(spark.createDataFrame(few, SCHEMA)) == brute(few)


def test_sketches_merge(spark):
    """Cells keep a 128th of the value; partitions do not matter."""
    values = [0, 1, 63, 64, 255, 256, 257, 1000, 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r[0] for r in rows.select(q.cell(F.col("v"))).collect()] == [cell(v) for v in values]
    assert all(v - v / 128 < cell(v) <= v for v in values[1:])


def test_separates_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = q.judge(q.measures(docs, ["doc_id", "lang", "source"])).join(labels, "doc_id")
    rows = judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept"), F.avg(F.when(~F.col("base_failed"), F.col("kept").cast("double"))).alias("beyond")).collect()
    kept = {r.quality: r for r in rows}
    assert kept[0].kept < 0.01 and kept[1].beyond > 0.98
