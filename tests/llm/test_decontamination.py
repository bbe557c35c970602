import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm import decontamination
from tests.llm.samples import SCHEMA, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows = defaultdict(set)
    for name, text in items:
        w = words(text)
        width = min(window, len(w))
        for i in range(len(w) - width + 1 if w else 0):
            windows[tuple(w[i : i + width])].add(str("" if name is None else name))
    widths = {len(k) for k in windows}
    tests = [(str("" if name is None else name), words(text)) for name, text in items]
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for width in widths:
            for i in range(len(w) - width + 1):
                if (found := windows.get(tuple(w[i : i + width]))) is not None:
                    hit.update(range(i, i + width))
                    names |= found
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit), *longest(w, tests, window)))
    return out


def longest(w, tests, window):
    """Longest run of equal words by plain comparison of every two places."""
    best = (0, "", 0, 0)
    for name, t in tests:
        for i in range(len(w)) if t else ():
            for k in range(len(t)):
                if w[i] == t[k] and not (i and k and w[i - 1] == t[k - 1]):
                    n = 1
                    while i + n < len(w) and k + n < len(t) and w[i + n] == t[k + n]:
                        n += 1
                    if n >= min(window, len(t)) and (not best[0] or (-n, name, i, k) < (-best[0], best[1], best[3], best[2])):
                        best = (n, name, k, i)
    return best if best[0] else (0, None, None, None)


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontamination.report(docs, items, ["doc_id"]).collect()
    assert key(got) == key(brute(docs.select("doc_id", "text").collect(), items.select("item_id", "text").collect()))
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_awkward_rows_short_items_and_blocks(spark):
    docs = frame(spark)
    texts = [r.text for r in docs.collect() if r.text]
    items = [(1, texts[0]), (2, "the of"), (3, None), (4, ""), (5, "22"), (6, texts[5] + " zz"), (6, texts[3]), (None, "AB ab CD"), (8, "word word word"), (9, "word " * 100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = key(brute(docs.collect(), items))
    assert key(decontamination.report(docs, bench, ["doc_id"]).collect()) == expected
    # one item a block: more passes, the same result
    assert key(decontamination.report(docs, bench, ["doc_id"], block_bytes=1).collect()) == expected


def test_small_shards(spark, monkeypatch):
    docs = frame(spark)
    items = [(i, t.text) for i, t in enumerate(docs.limit(5).collect())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    shard = decontamination.Shard
    monkeypatch.setattr(decontamination, "SHARD_SUFFIXES", 7)
    made = decontamination.Shard(decontamination.TestItems([("1", b"a b c d e")], 10))
    made.add(decontamination.words_of(b"x a b c d y"))
    assert shard is decontamination.Shard and made.count == 1
    assert key(decontamination.report(docs, bench, ["doc_id"]).collect()) == key(brute(docs.collect(), items))


def test_empty_tables_keep_columns_and_longest(spark):
    docs = frame(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    kept = decontamination.decontaminated(docs.withColumn("__items", F.lit("clash")).drop("__items"), none)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert decontamination.report(spark.createDataFrame([], SCHEMA), none, ["doc_id"]).count() == 0
    bench = spark.createDataFrame([(1, "q q the quick brown fox jumps zz")], "item_id long, text string")
    rows = spark.createDataFrame([(5, "say the QUICK brown fox"), (7, "so: the quick brown fox jumps over")], "doc_id long, text string")
    best = {r.item_word: (r.n_words, r.doc_id, r.doc_word) for r in decontamination.longest_matches(rows, bench).collect()}
    assert best == {2: (5, 7, 1), 3: (4, 7, 2)}


def test_matches_beyond_sixty_four_words(spark):
    """A match of 300 words that two blocks of items and two texts share."""
    item = " ".join(f"t{k}" for k in range(300))
    docs = [(1, "lead " + item + " tail"), (2, " ".join(item.split()[:70])), (3, None)]
    bench = [(1, item), (2, "x " + " ".join(item.split()[10:250]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (1, 1 << 20):
        got = decontamination.report(rows, spark.createDataFrame(bench, "item_id long, text string"), ["doc_id"], block_bytes=size).collect()
        assert key(got) == key(brute(docs, bench))
        assert {r.doc_id: r.longest_words for r in got} == {1: 300, 2: 70, 3: 0}


def test_clashing_columns_pass_through(spark):
    docs = frame(spark).withColumnsRenamed({"lang": "__items", "source": "__from"})
    bench = spark.createDataFrame([(1, "no such words here")], "item_id long, text string")
    kept = decontamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def test_one_word_a_million_times(spark):
    rows = spark.createDataFrame([(1, "word " * 1_000_000), (2, "word")], "doc_id long, text string")
    got = decontamination.report(rows, spark.createDataFrame([(1, "word " * 100)], "item_id long, text string"), ["doc_id"]).collect()
    assert [(r.n_words, r.n_hit, r.longest_words, r.longest_item_word, r.longest_doc_word) for r in sorted(got)] == [(1_000_000, 1_000_000, 100, 0, 0), (1, 0, 0, None, None)]
