import random
import re

import numpy as np

from strandline.llm import components, jaccard_join
from tests.llm.samples import SCHEMA, awkward, frame


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    forest = components.Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                forest.join(i, j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[forest.root(i)] = min(r[0], least.get(forest.root(i), r[0]))
    return sorted(((r[0], len(s), least.get(forest.root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=repr)


def got(df, **options):
    return sorted(map(tuple, jaccard_join.grouped(df, ["doc_id"], **options).collect()), key=repr)


def near_copies(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.8:
            text = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
        else:
            text = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        base.append(" ".join(text))
        rows.append((i, base[-1], None, None, 0))
    return rows


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == brute(docs.select("doc_id", "text").collect())


def test_awkward_rows(spark):
    assert got(frame(spark)) == brute(awkward())


def test_chains_of_near_copies_and_small_pieces(spark):
    rows = near_copies(250)
    expected = brute(rows)
    assert len({r[2] for r in expected}) < 200
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(docs) == expected
    # pieces of a few sets and a useless order of n-grams: the same result
    assert got(docs, piece_bytes=3000, counter_bits=6) == expected


def test_ties_null_ids_and_empty(spark):
    text = "one two three four five six"
    rows = [(5, text, None, None, 0), (5, text, None, None, 0), (None, text.upper(), None, None, 0), (2, "a b", None, None, 0), (1, "A B", None, None, 0), (None, "z", None, None, 0), (8, "", None, None, 0)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_block_join_and_difference_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**60, 200).astype(np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        at = rng.integers(0, 200, rng.integers(0, 20))
        s[at] = rng.integers(0, 2**60, len(at))
        sets.append(np.unique(s[: rng.integers(150, 200)]))
    label = jaccard_join.link(sets, 85)
    forest = components.Forest()
    for i in range(60):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                forest.join(i, j)
            bound = jaccard_join._apart(sets[i], sets[j], 10**9, 3)
            assert bound <= len(sets[i]) + len(sets[j]) - 2 * common
    assert [forest.root(k) for k in range(60)] == label.tolist()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1400)]
    forest = components.Forest()
    for a, b in edges:
        forest.join(a, b)
    rows = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7), "test").collect()
    assert {r.node: r.root for r in rows} == {x: forest.root(x) for e in edges for x in e if forest.root(x) != x}
    assert len(rows) == len({r.node for r in rows})
