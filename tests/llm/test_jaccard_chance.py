"""Phrases that documents share by chance tie no classes, however noisy the order."""

import random

import pytest

from strandline.llm import jaccard_join
from tests.llm.samples import SCHEMA
from tests.llm.test_jaccard_join import brute, got, near_copies


def ring(n):
    """Each document shares eight words with the one before and the one after."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    phrases = [[word() for _ in range(8)] for _ in range(n)]
    return [(k, " ".join([*phrases[k - 1], *[word() for _ in range(30)], *phrases[k]]), None, None, 0) for k in range(n)]


def test_shared_phrases_make_no_block(spark, monkeypatch):
    rows = ring(300)
    rows += [(1000 + k, rows[k][1] + " more", None, None, 0) for k in range(0, 300, 30)]
    sizes = {}

    def stored(df, name, real=jaccard_join.stored):
        out = real(df, name)
        if name == "jaccard-blocks":
            sizes[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stored", stored)
    found = got(spark.createDataFrame(rows, SCHEMA), counter_bits=6)
    assert found == brute(rows)
    assert sum(r[2] != r[0] for r in found) == 10
    assert sizes["jaccard-blocks"] < 60  # 96 where a shared phrase ties


@pytest.mark.parametrize("paired", [2, 3, 1000])
def test_neighbours_of_large_groups_and_all_pairs_of_small_ones(spark, monkeypatch, paired):
    monkeypatch.setattr(jaccard_join, "PAIRED", paired)
    rows = near_copies(200, seed=5)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5), counter_bits=6) == brute(rows)


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (60, 70), (500, 515), (515, 500), (1000, 1100), (3, 5000)):
        for common in (0, min(n, m) // 2, min(n, m)):
            every = np.unique(rng.integers(0, 2**63, n + m).astype(np.uint64))
            rng.shuffle(every)
            x, y = np.sort(every[:n]), np.sort(np.concatenate([every[:common], every[n : n + m - common]]))
            apart = len(np.setxor1d(x, y))
            low = jaccard_join.differing(jaccard_join.sketch(x), jaccard_join.sketch(y))
            assert low <= apart and (low - apart) % 2 == 0
            if common == 0 and n > 300 and m < 2 * n:
                assert low > 0.25 * min(n, m)
