"""The purity comb against every level of every segment at every purity."""

import numpy as np
import pytest

from strandline.functions.special import np_betaln
from strandline.operators import purity


def brute(rows, points, most=purity.MOST_COPIES):
    grid, out = np.arange(1, points + 1) / (points + 1.0), np.zeros(points)
    for a, b, w in rows:
        if None not in (a, b, w):
            x = np.array([(1 + grid * (na - 1)) / (2 * (1 - grid) + tau * grid) for na, tau in purity.levels(most)])
            out += w * ((a * np.log(x) + b * np.log(1 - x)).max(axis=0) - np_betaln(a + 1.0, b + 1.0))
    return grid, out


def rows_of(n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(float(a), float(b), float(w)) for a, b, w in zip(rng.integers(0, 3000, n), rng.integers(0, 3000, n), rng.random(n))]
    return rows + [(0.0, 0.0, 1.0), (5.0, 5.0, 2.0), (7.0, 0.0, 1.0), (0.0, 7.0, 1.0), (None, 3.0, 1.0), (3.0, None, 1.0), (3.0, 4.0, None), (-0.5, 9.0, 1.0)]


@pytest.mark.parametrize("most", [1, 5, 7])
def test_equals_every_level_of_every_segment(spark, monkeypatch, most):
    monkeypatch.setattr(purity, "_HELD", 20)
    rows = rows_of(120)
    df = spark.createDataFrame(rows, "a double, b double, w double").repartition(3)
    grid, expected = brute(rows, 5000, most)
    got = purity.purity_comb(df, "a", "b", points=5000, most=most, weight="w").orderBy("purity").toPandas()
    assert (got.purity.to_numpy() == grid).all()
    assert np.allclose(got.score, expected, rtol=1e-11, atol=1e-6)


def test_segments_are_not_repeated_for_each_purity(spark):
    """The rows made are purities for each task, whatever the segments."""
    segments = spark.range(50_000, numPartitions=2).selectExpr("id % 977 + 1 AS a", "id % 661 + 1 AS b")
    comb = purity.purity_comb(segments, "a", "b")
    assert "Generate" not in comb._jdf.queryExecution().executedPlan().toString()
    assert comb.count() == 10_000


def test_nulls_alone_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None)], "a double, b double")
    got = purity.purity_comb(df, "a", "b", points=9).collect()
    assert len(got) == 9 and all(r.score is None for r in got)
    assert purity.purity_comb(df.filter("false"), "a", "b", points=9).collect() == []
