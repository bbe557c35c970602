"""Planted purity and copy-number scale."""

import pytest

from strandline.operators import purity

STATES = [(1, 2), (2, 3), (2, 2), (3, 4), (1, 1), (4, 5)]


@pytest.mark.parametrize("planted", [0.35, 0.6, 0.85])
def test_purity_of_planted_levels(spark, planted):
    rows = []
    for k, (na, tau) in enumerate(STATES):
        x = (1 + planted * (na - 1)) / (2 * (1 - planted) + tau * planted)
        rows.append((k, round(40_000 * x), 40_000 - round(40_000 * x)))
    counts = spark.createDataFrame(rows, "id int, major long, minor long")
    assert purity.fit_purity(counts, "major", "minor", points=1999) == pytest.approx(planted, abs=0.003)
    at = {r.id: r.score for r in purity.scored_at(counts, "major", "minor", planted).collect()}
    off = {r.id: r.score for r in purity.scored_at(counts, "major", "minor", planted + 0.03).collect()}
    assert all(at[k] >= off[k] for k in at) and sum(at.values()) > sum(off.values()) + 10


def test_scale_of_planted_clusters(spark):
    rows = [(30 * (0.4 + 0.6 * c), 0.4, n) for c, n in ((0, 50), (1, 400), (2, 200), (5, 20))]
    clusters = spark.createDataFrame(rows, "mean double, sd double, n long")
    assert purity.fit_scale(clusters, "mean", "sd", 0.6, weight="n") == pytest.approx(30, abs=0.3)


def test_few_segments(spark):
    counts = spark.createDataFrame([(5, 4)], "major long, minor long")
    assert purity.fit_purity(counts, "major", "minor", points=9) is None
    assert purity.fit_purity(counts.limit(0), "major", "minor", points=9) is None
    none = spark.createDataFrame([], "mean double, sd double")
    assert purity.fit_scale(none, "mean", "sd", 0.5) is None
