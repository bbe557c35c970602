"""Registered queries run the operators' own budgets."""

from strandline.operators import copy_ratio, coverage_mcmc, dirichlet, purity
from strandline.plans import catalog


def test_queries_leave_budgets_to_the_operators(spark, sf, monkeypatch):
    monkeypatch.setattr(copy_ratio, "grey_segments", lambda seen: seen)
    for module, operator, query in (
        (coverage_mcmc, "coverage_segments", "coverage_segmentation"), (dirichlet, "copy_ratio_clusters", "copy_ratio_dp"),
        (dirichlet, "coverage_clusters", "coverage_dp"), (copy_ratio, "pseudo_observations", "pseudo_observations"), (purity, "purity_comb", "purity_comb"),
    ):
        asked = []

        def seen(*a, real=getattr(module, operator), **k):
            asked.append(k)
            return real(*a, **k)

        monkeypatch.setattr(module, operator, seen)
        catalog.QUERIES[query](spark, sf)
        assert len(asked) == 1 and not {"iterations", "draws", "sweeps", "points"} & set(asked[0]), query
