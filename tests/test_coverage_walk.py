"""Breakpoints beside the peaks of the change kernel in long segments."""

import numpy as np

from strandline.operators.coverage_mcmc import CoverageSegmentation


def planted(seed):
    rng = np.random.default_rng(seed)
    means = np.r_[np.full(203, 40.0), np.full(197, 48.0)]
    return CoverageSegmentation(rng.poisson(np.exp(rng.normal(np.log(means), 0.1))), np.zeros(400))


def test_walk_reaches_breakpoints_between_peaks():
    for seed in (0, 2):
        state = planted(seed)
        places, scores = state.scored(0, 400)
        assert 203 not in state.candidates(0, 400) and places[np.argmax(scores)] == 203
        assert np.allclose(scores, [state.fit(0, m)[0] + state.fit(m, 400)[0] for m in places])
