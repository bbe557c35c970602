"""Moves of allelic segments: all clusters at once, weights as one by one."""

import math

import numpy as np

from strandline.functions.special import np_betaln
from strandline.operators import dirichlet


def planted(n, seed=1):
    rng = np.random.default_rng(seed)
    total = rng.integers(30, 4000, n)
    minor = rng.binomial(total, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5], n))
    return dirichlet.AllelicClusters(minor, total - minor, total // 50 + 1, seed=seed)


def plain(state, k):
    """Log weights of each cluster (a new one last) and flip, one by one."""
    out, turned = [], lambda j, flip: (state.b[j], state.a[j]) if flip else (state.a[j], state.b[j])
    numbers = sorted(set(state.cluster.tolist()) - {-1})
    total = sum(state.size[j] for j in range(len(state.a)) if state.cluster[j] >= 0) + state.size[k]
    evidence = lambda a, b: float(np_betaln(a + 1 + state.h, b + 1 + state.h))
    for c in [*numbers, None]:
        own = [j for j in range(len(state.a)) if state.cluster[j] == c]
        x, y = (sum(turned(j, state.flipped[j])[side] for j in own) for side in (0, 1))
        size = float(sum(state.size[j] for j in own)) if own else None
        for flip in (False, True):
            a, b = turned(k, flip)
            score = evidence(x + a, y + b) - evidence(x, y) + dirichlet.count_prior(state.size[k], size, total, state.alpha)
            score += math.log(state.flip_prob[k] if flip else 1 - state.flip_prob[k])
            for j in (k - 1, k + 1):
                if 0 <= j < len(state.a) and state.cluster[j] >= 0:
                    p, q = turned(j, state.flipped[j])
                    gain = float(np_betaln(a + p + 1, b + q + 1) - np_betaln(a + 1, b + 1) - np_betaln(p + 1, q + 1))
                    score -= math.log1p(math.exp(min(-gain if state.cluster[j] == c else gain, 700)))
            out.append(score)
    return np.array(out)


def test_weights_are_those_of_single_clusters():
    state = planted(60)
    state.run(2, 1)
    for k in range(60):
        state._leave(k)
        got, expected = state.scores(k).ravel(), plain(state, k)
        assert np.allclose(got - got.max(), expected - expected.max(), atol=1e-7)
        state.move(k)
        numbers = state.names.tolist()
        assert numbers == sorted(set(state.cluster.tolist()))
        assert state.sums[:-1, 3].tolist() == [int((state.cluster == c).sum()) for c in numbers] and not state.sums[-1].any()


def test_a_move_calls_the_gamma_function_once(monkeypatch):
    state, calls = planted(200), []

    def counted(x, real=dirichlet.np_lgamma):
        calls.append(1)
        return real(x)

    monkeypatch.setattr(dirichlet, "np_lgamma", counted)
    monkeypatch.setattr(dirichlet, "np_betaln", lambda a, b: counted(a) + counted(b) - counted(np.asarray(a, dtype=float) + b))
    for k in range(200):
        state.move(k)
    assert len(calls) == 200


def test_one_segment():
    state = dirichlet.AllelicClusters([3], [9], [1])
    cluster, flipped, loglik = state.run(2, 1)[-1]
    assert len(cluster) == len(flipped) == len(state.names) == 1 and np.isfinite(loglik)
