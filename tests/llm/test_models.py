"""Label model and hinge-loss solver against plain reference solutions."""

import itertools
import math

import numpy as np
import pytest

from checkframe.llm import label_model
from checkframe.llm.quality_classifier import dual_coordinate_descent


def plain_em(rows, prior, rounds, smooth):
    """Expectation-maximisation over single rows and voters, in loops; returns each row's posterior."""
    voters = range(len(rows[0]))
    p = []
    for r in rows:
        yes, no = sum(v == 1 for v in r), sum(v == 0 for v in r)
        p.append(min(max((yes + 2 * prior) / (yes + no + 2), 0.02), 0.98))
    for _ in range(rounds):
        prior = min(max(sum(p) / len(p), 0.005), 0.995)
        table = {}
        for v, y in itertools.product(voters, (0, 1)):
            mass = {out: smooth for out in (-1, 0, 1)}
            for r, q in zip(rows, p, strict=True):
                mass[r[v]] += q if y else 1 - q
            for out in mass:
                table[v, y, out] = mass[out] / sum(mass.values())
        p = []
        for r in rows:
            one = prior * math.prod(table[v, 1, r[v]] for v in voters)
            zero = (1 - prior) * math.prod(table[v, 0, r[v]] for v in voters)
            p.append(one / (one + zero))
    return p


def test_label_model_equals_plain_em():
    rng = np.random.default_rng(3)
    truth = rng.random(400) < 0.3
    right, speaks = np.array([0.9, 0.8, 0.7, 0.85]), np.array([0.9, 0.6, 0.8, 0.3])
    votes = np.where(rng.random((400, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random((400, 4)) > speaks] = -1
    patterns, place, weight = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = label_model.fit(patterns, weight.astype(float), 0.4, rounds=40)
    want = plain_em([tuple(r) for r in votes], 0.4, 40, 0.5)
    assert model.posterior(patterns)[place.ravel()] == pytest.approx(want, abs=1e-3)
    assert np.abs(model.accuracy - right).max() < 0.12


def test_posterior_of_paired_voters_by_enumeration():
    """With a joint table for two voters the posteriors still follow from Bayes' rule over all outcomes."""
    rng = np.random.default_rng(4)
    truth = rng.random(900) < 0.4
    first = np.where(rng.random(900) < 0.7, truth, ~truth).astype(int)
    votes = np.stack([first, np.where(rng.random(900) < 0.9, first, 1 - first), *(np.where(rng.random(900) < 0.9, truth, ~truth).astype(int) for _ in range(3))], axis=1)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    model = label_model.fit(patterns, weight.astype(float), 0.4, pair_voters=True)
    assert (0, 1) in model.cliques
    every = np.array(list(itertools.product((-1, 0, 1), repeat=5)))
    total = 0.0
    for y in (0, 1):
        likelihood = np.ones(len(every))
        for clique, table in zip(model.cliques, model.tables, strict=True):
            likelihood *= [table[y][sum((int(v) + 1) * 3 ** (len(clique) - 1 - i) for i, v in enumerate(row[list(clique)]))] for row in every]
        assert likelihood.sum() == pytest.approx(1)
        joint = likelihood * (model.prior if y else 1 - model.prior)
        one = joint if y else None
        total = total + joint
    assert model.posterior(every) == pytest.approx(one / total)


def test_dual_coordinate_descent_finds_the_optimum():
    """The same objective by projected gradient ascent on a dense dual."""
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(40, 6)), rng.uniform(0.2, 2, size=40)
    x[rng.random(x.shape) < 0.4] = 0
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=40) > 0, 1.0, -1.0)
    z = np.c_[x, np.ones(40)] * y[:, None]
    gram = z @ z.T
    alpha = np.zeros(40)
    for _ in range(30_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, c)
    want = z.T @ alpha

    def loss(w):
        return w @ w / 2 + c @ np.maximum(0, 1 - z @ w)

    rows = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x]
    w, bias = dual_coordinate_descent(rows, y, 6, c=c, rounds=500)
    assert loss(np.r_[w, bias]) == pytest.approx(loss(want), rel=1e-3)
    assert np.r_[w, bias] == pytest.approx(want, abs=0.02)
