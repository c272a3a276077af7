"""Generative model of voters that vote 0, vote 1 or abstain (-1).

The input is the count of each distinct vote pattern, which Spark aggregates over
all rows; with ``V`` voters there are at most ``3 ** V`` patterns, whatever the
corpus holds, so the model itself is fitted on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    #: voters that are modelled together; single voters are groups of one
    cliques: list[tuple[int, ...]]
    #: for each clique, P(outcome | class) as (2, 3 ** size)
    tables: list[np.ndarray]
    prior: float
    #: for each voter, P(vote is right | it votes)
    accuracy: np.ndarray
    #: correlation of each pair of voters given the class
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) for rows of votes."""
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for clique, table in zip(self.cliques, self.tables, strict=True):
            log += np.log(table[:, _code(votes, clique)]).T
        top = log.max(axis=1, keepdims=True)
        p = np.exp(log - top)
        return p[:, 1] / p.sum(axis=1)


def _code(votes: np.ndarray, clique: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(len(votes), dtype=np.int64)
    for v in clique:
        out = out * 3 + (votes[:, v] + 1)
    return out


def _tables(votes, weight, p1, cliques, smooth):
    out = []
    for clique in cliques:
        size = 3 ** len(clique)
        code = _code(votes, clique)
        t = np.stack([np.bincount(code, weight * q, minlength=size) for q in (1 - p1, p1)]) + smooth
        out.append(t / t.sum(axis=1, keepdims=True))
    return out


def fit(votes: np.ndarray, weight: np.ndarray, prior: float, *, pair_voters: bool = False, fixed_prior: bool = False, rounds: int = 100, smooth: float = 0.5) -> LabelModel:
    """Expectation-maximisation from the majority vote.

    votes: (patterns, voters) of -1, 0, 1.  weight: rows that show each pattern.
    prior: starting P(class 1).  pair_voters: after a first fit, voters that are
    most correlated given the class are put in pairs with a joint table, and the
    fit is repeated.  With no rows the prior is all that is known.
    """
    n_voters = votes.shape[1]
    for_, against = (votes == 1).sum(axis=1), (votes == 0).sum(axis=1)
    p1 = np.clip((for_ + 2 * prior) / (for_ + against + 2), 0.02, 0.98)
    cliques = [(v,) for v in range(n_voters)]

    def em(p1, cliques, prior):
        model = None
        for _ in range(rounds):
            if not fixed_prior and weight.sum() > 0:
                prior = float(np.clip((weight * p1).sum() / weight.sum(), 0.005, 0.995))
            tables = _tables(votes, weight, p1, cliques, smooth)
            model = LabelModel(cliques, tables, prior, np.zeros(n_voters), np.zeros((n_voters, n_voters)))
            new = model.posterior(votes) if len(votes) else p1
            moved = np.abs(new - p1).max() if len(votes) else 0.0
            p1 = new
            if moved < 1e-7:
                break
        return model, p1, prior

    model, p1, prior = em(p1, cliques, prior)
    model.correlation = _correlation(votes, weight, p1)
    if pair_voters:
        pairs, left = [], set(range(n_voters))
        c = np.abs(np.triu(model.correlation, 1))
        for flat in np.argsort(-c, axis=None):
            a, b = divmod(int(flat), n_voters)
            if c[a, b] < 0.1:
                break
            if a in left and b in left:
                pairs.append((a, b))
                left -= {a, b}
        correlation = model.correlation
        model, p1, prior = em(p1, pairs + [(v,) for v in sorted(left)], prior)
        model.correlation = correlation
    right = np.stack([np.where(votes[:, v] == 1, p1, 1 - p1) for v in range(n_voters)], axis=1) if len(votes) else np.zeros((0, n_voters))
    said = (votes >= 0) * weight[:, None]
    model.accuracy = (right * said).sum(axis=0) / np.maximum(said.sum(axis=0), 1e-9)
    return model


def _correlation(votes, weight, p1):
    """Correlation of votes within the classes, averaged over them."""
    n = votes.shape[1]
    out = np.zeros((n, n))
    for q in (1 - p1, p1):
        w = weight * q
        if w.sum() <= 0:
            continue
        x = votes - (votes * w[:, None]).sum(axis=0) / w.sum()
        cov = (x * w[:, None]).T @ x / w.sum()
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        out += np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0) * (w.sum() / weight.sum())
    np.fill_diagonal(out, 0)
    return out
