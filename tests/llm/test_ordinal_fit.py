"""The ordinal fit against a plain search for the best weights and thresholds, one row at a time."""

import math
import random

import numpy as np
import pytest

from fleetseal.llm import toxicity


def logistic(x):
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def objective(x, rows, n_words, penalty):
    """Mean negative log likelihood of (words, grade) rows, plus the penalty on weights; thresholds stand behind the weights."""
    cuts = [-math.inf, *x[n_words:], math.inf]
    if any(a >= b for a, b in zip(cuts, cuts[1:], strict=False)):
        return math.inf
    loss = 0.0
    for words, grade in rows:
        eta = sum(x[w] for w in words)
        upper = 1.0 if cuts[grade + 1] == math.inf else logistic(cuts[grade + 1] - eta)
        lower = 0.0 if cuts[grade] == -math.inf else logistic(cuts[grade] - eta)
        loss -= math.log(max(upper - lower, 1e-12))
    return loss / len(rows) + penalty * sum(abs(w) for w in x[:n_words])


def searched(rows, n_words, grades, penalty):
    """Coordinate by coordinate, with ever smaller steps."""
    x = [0.0] * n_words + [float(k) for k in range(grades - 1)]
    best, step = objective(x, rows, n_words, penalty), 1.0
    while step > 1e-5:
        better = False
        for i in range(len(x)):
            for move in (step, -step):
                tried = [*x]
                tried[i] += move
                if (value := objective(tried, rows, n_words, penalty)) < best - 1e-13:
                    x, best, better = tried, value, True
        step = step if better else step / 2
    return x, best


@pytest.mark.parametrize("seed, penalty", [(1, 0.02), (2, 0.005), (3, 0.2)])
def test_fit_against_a_plain_search(seed, penalty):
    rng, grades, true = random.Random(seed), 3, [1.5, -0.5, 2.5, 0.0]
    texts = []
    for _ in range(60):
        words = [w for w in range(4) if rng.random() < 0.4]
        level = sum(true[w] for w in words) + rng.gauss(0, 1)
        texts.append((words, 0 if level < 1 else 1 if level < 2.5 else 2))
    rows = texts + [([], g) for g in range(grades)]  # the pseudo-row of each grade
    expected, least = searched(rows, 4, grades, penalty)
    cells = [(i, w) for i, (words, _) in enumerate(texts) for w in words]
    weights, cuts = toxicity.fit_arrays(np.array([i for i, _ in cells]), np.array([w for _, w in cells]), 4, np.array([g for _, g in texts]), grades, penalty, rounds=4000)
    got = [*weights.tolist(), *cuts.tolist()]
    assert objective(got, rows, 4, penalty) <= least + 1e-5
    assert np.allclose(got, expected, atol=0.02)
    assert [w == 0 for w in got[:4]] == [abs(w) < 1e-4 for w in expected[:4]]
    # Expected severity of every combination of words, from its definition.
    for words in ([], [0], [1, 2], [0, 1, 2, 3]):
        mean = lambda x: sum(1 - logistic(c - sum(x[w] for w in words)) for c in x[4:])
        assert abs(mean(got) - mean(expected)) < 0.02
