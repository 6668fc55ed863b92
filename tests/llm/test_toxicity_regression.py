"""The regression of the toxicity score reaches the least loss, also where some labels are wrong."""

import numpy as np

from sparkloom.llm import toxicity


def rows(wrong_toxic: float, wrong_clean: float, n: int = 3000):
    """Features of half toxic rows (plain hits) and half clean ones (none), and labels of which some are wrong."""
    rng = np.random.default_rng(8)
    toxic = np.arange(n) % 2 == 0
    x = np.zeros((n, toxicity.N_FEATURES))
    hits = rng.integers(1, 12, n)
    x[:, 0], x[:, 1], x[:, 4], x[:, 5] = toxic, np.log1p(hits) * toxic, 6.0 * toxic, np.minimum(hits, 5) * toxic
    x[:, 6] = 1.0
    wrong = rng.random(n) < np.where(toxic, wrong_toxic, wrong_clean)
    return x, (toxic ^ wrong).astype(float), toxic


def test_wrong_labels_do_not_lead_the_steps_away():
    for wrong_toxic, wrong_clean in ((0, 0), (0.02, 0.3), (0.05, 0.4), (0.15, 0.02), (0.1, 0.1)):
        x, y, toxic = rows(wrong_toxic, wrong_clean)
        w = toxicity._logistic(x, y)
        z = x @ w
        grad = x.T @ (1 / (1 + np.exp(-z)) - y) + 3.0 * (w - toxicity.PRIOR)
        assert np.abs(grad).max() < 1e-3, (wrong_toxic, wrong_clean, w)
        assert ((z >= 0) == toxic).all(), (wrong_toxic, wrong_clean, w)
