"""The fit against the likelihood written out, and the tail against plain sums."""

import numpy as np

from lexloom.llm import op6_quality as op


def objective(rows, weights, cuts):
    """Mean penalised log-likelihood of the proportional odds model."""
    total = 0.0
    for grade, found in rows:
        f = sum(weights[i] for i in found)
        above = [1.0] + [1 / (1 + np.exp(-(f - c))) for c in cuts] + [0.0]
        total += np.log(above[grade] - above[grade + 1])
    return total / len(rows) - op.DECAY / 2 * float((weights**2).sum())


def test_fit_reaches_the_maximum(monkeypatch):
    monkeypatch.setattr(op, "STRETCH", 50)
    monkeypatch.setattr(op, "STEPS", 3000)
    rng = np.random.default_rng(4)
    true = rng.normal(0, 1.5, 12)
    rows = []
    for _ in range(400):
        found = np.sort(rng.choice(12, rng.integers(1, 7), replace=False)).astype(np.int32)
        noisy = true[found].sum() + rng.logistic()
        rows.append((int(noisy > -1) + int(noisy > 1), found))
    weights, cuts = op.fit(rows)
    assert cuts[0] < cuts[1] and not weights[12:].any()
    best = objective(rows, weights[:12], cuts)
    for _ in range(200):  # no step in any direction is better
        step = rng.normal(0, 1, 14)
        step *= rng.choice([1e-3, 1e-2, 0.1]) / np.linalg.norm(step)
        assert objective(rows, weights[:12] + step[:12], cuts + step[12:]) <= best + 2e-6
    assert np.corrcoef(weights[:12], true)[0, 1] > 0.9


def test_order_of_rows_and_rare_features(monkeypatch):
    rows = [(k % 3, np.array([k % 5, 10 + k], np.int32)) for k in range(60)]
    weights, _ = op.fit(rows)
    assert not weights[10:].any() and weights[:5].any()  # features of one row have weight 0
    assert op.fit([])[0].sum() == 0 and np.isfinite(op.fit(rows[:1])[1]).all()


def test_tails_are_sigmoids_of_sums():
    texts = ["Some words AND more!!", "", "x " * 500]
    rng = np.random.default_rng(1)
    weights, cuts = rng.normal(0, 0.1, op.BUCKETS), np.array([-0.5, 0.7])
    got = op.tails(texts, weights, cuts)
    for text, row in zip(texts, got):
        column, counts = op.features([text])
        assert len(set(column.tolist())) == counts[0] == len(column)
        f = sum(weights[i] for i in column)
        assert np.allclose(row, [1 / (1 + np.exp(-(f - c))) for c in cuts])
    assert (got[:, 0] >= got[:, 1]).all()
