"""The network's gradients against differences, and its training as a whole."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from veriscope.learning import network as net


@pytest.mark.parametrize("dropout", [0.0, 0.3])
def test_gradients_equal_differences(dropout):
    draw = np.random.default_rng(0)
    weights = net.Weights.fresh(5, (4, 3), 1)
    weights.fitted = {k: v + draw.normal(0, 0.3, v.shape) for k, v in weights.fitted.items()}
    x, y = draw.normal(size=(20, 5)), draw.integers(0, 2, 20).astype(float)

    def loss(fitted):
        return net.gradients(net.Weights(fitted, weights.moments), x, y, dropout, np.random.default_rng(7))[0]

    _, found, moments = net.gradients(weights, x, y, dropout, np.random.default_rng(7))
    for name, value in weights.fitted.items():
        for at in np.ndindex(value.shape):
            step = np.zeros_like(value)
            step[at] = 1e-4
            near = [loss(weights.fitted | {name: value + s * step}) for s in (1, -1)]
            assert found[name][at] == pytest.approx((near[0] - near[1]) / 2e-4, abs=2e-2), (name, at)
    assert [m[0].shape for m in moments] == [(4,), (3,)]


def test_gelu():
    import math

    x = np.linspace(-4, 4, 81)
    value, slope = net.gelu(x)
    assert np.allclose(value, [v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in x], atol=1e-6)
    assert np.allclose(slope[1:-1], (value[2:] - value[:-2]) / (x[2:] - x[:-2]), atol=5e-3)


@pytest.fixture(scope="module")
def vectors(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(v) for v in draw.normal(size=6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    return df.select("id", array_to_vector("x").alias("features"), (F.col("x")[0] + F.col("x")[1] > 0).cast("double").alias("target"))


def test_steps_are_those_of_one_machine(vectors):
    """Rounds over batches give the weights that plain training on the same batches gives."""
    parts = net.batches(vectors, 100)
    weights, _ = net.fit_network(vectors, vectors, (8,), epochs=1, batch=100, seed=3)
    rows = {r.batch: (np.array(r.x).reshape(len(r.y), -1), np.array(r.y)) for r in parts.collect()}
    plain, adam, draw = net.Weights.fresh(6, (8,), 3), net.Adam(), np.random.default_rng(3)
    for no in draw.permutation(sorted(rows)).tolist():
        x, y = rows[no]
        _, g, moments = net.gradients(plain, x, y, net.DROPOUT, np.random.default_rng((3 + 1_000_003, no)))
        running = [tuple(0.99 * a + 0.01 * b for a, b in zip(*pair)) for pair in zip(plain.moments, moments)]
        plain = net.Weights(adam.step(plain.fitted, {k: v / len(y) for k, v in g.items()}), running)
    assert len(rows) == 3 and all(np.allclose(weights.fitted[k], plain.fitted[k]) for k in plain.fitted)
    assert all(np.allclose(a, b) for x, y in zip(weights.moments, plain.moments) for a, b in zip(x, y))


def test_batches_of_a_step_are_added(vectors, monkeypatch):
    monkeypatch.setattr(net, "MOST_STEPS", 1)
    weights, history = net.fit_network(vectors, vectors, (8,), epochs=2, batch=60)
    assert history.count() == 2 and all(np.isfinite(v).all() for v in weights.fitted.values())


def test_training_stops_and_keeps_the_best(vectors):
    weights, history = net.fit_network(vectors.where("id % 4 > 0"), vectors.where("id % 4 = 0"), (16, 8), epochs=40, batch=32, patience=3)
    rows = history.orderBy("epochs").collect()
    losses = [r.val_loss for r in rows]
    assert [r.epochs for r in rows] == list(range(1, len(rows) + 1)) and min(losses) < losses[0]
    assert len(rows) == 40 or losses.index(min(losses)) == len(rows) - 4
    loss, right = net.evaluated(net.batches(vectors.where("id % 4 = 0"), 32), weights)
    assert loss == pytest.approx(min(losses)) and right > 0.85
    scored = net.network_scores(vectors, weights, "id", "target").collect()
    assert len(scored) == 300 and np.mean([(r.p > 0.5) == (r.target == 1) for r in scored]) > 0.85
