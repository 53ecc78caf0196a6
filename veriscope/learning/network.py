"""A dense network fitted by rounds of gradients: GELU, batch normalisation, dropout, Adam.

Rows lie in batches of fixed size.  A round sends the weights to the batches of one step;
every batch returns the sums of its gradients and the moments of its layers, normalised by
itself.  The driver holds weights and their moments only, whose size the layers fix.  Up to
``MOST_STEPS`` batches, a step is one batch; beyond, a step takes several at once, so that an
epoch never has more rounds.  Training goes on from epoch to epoch until the loss of rows held
out has not improved for some epochs; the best weights are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriscope.shared import settle

HIDDEN, EPOCHS, BATCH, PATIENCE = (256, 128), 50, 512, 5
DROPOUT, RATE = 0.2, 0.001
MOST_STEPS = 64
MOMENTUM, EPSILON = 0.99, 1e-3  # of batch normalisation
BETAS, TINY = (0.9, 0.999), 1e-7  # of Adam


def erf(x: np.ndarray) -> np.ndarray:
    """By a rational approximation, right to 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - series * np.exp(-x * x))


def gelu(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value and its derivative."""
    below = 0.5 * (1 + erf(x / np.sqrt(2)))
    return x * below, below + x * np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


@dataclass
class Weights:
    """What is fitted, by name, and the running moments of each normalised layer."""

    fitted: dict[str, np.ndarray]
    moments: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fresh(cls, inputs: int, hidden: Sequence[int], seed: int) -> Weights:
        draw, fitted, sizes = np.random.default_rng(seed), {}, [inputs, *hidden, 1]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            limit = np.sqrt(6 / (a + b))
            fitted |= {f"w{i}": draw.uniform(-limit, limit, (a, b)), f"b{i}": np.zeros(b)}
            if i < len(hidden):
                fitted |= {f"scale{i}": np.ones(b), f"shift{i}": np.zeros(b)}
        return cls(fitted, [(np.zeros(h), np.ones(h)) for h in hidden])

    @property
    def depth(self) -> int:
        return len(self.moments)


def probabilities(weights: Weights, x: np.ndarray) -> np.ndarray:
    """Of class one, with the running moments."""
    p = weights.fitted
    for i, (mean, variance) in enumerate(weights.moments):
        x = gelu(x @ p[f"w{i}"] + p[f"b{i}"])[0]
        x = (x - mean) / np.sqrt(variance + EPSILON) * p[f"scale{i}"] + p[f"shift{i}"]
    return 1 / (1 + np.exp(-np.clip(x @ p[f"w{weights.depth}"] + p[f"b{weights.depth}"], -50, 50)))[:, 0]


def gradients(weights: Weights, x: np.ndarray, y: np.ndarray, dropout: float, draw: np.random.Generator):
    """Sums over the rows: of the loss, of its derivatives by name; and each layer's moments."""
    p, kept, moments = weights.fitted, [], []
    for i in range(weights.depth):
        value, slope = gelu(x @ p[f"w{i}"] + p[f"b{i}"])
        mean, variance = value.mean(axis=0), value.var(axis=0)
        normal = (value - mean) / np.sqrt(variance + EPSILON)
        mask = (draw.random(value.shape) >= dropout) / (1 - dropout)
        kept.append((x, slope, normal, variance, mask))
        moments.append((mean, variance))
        x = (normal * p[f"scale{i}"] + p[f"shift{i}"]) * mask
    last = weights.depth
    out = np.clip((x @ p[f"w{last}"] + p[f"b{last}"])[:, 0], -50, 50)
    loss = float((np.logaddexp(0, out) - y * out).sum())
    back = (1 / (1 + np.exp(-out)) - y)[:, None]
    found = {f"w{last}": x.T @ back, f"b{last}": back.sum(axis=0)}
    back = back @ p[f"w{last}"].T
    for i in reversed(range(last)):
        x, slope, normal, variance, mask = kept[i]
        back = back * mask
        found |= {f"scale{i}": (back * normal).sum(axis=0), f"shift{i}": back.sum(axis=0)}
        back = back * p[f"scale{i}"]
        back = (back - back.mean(axis=0) - normal * (back * normal).mean(axis=0)) / np.sqrt(variance + EPSILON) * slope
        found |= {f"w{i}": x.T @ back, f"b{i}": back.sum(axis=0)}
        back = back @ p[f"w{i}"].T
    return loss, found, moments


@dataclass
class Adam:
    rate: float = RATE
    steps: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, fitted: dict[str, np.ndarray], gradient: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.steps += 1
        moved = {}
        for name, g in gradient.items():
            self.first[name] = BETAS[0] * self.first.get(name, 0) + (1 - BETAS[0]) * g
            self.second[name] = BETAS[1] * self.second.get(name, 0) + (1 - BETAS[1]) * g * g
            mean = self.first[name] / (1 - BETAS[0] ** self.steps)
            spread = self.second[name] / (1 - BETAS[1] ** self.steps)
            moved[name] = fitted[name] - self.rate * mean / (np.sqrt(spread) + TINY)
        return moved


def batches(vectors: DataFrame, size: int = BATCH) -> DataFrame:
    """Settled batches (``batch``, ``x``, ``y``) of vectors (id, features, target), dealt by hash."""
    n = max(1, -(-vectors.count() // size))
    rows = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("batch"), F.struct(
        "id", F.col("target").cast("double").alias("y"), vector_to_array("features").alias("x")).alias("row"))
    whole = rows.groupBy("batch").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return settle(whole.select("batch", F.col("rows.y").alias("y"), F.flatten("rows.x").alias("x")))


def _arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    y = batch.column("y")[i].values.to_numpy()
    return batch.column("x")[i].values.to_numpy().reshape(len(y), -1), y


def gradient_round(chosen: DataFrame, weights: Weights, dropout: float, seed: int) -> tuple[int, float, dict, list]:
    """Rows, mean loss, mean gradient and moments of the chosen batches together."""
    def summed(rows):
        for row in rows:
            for i in range(row.num_rows):
                x, y = _arrays(row, i)
                draw = np.random.default_rng((seed, row.column("batch")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [row.column("batch").slice(i, 1), pa.array([len(y)]), pa.array([pickle.dumps(gradients(weights, x, y, dropout, draw))])],
                    names=["batch", "n", "sums"])

    # one row for each batch of the step, added up in the order of batches
    parts = sorted(chosen.mapInArrow(summed, "batch int, n long, sums binary").toArrow().to_pylist(), key=lambda r: r["batch"])
    n, loss, total, moments = 0, 0.0, {}, []
    for part in parts:
        own_loss, found, own = pickle.loads(part["sums"])
        n, loss = n + part["n"], loss + own_loss
        total = {k: total.get(k, 0) + g for k, g in found.items()}
        moments.append((part["n"], own))
    mean_moments = [tuple(sum(k * m[i][j] for k, m in moments) / n for j in (0, 1)) for i in range(weights.depth)]
    return n, loss / n, {k: g / n for k, g in total.items()}, mean_moments


def evaluated(held: DataFrame, weights: Weights) -> tuple[float, float]:
    """Mean loss and accuracy of batches."""
    def summed(rows):
        for row in rows:
            for i in range(row.num_rows):
                x, y = _arrays(row, i)
                p = np.clip(probabilities(weights, x), 1e-15, 1 - 1e-15)
                loss = -np.where(y == 1, np.log(p), np.log(1 - p)).sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(y)]), pa.array([float(loss)]), pa.array([int(((p > 0.5) == (y == 1)).sum())])], names=["n", "loss", "right"])

    n, loss, right = held.mapInArrow(summed, "n long, loss double, right long").agg(F.sum("n"), F.sum("loss"), F.sum("right")).first()
    return (loss / n, right / n) if n else (float("nan"), float("nan"))


def fit_network(train: DataFrame, held: DataFrame, hidden: Sequence[int] = HIDDEN, epochs: int = EPOCHS, batch: int = BATCH,
                patience: int = PATIENCE, dropout: float = DROPOUT, seed: int = 42) -> tuple[Weights, DataFrame]:
    """The best weights, and the history (epochs, loss, val_loss, val_accuracy).

    ``train`` and ``held`` are vectors (id, features, target).
    """
    inputs = train.select(F.size(vector_to_array("features"))).first()[0]
    parts, check_on = batches(train, batch), batches(held, batch)
    numbers = sorted(r["batch"] for r in parts.select("batch").collect())  # a number per batch
    at_once = -(-len(numbers) // MOST_STEPS)
    weights, adam, draw = Weights.fresh(inputs, hidden, seed), Adam(), np.random.default_rng(seed)
    best, best_loss, waited, rows = weights, float("inf"), 0, []
    for epoch in range(1, epochs + 1):
        order, losses = draw.permutation(numbers).tolist(), []
        for at in range(0, len(order), at_once):
            chosen = parts.where(F.col("batch").isin(order[at:at + at_once]))
            n, loss, gradient, moments = gradient_round(chosen, weights, dropout, seed + 1_000_003 * epoch)
            losses.append((n, loss))
            running = [tuple(MOMENTUM * old + (1 - MOMENTUM) * new for old, new in zip(*pair)) for pair in zip(weights.moments, moments)]
            weights = Weights(adam.step(weights.fitted, gradient), running)
        val_loss, right = evaluated(check_on, weights)
        rows.append((epoch, sum(n * x for n, x in losses) / sum(n for n, _ in losses), float(val_loss), float(right)))
        if val_loss < best_loss:
            best, best_loss, waited = weights, val_loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best, train.sparkSession.createDataFrame(rows, "epochs int, loss double, val_loss double, val_accuracy double")


def network_scores(vectors: DataFrame, weights: Weights, *carry: str) -> DataFrame:
    """``carry`` and ``p``, the probability of class one, of vectors with ``features``."""
    rows = vectors.select(F.struct(*carry).alias("given"), vector_to_array("features").alias("x"))
    shared = vectors.sparkSession.sparkContext.broadcast(weights)

    def scored(found):
        for batch in found:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column("given"), pa.array(probabilities(shared.value, x))], names=["given", "p"])

    return rows.mapInArrow(scored, f"given {rows.schema['given'].dataType.simpleString()}, p double").select("given.*", "p")
