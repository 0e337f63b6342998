"""Perceptrons with class weights, weight decay and early stopping, trained by Spark.

`pyspark.ml` has none of the three.  Rows are tagged with the model they train.  A step
is one pass over the rows: every partition sums the gradient and the loss of each model,
the driver adds the sums (one row per partition and model) and moves all models at once.
A model stops when its loss on held-out rows has not improved for some steps; its best
state is kept.  A lost executor only repeats the sums of its partitions.  `fit_sample`
takes the same steps inside one task, for samples that are bounded anyway.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Layers = list[tuple[np.ndarray, np.ndarray]]


def shapes(width: int, hidden: tuple[int, ...]) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def unpack(flat: np.ndarray, width: int, hidden: tuple[int, ...]) -> Layers:
    layers, at = [], 0
    for a, b in shapes(width, hidden):
        layers.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return layers


def start(width: int, hidden: tuple[int, ...], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in shapes(width, hidden):
        parts += [rng.normal(0, np.sqrt(2.0 / (a + b)), a * b), np.zeros(b)]
    return np.concatenate(parts)


def loss_and_gradient(layers: Layers, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weighted sums of the log loss and its gradient."""
    inputs = [x]
    for i, (w, b) in enumerate(layers):
        out = inputs[-1] @ w + b
        inputs.append(np.tanh(out) if i + 1 < len(layers) else out)
    margin = inputs.pop()[:, 0]
    loss = float((weight * (np.logaddexp(0, margin) - label * margin)).sum())
    back = (weight * (1.0 / (1.0 + np.exp(-margin)) - label))[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(inputs[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ layers[i][0].T) * (1 - inputs[i] ** 2)
    return loss, np.concatenate(parts)


def sums_of(flat: np.ndarray, width: int, hidden: tuple[int, ...], x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Weight, loss, weight and loss of the held-out rows, then the gradient of the others."""
    layers = unpack(flat, width, hidden)
    loss, slope = loss_and_gradient(layers, x[~held], y[~held], w[~held])
    lost, _ = loss_and_gradient(layers, x[held], y[held], w[held])
    return np.concatenate([[w[~held].sum(), loss, w[held].sum(), lost], slope])


class Descent:
    """One model on its way: full steps of Adam on the mean weighted loss plus
    `decay` / 2 |weights|^2, with the best state so far.

    A model whose held-out loss has not fallen by `least` for `patience` steps stops; where
    no row is held out the training loss decides.
    """

    def __init__(self, width: int, hidden: tuple[int, ...], decay: float, rate: float, patience: int, least: float, seed: int):
        self.width, self.hidden = width, hidden
        self.decay, self.rate, self.patience, self.least = decay, rate, patience, least
        self.now = start(width, hidden, seed)
        self.first, self.second = np.zeros_like(self.now), np.zeros_like(self.now)
        self.best, self.taken = (np.inf, self.now, 0), 0

    def move(self, k: int, sums: np.ndarray) -> bool:
        """Step `k` by the sums over all rows; false if the model stops instead."""
        weight, loss, held_weight, held_loss = sums[:4]
        measured = held_loss / held_weight if held_weight > 0 else loss / weight
        if measured < self.best[0] - self.least:
            self.best = (measured, self.now, k)
        elif k - self.best[2] >= self.patience:
            return False
        slope = sums[4:] / weight + self.decay * self.now
        self.first = 0.9 * self.first + 0.1 * slope
        self.second = 0.999 * self.second + 0.001 * slope**2
        step = (self.first / (1 - 0.9**k)) / (np.sqrt(self.second / (1 - 0.999**k)) + 1e-8)
        self.now = self.now - self.rate * step
        self.taken = k
        return True

    def layers(self) -> Layers:
        return unpack(self.best[1], self.width, self.hidden)


def fit_sample(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, hidden: tuple[int, ...] = (16,), decay: float = 1e-3,
    rate: float = 0.05, steps: int = 60, patience: int = 8, least: float = 1e-4, seed: int = 7,
) -> tuple[Layers, int]:
    """`fit` of one bounded sample inside a task, with the same steps: layers and steps taken."""
    model = Descent(x.shape[1], hidden, decay, rate, patience, least, seed)
    for k in range(1, steps + 1):
        if not model.move(k, sums_of(model.now, model.width, hidden, x, y, w, held)):
            break
    return model.layers(), model.taken


def _step(rows: DataFrame, state: Mapping[str, np.ndarray], widths: Mapping[str, int], hidden: tuple[int, ...]) -> dict:
    """Sums over all rows of each model: weight, loss and gradient of the training rows,
    weight and loss of the held-out ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("model"):
                if name not in state:
                    continue
                x = np.stack(part["x"].to_numpy()).astype(float)
                y, w, held = part["y"].to_numpy(float), part["w"].to_numpy(float), part["held"].to_numpy(bool)
                sums[name] = sums.get(name, 0.0) + sums_of(state[name], widths[name], hidden, x, y, w, held)
        if sums:
            yield pd.DataFrame({"model": list(sums), "sums": [s.tolist() for s in sums.values()]})

    total: dict[str, np.ndarray] = {}
    for row in rows.mapInPandas(run, "model string, sums array<double>").collect():
        total[row["model"]] = total.get(row["model"], 0.0) + np.array(row["sums"])
    return total


def fit(
    rows: DataFrame, widths: Mapping[str, int], hidden: tuple[int, ...] = (16,), decay: float = 1e-3,
    rate: float = 0.05, steps: int = 60, patience: int = 8, least: float = 1e-4, seed: int = 7,
) -> dict[str, tuple[Layers, int]]:
    """rows: model, x (array), y, w (class weight), held; `widths`: length of x by model.

    All models of a step are moved together as `Descent` has it.  Returns layers and steps
    taken by model.
    """
    state = {m: Descent(w, hidden, decay, rate, patience, least, seed) for m, w in widths.items()}
    active = dict(state)
    for k in range(1, steps + 1):
        sums = _step(rows, {m: d.now for m, d in active.items()}, widths, hidden)
        active = {m: d for m, d in active.items() if m in sums and d.move(k, sums[m])}
        if not active:
            break
    return {m: (d.layers(), d.taken) for m, d in state.items()}
