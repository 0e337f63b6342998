"""Small learners for bounded samples, fitted inside a task.

A model is a JSON text: how the sample was encoded and what was learned from it.
Numbers are standardised and categories one-hot encoded as the sample has them; unseen
categories are all zero.  Classes weigh n / (2 n_c).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd

# Fixed values of the boosted trees.
RATE, LEAF_PENALTY, BINS, PATIENCE = 0.08, 0.05, 32, 10
#: Rows that a stack scores at a time, so that what they need stays in the cache of a core.
ROWS = 128


def encoder(frame: pd.DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> dict:
    numbers = frame[list(numeric)].to_numpy(float)
    scale = numbers.std(axis=0)
    return {
        "numeric": list(numeric), "categorical": list(categorical), "mean": numbers.mean(axis=0).tolist(),
        "scale": np.where(scale > 0, scale, 1.0).tolist(),
        "levels": [sorted(frame[c].unique().tolist()) for c in categorical],
    }


def encode(how: dict, frame: pd.DataFrame) -> np.ndarray:
    parts = [(frame[how["numeric"]].to_numpy(float) - how["mean"]) / how["scale"]]
    for c, levels in zip(how["categorical"], how["levels"]):
        parts.append((frame[c].to_numpy()[:, None] == np.array(levels, object)[None, :]).astype(float))
    return np.concatenate(parts, axis=1)


def names(how: dict) -> list[str]:
    return [*how["numeric"], *(f"{c}={v}" for c, levels in zip(how["categorical"], how["levels"]) for v in levels)]


def balanced_weights(label: np.ndarray) -> np.ndarray:
    positive = label.sum()
    if positive in (0, len(label)):
        raise ValueError("training data has one class")
    return np.where(label == 1, len(label) / (2.0 * positive), len(label) / (2.0 * (len(label) - positive)))


def logistic(x: np.ndarray, label: np.ndarray, weight: np.ndarray, c: float, steps: int = 50) -> np.ndarray:
    """Coefficients and, last, the constant: Newton steps on c * loss + |b|^2 / 2, with
    halved steps where a whole one would not improve."""
    x = np.c_[x, np.ones(len(x))]
    sign = 2.0 * label - 1.0
    loss = lambda b: c * (weight * np.logaddexp(0, -sign * (x @ b))).sum() + 0.5 * b @ b
    b = np.zeros(x.shape[1])
    now = loss(b)
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-(x @ b)))
        slope = c * x.T @ (weight * (p - label)) + b
        bend = c * (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(b))
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while loss(b - size * step) > now and size > 1e-6:
            size /= 2
        b = b - size * step
        before, now = now, loss(b)
        if before - now <= 1e-10 * (1 + abs(now)):
            break
    return b


def _tree(bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, leaves: int, least: int = 5) -> list[list[float]]:
    """A tree grown leaf by leaf where the gain is greatest; nodes are
    [feature, last bin on the left, left, right, value], feature -1 in leaves."""
    width = bins.shape[1]
    offset = np.arange(width) * BINS

    def best(rows: np.ndarray) -> tuple[float, int, int]:
        at = (bins[rows] + offset).ravel()
        sums = [
            np.bincount(at, np.repeat(v[rows], width) if v is not None else None, width * BINS).reshape(width, BINS).cumsum(axis=1)
            for v in (slope, bend, None)
        ]
        g, h, n = sums
        whole = (g[:, -1:], h[:, -1:], n[:, -1:])
        gain = g**2 / (h + LEAF_PENALTY) + (whole[0] - g) ** 2 / (whole[1] - h + LEAF_PENALTY) - whole[0] ** 2 / (whole[1] + LEAF_PENALTY)
        gain = np.where((n >= least) & (whole[2] - n >= least), gain, -np.inf)
        k = int(gain.argmax())
        return float(gain.flat[k]), k // BINS, k % BINS

    value = lambda rows: float(-slope[rows].sum() / (bend[rows].sum() + LEAF_PENALTY))
    everything = np.arange(len(bins))
    nodes, open_ = [[-1, 0, 0, 0, value(everything)]], [(best(everything), 0, everything)]
    while len(open_) < leaves:
        (gain, feature, cut), node, rows = max(open_, key=lambda o: o[0][0])
        if not gain > 1e-9:
            break
        open_ = [o for o in open_ if o[1] != node]
        left = bins[rows, feature] <= cut
        nodes[node][:4] = [feature, cut, len(nodes), len(nodes) + 1]
        for part in (rows[left], rows[~left]):
            open_.append((best(part), len(nodes), part))
            nodes.append([-1, 0, 0, 0, value(part)])
    return nodes


def _fall(nodes: list[list[float]], bins: np.ndarray) -> np.ndarray:
    table = np.array(nodes, float)
    at = np.zeros(len(bins), int)
    while True:
        inner = np.nonzero(table[at, 0] >= 0)[0]
        if not len(inner):
            return table[at, 4]
        node = table[at[inner]]
        left = bins[inner, node[:, 0].astype(int)] <= node[:, 1]
        at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)


def boosted(x: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int, rounds: int = 60, leaves: int = 8) -> dict:
    """Boosted trees on binned features, stopped on a held-out tenth."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])).tolist() for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    held = np.random.default_rng(seed).permutation(len(x)) < max(1, len(x) // 10)
    start = float(np.log(weight[label == 1].sum() / weight[label == 0].sum()))
    margin, trees, best, best_at = np.full(len(x), start), [], np.inf, 0
    for k in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, bend = weight * (p - label), weight * p * (1 - p)
        nodes = _tree(bins[~held], slope[~held], bend[~held], leaves)
        for node in nodes:
            node[4] *= RATE
        trees.append(nodes)
        margin = margin + _fall(nodes, bins)
        lost = (weight * np.logaddexp(0, np.where(label == 1, -margin, margin)))[held].sum() / weight[held].sum()
        if lost < best - 1e-7:
            best, best_at = lost, k + 1
        elif k + 1 - best_at >= PATIENCE:
            break
    return {"start": start, "edges": edges, "trees": trees[: max(best_at, 1)]}


def perceptron_margin(layers: list, x: np.ndarray) -> np.ndarray:
    """Margins of a network whose layers are (weights, constants), tanh between them."""
    for i, (w, b) in enumerate(layers):
        x = x @ np.asarray(w) + np.asarray(b)
        if i + 1 < len(layers):
            x = np.tanh(x)
    return x[:, 0]


def fit(frame: pd.DataFrame, label: str, numeric, categorical, learner: str, c: float, seed: int) -> str:
    how = encoder(frame, numeric, categorical)
    x, y = encode(how, frame), frame[label].to_numpy(float)
    weight = balanced_weights(y)
    if learner in ("logistic", "selective_logistic"):
        learned = {"coefficients": logistic(x, y, weight, c).tolist()}
    elif learner == "boosting":
        learned = boosted(x, y, weight, seed)
    else:
        raise KeyError(f"unknown learner: {learner}")
    return json.dumps({"how": how, **learned})


def probability(model: dict, frame: pd.DataFrame) -> np.ndarray:
    x = encode(model["how"], frame)
    if "coefficients" in model:
        b = np.array(model["coefficients"])
        margin = x @ b[:-1] + b[-1]
    elif "trees" in model:
        bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(model["edges"])], axis=1)
        margin = np.full(len(x), model["start"])
        for nodes in model["trees"]:
            margin += _fall(nodes, bins)
    else:
        margin = perceptron_margin(model["layers"], x)
    return 1.0 / (1.0 + np.exp(-margin))


def _first_beyond(edges: np.ndarray, mean: float, scale: float) -> np.ndarray:
    """For each edge the smallest number x with (x - mean) / scale beyond it, as computed in
    doubles: rounding keeps the order, so halving the range of doubles finds it exactly."""
    # Doubles in order as whole numbers: bits of the negative ones count down from -1.
    double = lambda n: np.where(n < 0, -1 - n | np.int64(-(1 << 63)), n).view(float)
    most = int(np.array([np.inf]).view(np.int64)[0])
    low, high = np.full(len(edges), -most - 2, np.int64), np.full(len(edges), most, np.int64)
    for _ in range(64):
        middle = (low >> 1) + (high >> 1) + (low & high & 1)
        beyond = (double(middle) - mean) / scale > edges
        low, high = np.where(beyond, low, middle), np.where(beyond, middle, high)
    return double(high)


class Stack:
    """Many models over the same columns: probabilities of a batch, a column per model.

    Each number is made by the same additions whatever rows share its batch, so a score
    may be computed again and compared with a threshold found earlier.  `hidden` names the
    columns that a model sees as `blank` (columns of text or numbers).
    """

    def __init__(self, parsed: Sequence[tuple[dict, Sequence[str]]], numeric, categorical, blank_text="masked", blank_number=0.0):
        self.numeric, self.categorical, self.width = list(numeric), list(categorical), len(parsed)
        self.blank_text, self.blank_number = blank_text, blank_number
        levels: dict[str, set] = {c: {blank_text} for c in self.categorical}
        for model, _ in parsed:
            for c, seen in zip(model["how"]["categorical"], model["how"]["levels"]):
                levels[c].update(seen)
        self.levels = {c: sorted(v) for c, v in levels.items()}
        self.linear, self.boosted, self.deep = [], [], []
        for i, (model, hidden) in enumerate(parsed):
            kind = self.linear if "coefficients" in model else self.boosted if "trees" in model else self.deep
            kind.append((i, model, set(hidden)))
        self.lines = self._folded([(m["how"], np.array(m["coefficients"])[:, None], h) for _, m, h in self.linear])
        self.firsts = self._folded([
            (m["how"], np.vstack([np.array(m["layers"][0][0]), np.array(m["layers"][0][1])[None, :]]), h) for _, m, h in self.deep
        ])
        self.forests = [(i, model, hidden, self._masks(model, hidden)) for i, model, hidden in self.boosted]
        self.joined = self._joined() if self.forests else None

    def _folded(self, parts):
        """Weights of numbers, a row of weights for each level (last: unseen) and constants."""
        numbers, tables, constants = [], [], []
        for how, weights, hidden in parts:
            scale = np.array(how["scale"])[:, None]
            slope = weights[: len(how["numeric"])] / scale
            constant = weights[-1] - (slope * np.array(how["mean"])[:, None]).sum(axis=0)
            by_name = {c: slope[j] for j, c in enumerate(how["numeric"])}
            own, at = [], len(how["numeric"])
            for c, seen in zip(how["categorical"], how["levels"]):
                table = np.zeros((len(self.levels[c]) + 1, weights.shape[1]))
                table[[self.levels[c].index(v) for v in seen]] = weights[at : at + len(seen)]
                at += len(seen)
                if c in hidden:
                    constant = constant + table[self.levels[c].index(self.blank_text)]
                    table = np.zeros_like(table)
                own.append(table)
            for c in hidden & set(by_name):
                constant = constant + by_name[c] * self.blank_number
                by_name[c] = np.zeros_like(by_name[c])
            numbers.append(np.stack([by_name[c] for c in self.numeric]))
            tables.append(own)
            constants.append(constant)
        if not parts:
            return None
        joined = [np.ascontiguousarray(np.hstack([t[k] for t in tables])) for k in range(len(self.categorical))]
        return np.ascontiguousarray(np.hstack(numbers)), joined, np.concatenate(constants)

    @staticmethod
    def _lines(folded, numbers: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        slopes, tables, constants = folded
        out = np.tile(constants, (len(numbers), 1))
        part = np.empty_like(out)
        for j, slope in enumerate(slopes):
            out += np.multiply(numbers[:, j : j + 1], slope, out=part)
        for table, code in zip(tables, codes):
            out += table[code]
        return out

    def _masks(self, model: dict, hidden: set):
        """For every bin of a number and every level a byte per tree: the leaves still
        possible; and the value of the first leaf left, for every byte."""
        how, trees = model["how"], model["trees"]
        width = len(how["numeric"])
        numbers = np.full((width, BINS, len(trees)), 255, np.uint8)
        spans, at = [], width
        for seen in how["levels"]:
            spans.append((at, at + len(seen)))
            at += len(seen)
        texts = [np.full((len(self.levels[c]) + 1, len(trees)), 255, np.uint8) for c in how["categorical"]]
        values = np.zeros((len(trees), 256))
        for t, nodes in enumerate(trees):
            leaves: list[float] = []

            def walk(k: int) -> int:
                feature, cut, left, right, value = nodes[k]
                if feature < 0:
                    leaves.append(value)
                    return 1 << (len(leaves) - 1)
                below = walk(int(left))
                above = walk(int(right))
                keep = np.uint8(255 & ~below)
                if feature < width:
                    numbers[int(feature), int(cut) + 1 :, t] &= keep
                else:
                    c = next(n for n, (a, b) in enumerate(spans) if a <= feature < b)
                    edges = model["edges"][int(feature)]
                    name = how["levels"][c][int(feature) - spans[c][0]]
                    for k2, level in enumerate([*self.levels[how["categorical"][c]], None]):
                        if np.searchsorted(edges, 1.0 if level == name else 0.0) > cut:
                            texts[c][k2, t] &= keep
                return below | above

            walk(0)
            if len(leaves) > 8:
                raise ValueError("a tree has more than eight leaves")
            for mask in range(1, 256):
                first = (mask & -mask).bit_length() - 1
                values[t, mask] = leaves[first] if first < len(leaves) else 0.0
        for c, name in enumerate(how["categorical"]):
            if name in hidden:
                texts[c][:] = texts[c][self.levels[name].index(self.blank_text)]
        return numbers, texts, values.ravel(), np.arange(len(trees)) * 256

    def _joined(self):
        """The masks of all trees side by side: for every number the places where a mask may
        change and a row of masks after each, for every text a row of masks a level."""
        numbers = []
        for j, c in enumerate(self.numeric):
            own = []
            for _, model, hidden, (masks, _, _, _) in self.forests:
                edges, at = model["edges"][j], masks[j]
                mean, scale = model["how"]["mean"][j], model["how"]["scale"][j]
                if c in hidden:
                    own.append((np.empty(0), at[[np.searchsorted(edges, (self.blank_number - mean) / scale)]]))
                else:
                    own.append((_first_beyond(np.array(edges, float), mean, scale), at))
            places = np.unique(np.concatenate([p for p, _ in own]))
            # Numbers from places[i - 1] on, below places[i], share row i.
            rows = [at[np.r_[0, np.searchsorted(p, places, side="right")]] for p, at in own]
            numbers.append((places, np.ascontiguousarray(np.hstack(rows))))
        texts = [
            np.ascontiguousarray(np.hstack([f[3][1][k] for f in self.forests])) for k in range(len(self.categorical))
        ]
        return numbers, texts

    def _leaves(self, numbers: np.ndarray, codes: list[np.ndarray]) -> np.ndarray:
        """For every row and tree the leaves still possible, as a byte."""
        by_number, by_level = self.joined
        left = None
        for j, (places, masks) in enumerate(by_number):
            part = masks[np.searchsorted(places, numbers[:, j], side="right")]
            left = part if left is None else np.bitwise_and(left, part, out=left)
        for table, code in zip(by_level, codes):
            left = table[code] if left is None else np.bitwise_and(left, table[code], out=left)
        return left

    def scores(self, frame: pd.DataFrame) -> np.ndarray:
        numbers = frame[self.numeric].to_numpy(float)
        codes = []
        for c in self.categorical:
            code = pd.Categorical(frame[c], categories=self.levels[c]).codes.astype(np.intp)
            codes.append(np.where(code < 0, len(self.levels[c]), code))
        margin = np.empty((len(numbers), self.width))
        for lo in range(0, len(numbers), ROWS):
            part = slice(lo, lo + ROWS)
            x, code = numbers[part], [c[part] for c in codes]
            if self.linear:
                margin[part, [i for i, _, _ in self.linear]] = self._lines(self.lines, x, code)
            if self.deep:
                first, at = self._lines(self.firsts, x, code), 0
                for i, model, _ in self.deep:
                    size = len(model["layers"][0][1])
                    out = first[:, at : at + size].copy()
                    at += size
                    for w, b in model["layers"][1:]:
                        out = (np.tanh(out)[:, :, None] * np.array(w)[None]).sum(axis=1) + np.array(b)
                    margin[part, i] = out[:, 0]
            if self.forests:
                left, at = self._leaves(x, code), 0
                for i, model, _, (_, _, values, offset) in self.forests:
                    own = left[:, at : at + len(offset)] + offset
                    at += len(offset)
                    margin[part, i] = model["start"] + values[own].sum(axis=1)
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-margin))
