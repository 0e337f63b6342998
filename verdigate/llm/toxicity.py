"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Input of a word are six numbers from a table of telling features: the word itself,
its beginning (three to five bytes) and the four-byte runs inside it, each with the
deviation of its document count among toxic documents from chance.  The network reads
windows of words in both directions, attention pools the states of a window, and a
document takes the score of its highest window.  Windows overlap by half and cover the
whole text.

The table and the network are fitted on a bounded sample of labelled rows, in one task.
Only which window of a document counts is hidden, so training alternates: pick the
highest window of each document, then learn its label from that window.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigate.llm.common import lower_ascii, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, STRIDE = 32, 16
HIDDEN = 8
INPUTS = 6
#: Labelled rows used for fitting, at most.
SAMPLE_ROWS = 6000
#: Telling features kept, at most, and the deviation they need.
FEATURES, LEAST_Z = 16_384, 4.0
ROUNDS, STEPS_A_ROUND, BATCH = 6, 60, 256
#: Bytes turned into inputs at a time, and words of a longer text.
BYTES_AT_ONCE, WORDS_AT_ONCE = 2_000_000, 100_000

_POSITIONS = 64
_random = np.random.default_rng(7)
_FACTORS = _random.integers(1, 2**63, (5, _POSITIONS), dtype=np.uint64) | np.uint64(1)
_SALTS = _random.integers(1, 2**63, 8, dtype=np.uint64)
#: What separates words here: every ASCII byte but letters and digits.
_SPACE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


@dataclass
class Words:
    """Words of joined texts and the hashes of their features."""

    owner: np.ndarray  # text of each word
    size: np.ndarray
    word: np.ndarray
    prefixes: list[np.ndarray]  # three, four, five bytes; 0 where the word is shorter
    grams: np.ndarray  # of each byte position where four bytes of a word begin, else 0
    starts: np.ndarray


def _mixed(values: np.ndarray, salt: int) -> np.ndarray:
    out = (values ^ (values >> np.uint64(29))) * _SALTS[salt]
    return out ^ (out >> np.uint64(32))


def read_words(texts: list[bytes]) -> Words:
    """Words of lower-cased texts, all at once."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    blank = _SPACE[flat]
    before = np.concatenate([[True], blank[:-1]])
    starts, ends = np.nonzero(~blank & before)[0], np.nonzero(blank & ~before)[0]
    size = ends - starts
    owner = np.searchsorted(ends_of_texts, starts, "right")
    none = np.zeros(0, np.uint64)
    if not len(starts):
        return Words(owner, size, none, [none] * 3, none, starts)
    letters = flat.astype(np.uint64) + np.uint64(1)
    place = np.arange(len(flat)) - np.repeat(
        np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(flat)]]))
    )
    spread = np.where(blank, np.uint64(0), letters * _FACTORS[0][place % _POSITIONS])
    word = _mixed(np.add.reduceat(spread, starts), 0)
    prefixes = []
    padded = np.concatenate([letters, np.zeros(5, np.uint64)])
    for i, n in enumerate((3, 4, 5)):
        value = sum(padded[starts + k] * _FACTORS[1 + i][k] for k in range(n))
        prefixes.append(np.where(size >= n, _mixed(value, 1 + i), np.uint64(0)))
    grams = sum(padded[k : k + len(letters)] * _FACTORS[4][k] for k in range(4))
    solid = ~blank
    inside = solid.copy()
    for k in (1, 2, 3):
        inside[: len(solid) - k] &= solid[k:]
        inside[len(solid) - k :] = False
    grams = np.where(inside, _mixed(grams, 4), np.uint64(0))
    return Words(owner, size, word, prefixes, grams, starts)


@dataclass
class Features:
    """Deviations of telling features, by hash."""

    keys: np.ndarray  # ascending
    values: np.ndarray
    maybe: np.ndarray  # which of 2^20 high parts of a hash occur at all

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Features:
        order = np.argsort(keys)
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
        return cls(keys[order], values[order].astype(np.float32), maybe)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.float32)
        if len(self.keys):
            at = np.nonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])[0]
            found = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
            out[at] = np.where(self.keys[found] == hashes[at], self.values[found], 0)
        return out

    def inputs(self, words: Words) -> np.ndarray:
        """Words x INPUTS."""
        out = np.zeros((len(words.starts), INPUTS), np.float32)
        if not len(words.starts):
            return out
        first = [self(p) for p in words.prefixes]
        grams = self(words.grams)
        out[:, 0] = self(words.word)
        out[:, 1] = np.maximum.reduce(first)
        out[:, 2] = np.minimum.reduce(first)
        out[:, 3] = np.maximum.reduceat(grams, words.starts)
        out[:, 4] = np.minimum.reduceat(grams, words.starts)
        out[:, 5] = np.log1p(words.size) / 4
        return out


def telling(texts: list[bytes], labels: np.ndarray) -> Features:
    """Features whose document count among toxic texts deviates from chance.

    Of texts that begin or end alike only the first counts, or a group of copies
    would make its own words telling.
    """
    seen: set[bytes] = set()
    kept = []
    for i, text in enumerate(texts):
        words = text.split()
        ends = b"<" + b" ".join(words[:8]), b">" + b" ".join(words[-8:])
        if words and not (ends[0] in seen or ends[1] in seen):
            seen.update(ends)
            kept.append(i)
    hashes: list[np.ndarray] = []
    marks: list[np.ndarray] = []
    for i in kept:
        w = read_words([texts[i]])
        own = np.unique(np.concatenate([w.word, *w.prefixes, w.grams]))
        hashes.append(own[own > 0])
        marks.append(np.full(len(hashes[-1]), labels[i], np.int64))
    if not hashes:
        return Features.of(np.zeros(0, np.uint64), np.zeros(0))
    flat, mark = np.concatenate(hashes), np.concatenate(marks)
    order = np.argsort(flat, kind="stable")
    flat, mark = flat[order], mark[order]
    first = np.nonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))[0]
    count, toxic = np.diff(np.append(first, len(flat))), np.add.reduceat(mark, first)
    share = labels[kept].mean()
    z = (toxic - count * share) / np.sqrt(count * share * (1 - share) + 0.25)
    chosen = np.argsort(-np.abs(z), kind="stable")[:FEATURES]
    chosen = chosen[np.abs(z[chosen]) >= LEAST_Z]
    return Features.of(flat[first][chosen], np.sign(z[chosen]) * np.log1p(np.abs(z[chosen])))


def windows(inputs: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows: steps x windows x INPUTS, the words in each, their text.

    The last window of a text ends with it.  A text with fewer words has one window; one
    without any a window with a single blank step, so that it gets a score too.
    """
    count = np.bincount(owner, minlength=texts)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]])
    many = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, 1)
    of = np.repeat(np.arange(texts), many)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = begin[of] + np.minimum(step * STRIDE, np.maximum(count[of] - WINDOW, 0))
    length = np.minimum(count[of], WINDOW)
    at = start[None, :] + np.arange(WINDOW)[:, None]
    valid = np.arange(WINDOW)[:, None] < length[None, :]
    padded = np.concatenate([inputs, np.zeros((1, INPUTS), np.float32)])
    x = padded[np.where(valid, at, len(inputs))]
    return x, np.maximum(length, 1), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Two gated recurrent units, attention over their states, one output."""

    def __init__(self, parameters: dict[str, np.ndarray] | None = None, seed: int = 11):
        if parameters is None:
            rng = np.random.default_rng(seed)
            draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
            parameters = {"v": draw(2 * HIDDEN), "o": draw(2 * HIDDEN), "b": np.array([-1.0], np.float32)}
            for way in "fb":
                parameters |= {
                    f"W{way}": draw(INPUTS, 3 * HIDDEN), f"U{way}": draw(HIDDEN, 3 * HIDDEN),
                    f"c{way}": np.zeros(3 * HIDDEN, np.float32),
                }
        self.p = parameters

    def _unit(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction, in the order of reading."""
        p, n = self.p, HIDDEN
        drive = x @ p[f"W{way}"] + p[f"c{way}"]
        h = np.zeros((x.shape[1], n), np.float32)
        states, kept = np.empty((len(x), x.shape[1], n), np.float32), []
        for t in range(len(x)):
            back = h @ p[f"U{way}"]
            gates = _sigmoid(drive[t, :, : 2 * n] + back[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            new = np.tanh(drive[t, :, 2 * n :] + r * back[:, 2 * n :])
            if keep:
                kept.append((h, z, r, new, back[:, 2 * n :]))
            h = new + z * (h - new)
            states[t] = h
        return states, kept

    def logits(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        forward, kf = self._unit(x, "f", keep)
        backward, kb = self._unit(x[::-1], "b", keep)
        states = np.concatenate([forward, backward[::-1]], axis=2)
        weight = states @ self.p["v"]
        weight[np.arange(len(x))[:, None] >= length[None, :]] = -np.inf
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        out = pooled @ self.p["o"] + self.p["b"][0]
        return (out, (states, weight, pooled, kf, kb)) if keep else out

    def gradients(self, x: np.ndarray, length: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, n = self.p, HIDDEN
        out, (states, weight, pooled, kf, kb) = self.logits(x, length, keep=True)
        d = ((_sigmoid(out) - label) / len(label)).astype(np.float32)
        g = {"b": np.array([d.sum()]), "o": pooled.T @ d}
        d_pooled = d[:, None] * p["o"]
        along = (states * d_pooled).sum(axis=2)
        d_weight = weight * (along - (weight * along).sum(axis=0))
        g["v"] = np.einsum("tb,tbh->h", d_weight, states)
        d_states = weight[:, :, None] * d_pooled + d_weight[:, :, None] * p["v"]
        for way, kept, xs, ds in (
            ("f", kf, x, d_states[:, :, :n]), ("b", kb, x[::-1], d_states[::-1, :, n:]),
        ):
            gw, gu = np.zeros_like(p[f"W{way}"]), np.zeros_like(p[f"U{way}"])
            gc, dh = np.zeros_like(p[f"c{way}"]), np.zeros_like(ds[0])
            for t in range(len(xs) - 1, -1, -1):
                h, z, r, new, back = kept[t]
                dh = dh + ds[t]
                dz = dh * (h - new) * z * (1 - z)
                dn = dh * (1 - z) * (1 - new * new)
                dr = dn * back * r * (1 - r)
                drive = np.concatenate([dz, dr, dn], axis=1)
                recur = np.concatenate([dz, dr, dn * r], axis=1)
                gw += xs[t].T @ drive
                gc += drive.sum(axis=0)
                gu += h.T @ recur
                dh = dh * z + recur @ p[f"U{way}"].T
            g |= {f"W{way}": gw, f"U{way}": gu, f"c{way}": gc}
        return g


@dataclass
class Model:
    features: Features
    network: Network
    rate: float  # score where nothing can be learned
    fitted: bool

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(
            out, keys=self.features.keys, values=self.features.values, rate=self.rate,
            fitted=self.fitted, **{f"p_{k}": v for k, v in self.network.p.items()},
        )
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        p = {k[2:]: z[k] for k in z.files if k.startswith("p_")}
        return cls(Features.of(z["keys"], z["values"]), Network(p), float(z["rate"]), bool(z["fitted"]))

    def window_logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, tuple]:
        words = read_words(texts)
        x, length, of = windows(self.features.inputs(words), words.owner, len(texts))
        logits = np.concatenate(
            [self.network.logits(x[:, i : i + 4096], length[i : i + 4096]) for i in range(0, len(of), 4096)]
        )
        return logits, of, (x, length)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Highest window of each text, as a probability."""
        best = np.full(len(texts), -np.inf)
        if not self.fitted:
            return np.full(len(texts), self.rate)
        pieces: list[bytes] = []
        owners: list[int] = []
        held = 0

        def run() -> None:
            if pieces:
                logits, of, _ = self.window_logits(pieces)
                np.maximum.at(best, np.array(owners)[of], logits)
                pieces.clear()
                owners.clear()

        for i, text in enumerate(texts):
            for piece in _parts(lower_ascii(text)):
                pieces.append(piece)
                owners.append(i)
                held += len(piece)
                if held > BYTES_AT_ONCE:
                    run()
                    held = 0
        run()
        return _sigmoid(best)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text; a very long one in parts that share a window, so no window is lost."""
    if len(text) <= BYTES_AT_ONCE:
        yield text
        return
    words = text.split()
    # Parts begin on the grid of the windows and end with a full one.
    for at in range(0, max(1, len(words) - WINDOW + STRIDE), WORDS_AT_ONCE):
        yield b" ".join(words[at : at + WORDS_AT_ONCE + WINDOW - STRIDE])


def train(texts: list[str | None], labels: np.ndarray, seed: int = 11) -> Model:
    """Fit table and network.  Without rows of both kinds the score is the share of label 1."""
    labels = np.asarray(labels, np.int64)
    rate = float(labels.mean()) if len(labels) else 0.0
    lowered = [lower_ascii(t) for t in texts]
    both = len(labels) > 0 and 0 < labels.sum() < len(labels)
    features = telling(lowered, labels) if both else Features.of(np.zeros(0, np.uint64), np.zeros(0))
    model = Model(features, Network(seed=seed), rate, both)
    if not both:
        return model
    xs, lengths, owners = [], [], []
    for at in range(0, len(lowered), 500):
        words = read_words(lowered[at : at + 500])
        x, length, of = windows(features.inputs(words), words.owner, len(lowered[at : at + 500]))
        xs.append(x)
        lengths.append(length)
        owners.append(of + at)
    x, length, of = np.concatenate(xs, axis=1), np.concatenate(lengths), np.concatenate(owners)
    rng = np.random.default_rng(seed)
    network, moments = model.network, {k: [0.0, 0.0] for k in model.network.p}
    first = np.searchsorted(of, np.arange(len(texts)))
    step = 0
    for round_number in range(ROUNDS):
        if round_number == 0:
            value = x[:, :, :5].sum(axis=2).max(axis=0)
        else:
            value = np.concatenate([network.logits(x[:, i : i + 8192], length[i : i + 8192]) for i in range(0, len(of), 8192)])
        order = np.lexsort((-value, of))
        top = order[first]
        other = np.minimum(first + (rng.random(len(first)) * np.diff(np.append(first, len(of)))).astype(np.int64), len(of) - 1)
        # Every window of a clean document is clean; of a toxic one only the highest is sure.
        pool = np.concatenate([top, other[labels == 0]])
        target = np.concatenate([labels, np.zeros((labels == 0).sum(), np.int64)])
        for _ in range(STEPS_A_ROUND):
            step += 1
            pick = rng.integers(0, len(pool), BATCH)
            grads = network.gradients(x[:, pool[pick]], length[pool[pick]], target[pick].astype(np.float32))
            for k, g in grads.items():
                m, s = moments[k]
                moments[k] = m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
                m, s = m / (1 - 0.9**step), s / (1 - 0.99**step)
                network.p[k] = (network.p[k] - 0.02 * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, toxic of at most `rows` labelled documents outside the held-out fold, chosen by
    the hash of their id.  Of several labels of a document the highest counts."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic")
    )
    learn = known.where(~_held_out(folds, held_fold))
    few = learn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("text", "toxic", F.xxhash64("doc_id").alias("place"))


def _held_out(folds: int, held_fold: int):
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text_id), F.lit(folds)) == held_fold


def fit(docs: DataFrame, labels: DataFrame, **options) -> bytes:
    """The trained model.  The sample is bounded, so one task holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"text": [], "toxic": [], "place": []}), *batches])
        rows = rows.sort_values(["place", "text"], kind="stable")
        yield pd.DataFrame({"model": [train(rows["text"].tolist(), rows["toxic"].to_numpy()).dump()]})

    found = sample(docs, labels, **options).repartition(1).mapInPandas(run, "model binary").first()
    return found["model"] if found else train([], np.zeros(0)).dump()  # a plan without rows runs no task


def with_score(docs: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """All rows of `docs` and the score of their text."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = Model.load(shared.value)
        for batch in batches:
            found = loaded.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name]
            )

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `docs` (doc_id, text).

    Rows of `labels` (doc_id, toxic) teach unless crc32(doc_id) mod `folds` is `held_fold`.
    Null and empty texts are scored as a blank window; repeated rows score alike; null
    doc_ids hash as the empty text.  An empty table gives no rows.
    """
    model = fit(docs, labels, folds=folds, held_fold=held_fold)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", _held_out(folds, held_fold).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not rejected, with all their columns."""
    columns = docs.columns
    # Own names, so that a column of the documents cannot clash with the score.
    packed = docs.select(
        F.struct(*[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)]).alias("_doc"),
        docs["text"].alias("text"),
    )
    scored = with_score(packed, fit(docs, labels))
    return scored.where("score < 0.5").select(*[F.col(f"_doc.c{i}").alias(c) for i, c in enumerate(columns)])
