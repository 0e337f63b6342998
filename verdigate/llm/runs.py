"""Maximal periodic runs of words, from a difference cover and a harmonic grid.

A run is a stretch that repeats with a smallest period q and that no neighbouring word
extends.  Where a text has a run of period p, word i equals word i + p over at least p
places in a row, so one of them is a multiple of p.  For each period the multiples of p
are therefore looked at alone, n ln n places in all.  How far the equality reaches to
the right of such a place, and in the reversed text to its left, are two longest common
extensions (LCE).

Only suffixes that begin at the places of a difference cover are sorted.  For any two
places some shift below 32 brings both into the cover: so an extension compares fewer
than 32 words, and from there on takes the minimum of the common prefixes between two
neighbours of the sorted order, which a sparse table holds.

Documents are independent.  A task joins short ones to one sequence, with a word of its
own after each, so that nothing matches across; all steps are numpy operations over the
sequence, and memory is bounded by the longest document.
"""

from __future__ import annotations

import hashlib
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from verdigate.llm.common import small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A set of residues whose differences are all residues (fixed values).
MODULUS = 32
COVER = (0, 1, 2, 3, 7, 11, 19)

#: Shortest run reported, in words.
SHORTEST = 12

#: Words of joined documents, and grid places looked at together.
WORDS_AT_ONCE = 1 << 16
PLACES_AT_ONCE = 1 << 20

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, "
    "exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


def shift_table(modulus: int = MODULUS, cover: tuple[int, ...] = COVER) -> np.ndarray:
    """For residues i and j the least shift that brings both into the cover."""
    inside = np.zeros(modulus, bool)
    inside[list(cover)] = True
    at = np.arange(modulus)
    both = inside[(at[:, None, None] + at) % modulus] & inside[(at[None, :, None] + at) % modulus]
    if not both.any(axis=2).all():
        raise ValueError("not a difference cover")
    return both.argmax(axis=2)


SHIFTS = shift_table()


def _names(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of pairs of ranks."""
    _, names = np.unique(first * (second.max(initial=0) + 1) + second, return_inverse=True)
    return names + 1


class Extensions:
    """Longest common extensions to the right in a sequence of positive numbers."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        #: Past the end all words are 0, but for the very last: no two suffixes are equal.
        self.words = np.concatenate([words, np.zeros(2 * MODULUS, np.int64)])
        names, width = self.words, 1
        while width < MODULUS:
            moved = np.concatenate([names[width:], np.zeros(width, np.int64)])
            names, width = _names(names, moved), width * 2
        at = np.arange(n)
        sampled = at[np.isin(at % MODULUS, COVER)]
        #: Positions of samples by place; places beyond the text have rank 0.
        self.slot = np.full(n + MODULUS, -1, np.int64)
        self.slot[sampled] = np.arange(len(sampled))
        _, ranks = np.unique(names[sampled], return_inverse=True)
        ranks, levels, step = ranks + 1, [], MODULUS
        while True:
            levels.append(ranks)
            if ranks.max(initial=0) == len(ranks):
                break
            ranks, step = _names(ranks, self._moved(ranks, sampled, step)), step * 2
        order = np.argsort(ranks)
        self.rank = ranks - 1
        self.table = [self._neighbours(sampled[order], levels)]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _moved(self, ranks: np.ndarray, places: np.ndarray, step: int) -> np.ndarray:
        """Ranks of the samples `step` further; 0 beyond the text."""
        found = np.zeros(len(places), np.int64)
        inside = places + step < self.n
        found[inside] = ranks[self.slot[places[inside] + step]]
        return found

    def _neighbours(self, ordered: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of samples that follow each other in the order: whole strides of
        equal rank first, from the longest to 32 words, then the last words one by one."""
        a, b = ordered[:-1], ordered[1:]
        done = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + done, b + done
            inside = np.nonzero((i < self.n) & (j < self.n))[0]
            same = levels[k][self.slot[i[inside]]] == levels[k][self.slot[j[inside]]]
            done[inside[same]] += MODULUS << k
        done += self._compared(a + done, b + done, np.full(len(a), MODULUS))
        return np.minimum(done, self.n - np.maximum(a, b)).astype(np.int32)

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from a and b on, `most` at the most (32 or fewer)."""
        equal = np.zeros(len(a), np.int64)
        left = np.nonzero((most > 0) & (np.maximum(a, b) < self.n))[0]
        while len(left):
            k = equal[left]
            left = left[self.words[a[left] + k] == self.words[b[left] + k]]
            equal[left] += 1
            left = left[(equal[left] < most[left]) & (np.maximum(a[left], b[left]) + equal[left] < self.n)]
        return equal

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common extension of different places a and b."""
        shift = SHIFTS[a % MODULUS, b % MODULUS]
        found = self._compared(a, b, shift)
        far = np.nonzero((found == shift) & (np.maximum(a, b) + shift < self.n))[0]
        if len(far):
            x = self.rank[self.slot[a[far] + shift[far]]]
            y = self.rank[self.slot[b[far] + shift[far]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp(high - low)[1] - 1
            least = np.empty(len(far), np.int64)
            for k in np.unique(level):
                at = np.nonzero(level == k)[0]
                row = self.table[k]
                least[at] = np.minimum(row[low[at]], row[high[at] - (1 << k)])
            found[far] += least
        return found


def _grid(lengths: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): the multiples of each period up to half of each document, in
    pieces of bounded size, periods of a document ascending."""
    half = lengths // 2
    document = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(document)) - np.repeat(np.cumsum(half) - half, half) + 1
    counts = (lengths[document] - 1) // period  # places i with i + period inside
    ends = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PLACES_AT_ONCE, side="right")))
        p = np.repeat(period[at:to], counts[at:to])
        k = np.arange(len(p)) - np.repeat(ends[at:to] - counts[at:to] - before, counts[at:to])
        yield np.repeat(begins[document[at:to]], counts[at:to]) + k * p, p
        at = to


def find_runs(words: np.ndarray, lengths: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (document, start, length, period) by document, start and period.

    `words` holds the documents one after the other, each followed by a number that
    occurs nowhere else; `lengths` counts their words without it.
    """
    n = len(words)
    begins = np.cumsum(lengths + 1) - lengths - 1
    none = np.empty((0, 4), np.int64)
    right = left = None
    found = np.empty((0, 3), np.int64)  # start, end, period
    for place, period in _grid(lengths, begins):
        equal = words[place] == words[place + period]
        place, period = place[equal], period[equal]
        if not len(place):
            continue
        if right is None:
            right, left = Extensions(words), Extensions(words[::-1])
        forward = right.of(place, place + period)
        # In the reversed text the word before place i stands at n - i.
        backward = np.zeros(len(place), np.int64)
        inner = np.nonzero(place > 0)[0]
        backward[inner] = left.of(n - place[inner], n - place[inner] - period[inner])
        reach = forward + backward
        good = (reach >= period) & (reach + period >= shortest)
        if not good.any():
            continue
        start = place[good] - backward[good]
        rows = np.stack([start, start + reach[good] + period[good], period[good]], axis=1)
        # A stretch that repeats with p and with a smaller q has been found with q.
        rows = np.concatenate([found, rows])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        found = rows[first]
    if not len(found):
        return none
    document = np.searchsorted(begins, found[:, 0], side="right") - 1
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    document = np.sort(document)
    return np.stack([document, found[:, 0] - begins[document], found[:, 1] - found[:, 0], found[:, 2]], axis=1)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, with a periodic tail where the contract's hash of the id asks for one."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run repeats: those outside runs and the first period of each."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges)[:-1] == 0
    return [w for w, k in zip(words, kept) if k]


def _row(doc_id: int | None, words: list[bytes], runs: np.ndarray) -> tuple:
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    best = [None] * 4
    if len(runs):
        s, n, p = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
        best = [s, n, p, 1000 * n // p]
    text = b" ".join(collapsed(words, runs))
    return doc_id, len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


def describe(documents: list[tuple[int | None, list[bytes]]]) -> list[tuple]:
    """Result rows of documents that are handled as one sequence."""
    known: dict[bytes, int] = {}
    lengths = np.array([len(w) for _, w in documents], np.int64)
    parts, separator = [], -1
    for _, words in documents:
        parts += [known.setdefault(w, len(known) + 1) for w in words]
        parts.append(separator)
        separator -= 1
    sequence = np.array(parts, np.int64)
    ends = sequence < 0
    sequence[ends] = len(known) - sequence[ends]
    found = find_runs(sequence, lengths)
    cut = np.searchsorted(found[:, 0], np.arange(len(documents) + 1))
    return [_row(i, w, found[cut[k] : cut[k + 1], 1:]) for k, (i, w) in enumerate(documents)]


def periodic_runs(docs: DataFrame, plant=planted) -> DataFrame:
    """One row per row of `docs` (doc_id, text), see SCHEMA: number of runs, the longest
    run, digests of all runs and of the words that no run repeats.

    `plant` may change the words of a document first.  Null texts have no words; a null
    doc_id is kept and nothing is planted there.  Texts without a run, empty ones too,
    have null start, length, period and exponent and the digest of an empty list.  Equal
    rows give equal rows.  Of runs of the same length the first counts as the longest,
    then the one with the smallest period.  Other columns are ignored; an empty table
    gives an empty result.
    """
    small_batches(docs.sparkSession)
    types = [pa.int64()] * 6 + [pa.string()] * 2
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = plant(doc_id, words)
                if waiting and size + len(words) > WORDS_AT_ONCE:
                    yield batch_of(describe(waiting))
                    waiting, size = [], 0
                waiting.append((doc_id, words))
                size += len(words) + 1
        if waiting:
            yield batch_of(describe(waiting))

    columns = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return columns.mapInArrow(run, SCHEMA)
