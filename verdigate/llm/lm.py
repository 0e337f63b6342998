"""Language-model scoring with a subword lattice.

The pieces are those of an existing vocabulary.  A word, led by its space, may be cut into
pieces in many ways; its probability is the sum over all of them, found by a forward
recursion over its bytes in log space.  Pieces never cross a space, so the lattice of a
text is the chain of the lattices of its words, and its probability their product and
that of the end: each distinct word is solved once for the whole corpus.

The file ranks its pieces.  Ranks start the weights (Zipf), and passes of expectation and
maximisation over the words of the training part, each weighted by its count, replace
them.  Single bytes are pieces too, so every text has a probability.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, lower_ascii, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts travel to every task; the others are joined.
FREQUENT = 200_000
PASSES = 4
#: Added to the expected count of each piece, so that none becomes impossible.
PRIOR = 0.05
#: Distinct words a task holds before it hands on their counts.
HELD_WORDS = 400_000
#: Words that share the tables of one recursion; texts need smaller batches.
SOLVED_WORDS = 20_000
MARK = " "


def vocabulary(path: str = VOCABULARY) -> list[tuple[bytes, float]]:
    """(piece, weight) of a vocabulary file; the mark of a word is a space, and weights fall
    with the rank.  Pieces with A-Z cannot occur in lower-cased words and are left out;
    byte pieces stand for a byte that is no piece of its own."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", MARK).encode()
        if piece != piece.lower() or MARK.encode() in piece[1:]:
            continue
        pieces[piece] = 1.0 / (1.0 - model.get_score(i) + 10.0)
    for byte in range(256):
        pieces.setdefault(bytes([byte]), 1e-6)
    return sorted(pieces.items())


class Lattice:
    """All segmentations of words over weighted pieces."""

    def __init__(self, pieces: list[bytes], log_weights: np.ndarray):
        self.log_weights = log_weights
        nodes: list[dict[int, int]] = [{}, {}]  # node 0 has no way on, node 1 is the root
        piece_at = [-1, -1]
        for number, piece in enumerate(pieces):
            at = 1
            for byte in piece:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                    piece_at.append(-1)
                at = nodes[at][byte]
            piece_at[at] = number
        self.step = np.zeros((len(nodes), 256), np.int32)
        for node, ways in enumerate(nodes):
            for byte, to in ways.items():
                self.step[node, byte] = to
        self.piece_at = np.array(piece_at, np.int32)

    def _edges(self, letters: np.ndarray, lengths: np.ndarray, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(end, words, pieces) of every piece that begins at `start` in some word."""
        words = np.nonzero(lengths > start)[0]
        node = np.ones(len(words), np.int32)
        for at in range(start, letters.shape[1]):
            inside = lengths[words] > at
            words, node = words[inside], node[inside]
            node = self.step[node, letters[words, at]]
            alive = node > 0
            words, node = words[alive], node[alive]
            if not len(words):
                return
            piece = self.piece_at[node]
            has = piece >= 0
            if has.any():
                yield at + 1, words[has], piece[has]

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural log of the summed probability of all segmentations of each word."""
        return self._run(words, None)[0]

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over all segmentations of all words."""
        return self._run(words, counts)[1]

    def _run(self, words: list[bytes], counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        total = np.full(len(words), -np.inf)
        uses = np.zeros(len(self.log_weights))
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            # Words of like length share a table of some million cells.
            span = max(1, min(50_000, 4_000_000 // (int(sizes[order[at]]) + 1)))
            chosen = order[at : at + span]
            if sizes[chosen[-1]] > 2 * sizes[chosen[0]] + 8:
                chosen = chosen[: int(np.searchsorted(sizes[chosen], 2 * sizes[chosen[0]] + 8, "right"))]
            at += len(chosen)
            lengths, most = sizes[chosen], int(sizes[chosen[-1]])
            letters = np.zeros((len(chosen), most), np.uint8)
            flat = np.frombuffer(b"".join(words[i] for i in chosen), np.uint8)
            letters[np.arange(most)[None, :] < lengths[:, None]] = flat
            ahead = np.full((most + 1, len(chosen)), -np.inf)
            ahead[0] = 0.0
            for start in range(most):
                for end, who, piece in self._edges(letters, lengths, start):
                    ahead[end, who] = np.logaddexp(ahead[end, who], ahead[start, who] + self.log_weights[piece])
            total[chosen] = whole = ahead[lengths, np.arange(len(chosen))]
            if counts is None:
                continue
            behind = np.full((most + 1, len(chosen)), -np.inf)
            behind[lengths, np.arange(len(chosen))] = 0.0
            for start in range(most - 1, -1, -1):
                for end, who, piece in self._edges(letters, lengths, start):
                    after = self.log_weights[piece] + behind[end, who]
                    behind[start, who] = np.logaddexp(behind[start, who], after)
                    share = np.exp(ahead[start, who] + after - whole[who])
                    np.add.at(uses, piece, share * counts[chosen[who]])
        return total, uses


def word_counts(rows: DataFrame) -> DataFrame:
    """word, c (uses in the training part) of every word of rows (text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        known: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(words, pa.binary()),
                    pa.array([known[w] for w in words], pa.int64()),
                ],
                names=["word", "c"],
            )
            seen.clear()
            known.clear()
            return batch

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = lower_ascii(text).split()
                seen.update(words)
                if not held:
                    known.update(words)
                if len(seen) > HELD_WORDS:
                    yield out()
        yield out()

    found = rows.select("text", "held_out").mapInArrow(run, "word binary, c bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def fit(words: DataFrame, ends: int, pieces: list[tuple[bytes, float]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Log weights of the pieces, and of the end, from rows (word, c) of the training part."""
    names = [p for p, _ in pieces]
    weights = np.array([w for _, w in pieces])
    log_weights = np.log(weights / weights.sum())
    end = math.log(0.01)
    sc = words.sparkSession.sparkContext
    for _ in range(passes):
        shared = sc.broadcast((names, log_weights))

        def uses(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            lattice, total = Lattice(*shared.value), None
            for batch in batches:
                marked = [MARK.encode() + bytes(w) for w in batch["word"]]
                found = lattice.expected(marked, batch["c"].to_numpy(np.float64))
                total = found if total is None else total + found
            if total is not None:
                used = np.nonzero(total)[0]
                yield pd.DataFrame({"piece": used, "uses": total[used]})

        rows = words.where("c > 0").mapInPandas(uses, "piece int, uses double")
        counts = np.full(len(names), PRIOR)
        for r in rows.groupBy("piece").agg(F.sum("uses").alias("u")).collect():  # one row per piece
            counts[r["piece"]] += r["u"]
        everything = counts.sum() + ends + PRIOR
        log_weights, end = np.log(counts / everything), math.log((ends + PRIOR) / everything)
        shared.unpersist()
    return log_weights, end


def lattice_scores(
    docs: DataFrame, vocabulary_file: str = VOCABULARY, folds: int = 7, held_fold: int = 2,
    frequent: int = FREQUENT, passes: int = PASSES,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of
    `docs` (doc_id, text).

    Rows whose crc32(doc_id) mod `folds` is `held_fold` are held out of all counts.  Tokens
    are the words and one end.  `base_score` is the add-one word model, `score` the lattice
    model, both log10.  Null and empty texts consist of the end alone; null doc_ids hash
    as the empty text; repeated rows are scored, and counted, one by one.  An empty table
    gives no rows.  Texts are read whole, the longest word included.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    scratch = Scratch(spark)
    text_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    held = F.pmod(F.crc32(text_id), F.lit(folds)) == held_fold
    rows = docs.select(F.col("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))
    words = scratch.table(word_counts(rows))
    ends = rows.where(~F.col("held_out")).count()
    all_words = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    train_tokens = (all_words["n"] or 0) + ends
    denominator = math.log10(train_tokens + (all_words["v"] or 0) + (ends > 0) + 1)
    pieces = vocabulary(vocabulary_file)
    small_batches(spark, SOLVED_WORDS)
    log_weights, log_end = fit(words, ends, pieces, passes)
    model = sc.broadcast(([p for p, _ in pieces], log_weights))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = None
        for batch in batches:
            lattice = lattice or Lattice(*model.value)
            marked = [MARK.encode() + w for w in batch.column(0).to_pylist()]
            found = lattice.forward(marked) / math.log(10) if marked else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["word", "c", "lp"])

    solved = scratch.table(words.mapInArrow(solve, "word binary, c bigint, lp double"))
    small_batches(spark)
    # At most `frequent` rows of short words: the largest words of this table are few bytes.
    top = solved.where("c > 0 and octet_length(word) <= 64").orderBy(F.desc("c"), "word").limit(frequent)
    common = sc.broadcast({bytes(r["word"]): (r["c"], r["lp"]) for r in top.toLocalIterator()})
    base_end = math.log10(ends + 1) - denominator
    end_score = log_end / math.log(10)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: (math.log10(c + 1) - denominator, lp) for w, (c, lp) in common.value.items()}
        for batch in batches:
            out: dict[str, list] = {name: [] for name in names}
            for row, doc, held_out, text in zip(*[column.to_pylist() for column in batch.columns]):
                uses = Counter(lower_ascii(text).split())
                known, base, score, n = int(ends > 0), base_end, end_score, 1
                for word, times in uses.items():
                    n += times
                    found = table.get(word)
                    if found is None:
                        for name, value in zip(names, (row, None, None, word, times, 0, 0, 0.0, 0.0)):
                            out[name].append(value)
                    else:
                        known += times
                        base += times * found[0]
                        score += times * found[1]
                for name, value in zip(names, (row, doc, held_out, None, 0, n, known, base, score)):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    names = ["_row", "doc_id", "held_out", "word", "times", "n_tokens", "n_known", "base_score", "score"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds)))
    # The row numbers are written together with what is found, so they stay.
    parts = scratch.table(
        rows.select(F.monotonically_increasing_id(), F.col("doc_id").cast("bigint"), "held_out", "text").mapInArrow(
            tally,
            "_row bigint, doc_id bigint, held_out boolean, word binary, times bigint, n_tokens bigint, "
            "n_known bigint, base_score double, score double",
        )
    )
    rare = parts.where("word is not null").select("_row", "word", "times").join(solved, "word")
    rare = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("k"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1) - denominator)).alias("b"),
        F.sum(F.col("times") * F.col("lp")).alias("s"),
    )
    whole = parts.where("word is null").drop("word", "times").join(rare, "_row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return whole.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(int(train_tokens)).cast("bigint").alias("train_tokens"),
        plus("base_score", "b"), plus("score", "s"),
    )
