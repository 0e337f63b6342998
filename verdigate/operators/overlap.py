"""N-gram overlap of two corpora by hashes made in arrays.

Rows times positions are never made as rows: a task hashes the tokens of its texts in
numpy, joins neighbours by doubling, and hands on the distinct n-grams of some texts in one
binary value a bucket, 16 bytes each.  The task that holds a bucket counts its distinct ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigate.operators.text import tokens

#: Tokens hashed at a time, and characters of text for one bucket: at most half as many n-grams of a size.
CHUNK_TOKENS, BUCKET_CHARACTERS = 1 << 20, 1 << 22
#: Odd factors of the two halves of a hash.
_LANES = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB),
    (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53),
)


def _joined(x: np.ndarray, y: np.ndarray, lane: int) -> np.ndarray:
    """Hash of a run of tokens from those of its two parts, whose order counts."""
    first, second, third, fourth = (np.uint64(c) for c in _LANES[lane])
    z = x * first
    z += y * second
    z ^= z >> np.uint64(32)
    z *= third
    z ^= z >> np.uint64(29)
    z *= fourth
    z ^= z >> np.uint64(32)
    return z


def _windows(token: np.ndarray, sizes: Sequence[int], lane: int) -> dict[int, np.ndarray]:
    """Hash of the n tokens from each position on, per n, from runs of 1, 2, 4, ... tokens."""
    runs = [token]
    while 2 << (len(runs) - 1) <= max(sizes):
        half = 1 << (len(runs) - 1)
        last = runs[-1]
        runs.append(_joined(last[:max(len(last) - half, 0)], last[half:], lane))
    out = {}
    for n in sizes:
        whole, length = None, 0
        for power in reversed(range(n.bit_length())):
            if n >> power & 1:
                part = runs[power][length:]
                if whole is None:
                    whole = part
                else:
                    few = min(len(whole), len(part))
                    whole = _joined(whole[:few], part[:few], lane)
                length += 1 << power
        out[n] = whole
    return out


def _token_hashes(words: pa.Array) -> np.ndarray:
    """(2, tokens) from the md5 of each different token."""
    coded = pc.dictionary_encode(words)
    known = b"".join(hashlib.md5(w.encode("utf-8", "surrogatepass")).digest() for w in coded.dictionary.to_pylist())
    return np.frombuffer(known, np.uint64).reshape(-1, 2).T[:, coded.indices.to_numpy(zero_copy_only=False)]


def _chunks(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Tokens end to end and tokens per text, for some texts at a time."""
    lengths = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(lengths, dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + CHUNK_TOKENS, side="right")))
        yield texts.slice(begin, end - begin).flatten(), lengths[begin:end].astype(np.int64)
        begin = end


def _packed(side: int, sizes: Sequence[int], buckets: int):
    """For mapInArrow: texts as tokens to distinct n-grams per size and bucket."""
    edges = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, lengths in _chunks(batch.column(0)):
                if not len(words):
                    continue
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(words))
                token = _token_hashes(words)
                lanes = [_windows(token[lane], sizes, lane) for lane in (0, 1)]
                for n in sizes:
                    inside = left[:len(lanes[0][n])] >= n
                    a, b = lanes[0][n][inside], lanes[1][n][inside]
                    order = np.argsort(a)
                    a, b = a[order], b[order]
                    new = np.ones(len(a), bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    a, b = a[new], b[new]
                    cuts = np.concatenate([[0], np.searchsorted(a, edges), [len(a)]])
                    used = np.flatnonzero(np.diff(cuts))
                    if not len(used):
                        continue
                    data = np.stack([a, b], axis=1)
                    # Offsets of binary values have 32 bits.
                    for some in np.array_split(used, max(1, min(len(used), len(a) >> 25))):
                        first, last = cuts[some[0]], cuts[some[-1] + 1]
                        offsets = ((np.append(cuts[some], last) - first) * 16).astype(np.int32)
                        hashes = pa.Array.from_buffers(
                            pa.binary(), len(some), [None, pa.py_buffer(offsets), pa.py_buffer(data[first:last])]
                        )
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some, pa.int32()), pa.array(np.full(len(some), n, np.int32)),
                             pa.array(np.full(len(some), side, np.int32)), hashes],
                            names=["_bucket", "n", "_side", "_hashes"],
                        )

    return pack


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: distinct n-grams of the left, of the right and of both, per size."""
    parts: dict[int, list[tuple[int, np.ndarray]]] = {}
    for batch in batches:
        for n, side, hashes in zip(
            batch.column("n").to_pylist(), batch.column("_side").to_pylist(), batch.column("_hashes").to_pylist()
        ):
            parts.setdefault(n, []).append((side, np.frombuffer(hashes, np.uint64).reshape(-1, 2)))
    rows = []
    for n in list(parts):
        some = parts.pop(n)
        side = np.concatenate([np.full(len(h), s, np.uint8) for s, h in some])
        both = np.concatenate([h for _, h in some])
        order = np.argsort(both[:, 0])
        a, b = both[order, 0], both[order, 1]
        if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
            order = np.lexsort((both[:, 1], both[:, 0]))
            a, b = both[order, 0], both[order, 1]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        seen = np.bitwise_or.reduceat(side[order], np.flatnonzero(new))
        rows.append((n, int((seen & 1).sum()), int((seen >> 1).sum()), int((seen == 3).sum())))
    columns = list(zip(*rows)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=["n", "_l", "_r", "_s"]
    )


def corpus_overlap(left: DataFrame, right: DataFrame, text: str, sizes: Sequence[int]) -> DataFrame:
    """Unique, shared and rates both ways per n of the n-grams of two corpora, one row for each
    size of which either has one.  An n-gram counts by 128 bits made from its tokens' md5."""
    characters = [df.agg(F.coalesce(F.sum(F.length(text)), F.lit(0))).first()[0] for df in (left, right)]
    buckets = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-sum(characters) // BUCKET_CHARACTERS))
    packed = [
        df.select(tokens(F.col(text)).alias("_t")).mapInArrow(
            _packed(side, tuple(sizes), buckets), "_bucket INT, n INT, _side INT, _hashes BINARY"
        )
        for side, df in ((1, left), (2, right))
    ]
    counts = packed[0].unionByName(packed[1]).repartitionById(buckets, "_bucket").mapInArrow(
        _counted, "n INT, _l BIGINT, _r BIGINT, _s BIGINT"
    )
    sums = counts.groupBy("n").agg(
        F.sum("_l").alias("left_unique"), F.sum("_r").alias("right_unique"), F.sum("_s").alias("shared_unique")
    )
    return sums.withColumns({
        "left_rate": F.col("shared_unique") / F.greatest("left_unique", F.lit(1)),
        "right_rate": F.col("shared_unique") / F.greatest("right_unique", F.lit(1)),
    })
