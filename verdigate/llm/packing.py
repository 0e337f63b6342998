"""Packing with optimal length buckets.

One job counts the lengths of all documents.  Dynamic programming over that
histogram chooses the bucket boundaries with the least padding, and batches under a
token budget form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, gapless, numbered, text_of, word_count

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Lengths up to this are counted one by one; above, this many cells per doubling.
FINE = 1024


def length_cell(length: Column) -> Column:
    """Upper end of the histogram cell of a length of 1 or more.  Lengths up to FINE are
    their own cell, longer ones share cells a thousandth wide, so the histogram has
    some ten thousand cells however many documents there are."""
    step = F.greatest(F.floor(F.log2(length.cast("double"))) - F.lit(np.log2(FINE)), F.lit(0)).cast("int")
    width = F.pow(F.lit(2.0), step)
    return (F.ceil(length / width) * width).cast("bigint")


def best_boundaries(ends: np.ndarray, counts: np.ndarray, lengths: np.ndarray, buckets: int) -> list[int]:
    """Ends of at most `buckets` buckets that minimise the sum of (end - length).

    `ends` ascend; `counts` and `lengths` hold the documents and their summed
    lengths per cell.  The best cut moves right with the end of the prefix, so each
    layer is solved by halving: middle prefixes first, their cuts bound the others.
    """
    n = len(ends)
    if n == 0:
        return []
    many = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(lengths)]).astype(np.float64)
    cost = np.concatenate([[0.0], ends * many[1:] - total[1:]])
    cuts: list[np.ndarray] = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        best, cut = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(first, min(last, mid - 1) + 1)
            value = cost[i] + ends[mid - 1] * (many[mid] - many[i]) - (total[mid] - total[i])
            k = int(value.argmin())
            best[mid], cut[mid] = value[k], i[k]
            todo += [(lo, mid - 1, first, int(i[k])), (mid + 1, hi, int(i[k]), last)]
        cost = best
        cuts.append(cut)
    chosen, at = [], n
    for cut in reversed(cuts):
        if at == 0:
            break
        chosen.append(int(ends[at - 1]))
        at = int(cut[at])
    return chosen[::-1]


def pack(rows: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """Pack numbered rows (_row, doc_id, length of 1 or more), which must be a written table.

    Returns doc_id, length, bucket, bucket_length, batch, slot, padding: the bucket
    (from 0, short to long), the length its documents are padded to, the batch
    (numbered over all buckets) and the place in it.  A batch holds as many documents
    as the budget allows at the bucket's length; a document longer than the budget is
    a batch of its own.  Repeated rows and null doc_ids are packed like others; an
    empty table gives no rows.
    """
    cells = (
        rows.groupBy(length_cell(F.col("length")).alias("cell"))
        .agg(F.count("*").alias("n"), F.sum("length").alias("s"), F.max("length").alias("longest"))
        .orderBy("cell")
        .collect()
    )
    ends = np.array([c["longest"] for c in cells], np.float64)
    counts = np.array([c["n"] for c in cells], np.int64)
    chosen = best_boundaries(ends, counts, np.array([c["s"] for c in cells], np.int64), buckets)
    capacity = [max(1, token_budget // end) for end in chosen]
    inside = [int(counts[(ends > low) & (ends <= end)].sum()) for low, end in zip([0, *chosen], chosen)]
    batches = np.cumsum([0, *[-(-n // c) for n, c in zip(inside, capacity)]])
    limits = F.array(*[F.lit(int(e)).cast("bigint") for e in chosen or [1]])
    sizes = F.array(*[F.lit(int(c)).cast("bigint") for c in capacity or [1]])
    firsts = F.array(*[F.lit(int(b)).cast("bigint") for b in batches])
    bucket = F.size(F.filter(limits, lambda end: end < F.col("length")))
    placed = gapless(
        rows.withColumn("bucket", bucket), ["bucket"], ["doc_id", "_row"], int(counts.sum()), "_place"
    )
    fits = F.get(sizes, F.col("bucket"))
    return placed.select(
        "doc_id", "length", "bucket", F.get(limits, F.col("bucket")).alias("bucket_length"),
        (F.get(firsts, F.col("bucket")) + F.floor(F.col("_place") / fits)).alias("batch"),
        F.pmod("_place", fits).alias("slot"),
        (F.get(limits, F.col("bucket")) - F.col("length")).alias("padding"),
    )


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pack documents by their words and one separator each, so a null or empty text
    has length 1."""
    scratch = Scratch(docs.sparkSession)
    rows = numbered(
        docs, scratch, docs["doc_id"].alias("doc_id"), (word_count(text_of()) + 1).alias("length")
    )
    return pack(rows, **options)
