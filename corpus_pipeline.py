"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  Its result is written as
Parquet and read again as the `docs` of the next; only then may the next stage begin,
because a stage starts by deleting the intermediate tables of the one before.  All
stages but the last return the columns of `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from verdigate.llm import exact, mixing, packing, similar, toxicity
from verdigate.llm.common import Scratch, read
from verdigate.operators.distributed import shared_folder
from verdigate.sources.ingest import configure

_scratch: list[Scratch] = []


def _begin(spark: SparkSession) -> Scratch:
    configure(spark)
    while _scratch:
        _scratch.pop().drop()
    _scratch.append(Scratch(spark))
    return _scratch[-1]


def toxic_rows_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go (operator 8)."""
    _begin(spark)
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest stays (operator 5)."""
    return exact.without_copies(docs, _begin(spark))


def near_copies_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity 0.8 or more) the smallest
    doc_id stays.  Candidates are what the fingerprints of operator 9 link, and lists of
    smallest shingles for the pairs these miss; the texts decide."""
    return similar.one_of_each_group(docs, _begin(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, kept or left out to meet the sources' targets (operator 6)."""
    return mixing.mixed_rows(docs, read(spark, sf_dir, "labels"), _begin(spark))


def pack_lengths(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents of like length (operator 4)."""
    _begin(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_rows_go),
    ("exact dedup", exact_copies_go),
    ("near-dedup", near_copies_go),
    ("mixing", mix_sources),
    ("packing", pack_lengths),
]

#: No SQL: toxicity is a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = read(spark, sf_dir, "documents")
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = f"{place}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
