"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a change needs no recount:
an insert adds its tokens, a delete subtracts them, a revision subtracts the old count and
adds the new.  A batch shrinks to one signed row per group before it is written, and is
committed under its id: a batch that is committed again changes nothing.
"""

from __future__ import annotations

import base64
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUP = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
#: Folder with the vocabulary files of public tokenizers.
TOKENIZERS = "/opt/tokenizers"
BPE_FILE = "byte_bpe_50k.tiktoken"


def bpe_counter(folder: str = TOKENIZERS, file: str = BPE_FILE):
    """A column function that counts byte-level BPE tokens; special strings are plain text.
    Texts are encoded in pieces that end at white space before a word, where the
    tokenizer's own pattern cuts too, so very long texts need little memory."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import re

        import tiktoken

        sys.path.append(folder)
        import public_tokenizers

        with open(f"{folder}/{file}", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoding = tiktoken.Encoding(
            "counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        cut = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")

        def tokens(text: str | None) -> int:
            if not text:
                return 0
            total, at = 0, 0
            while len(text) - at > 1_000_000:
                gap = cut.search(text, at + 500_000)
                if gap is None:
                    break
                total += len(encoding.encode_ordinary(text[at : gap.start()]))
                at = gap.start()
            return total + len(encoding.encode_ordinary(text[at:]))

        for batch in batches:
            yield batch.map(tokens, na_action=None).astype("int64")

    return count


def inserts(rows: DataFrame) -> DataFrame:
    """Changes that add rows (source, lang, tokenizer, tokens)."""
    return rows.select(*GROUP, F.lit(1).cast("bigint").alias("docs"), F.col("tokens").cast("bigint").alias("tokens"))


def deletes(rows: DataFrame) -> DataFrame:
    """Changes that take away rows as they were counted."""
    return rows.select(*GROUP, F.lit(-1).cast("bigint").alias("docs"), (-F.col("tokens")).cast("bigint").alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changes that replace counted rows by new ones, also under another group."""
    return deletes(before).unionByName(inserts(after))


class TokenRollup:
    """A rollup in the folder `path`, which every executor must reach.

    Each batch is a folder of signed group totals.  It is written beside its place and
    renamed, so a batch is there whole or not at all, and whoever commits an id first
    wins; a later commit of the id is dropped.  Null group values form groups of
    their own, a null count adds 0.  Groups whose documents and tokens are both 0 are
    left out of the totals.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/batches"))

    def _place(self, batch_id: str) -> str:
        safe = base64.urlsafe_b64encode(batch_id.encode()).decode().rstrip("=")
        return f"{self.path}/batches/b-{safe}"

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply signed changes (source, lang, tokenizer, docs, tokens) once.  True if this
        call applied them, False if the id was committed before."""
        place = self._Path(self._place(batch_id))
        if self._fs.exists(place):
            return False
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        self._summed(changes).coalesce(1).write.parquet(staged)
        moved = not self._fs.exists(place) and self._fs.rename(self._Path(staged), place)
        if not moved or self._fs.exists(self._Path(f"{place}/{staged.rsplit('/', 1)[1]}")):
            # Another writer came first; a rename onto its folder lands inside it.
            self._fs.delete(self._Path(f"{place}/{staged.rsplit('/', 1)[1]}"), True)
            self._fs.delete(self._Path(staged), True)
            return False
        return True

    @staticmethod
    def _summed(changes: DataFrame) -> DataFrame:
        total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
        return changes.groupBy(*GROUP).agg(total("docs"), total("tokens"))

    def totals(self) -> DataFrame:
        batches = [
            f"{self.path}/batches/{s.getPath().getName()}" for s in self._fs.listStatus(self._Path(f"{self.path}/batches"))
        ]
        if not batches:
            return self.spark.range(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in TOTALS.split(", "))])
        deltas = self.spark.read.schema(TOTALS).parquet(*batches)
        return self._summed(deltas).where("docs <> 0 or tokens <> 0")


def maintain(
    docs: DataFrame, labels: DataFrame, path: str, first: tuple[str, Column],
    second: tuple[str, Column], scratch: Scratch,
) -> DataFrame:
    """A life of a rollup over whole tables.  All documents are inserted under the first
    tokenizer version; those labelled poor are deleted; those labelled good are counted
    again under the second version; the deletes are sent once more.  Returns the totals:
    source, lang, tokenizer, docs, tokens."""
    small_batches(docs.sparkSession)
    counts = scratch.table(
        docs.select("doc_id", "source", "lang", first[1].alias("_first"), second[1].alias("_second"))
    )
    rated = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("_quality")
    )

    def rows(docs: DataFrame, version: str, column: str) -> DataFrame:
        return docs.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(column).alias("tokens"))

    joined = counts.join(rated, "doc_id")
    poor, good = joined.where("_quality = 0"), joined.where("_quality = 1")
    rollup = TokenRollup(docs.sparkSession, path)
    rollup.commit("load", inserts(rows(counts, first[0], "_first")))
    rollup.commit("poor documents", deletes(rows(poor, first[0], "_first")))
    rollup.commit(
        "second version", revisions(rows(good, first[0], "_first"), rows(good, second[0], "_second"))
    )
    rollup.commit("poor documents", deletes(rows(poor, first[0], "_first")))
    return rollup.totals()
