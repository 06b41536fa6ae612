"""The corpus pipeline: five stages, each an operator of thicket.llm applied to what its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's docs.  All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import saved, table
from thicket.llm.decontaminate import decontaminated
from thicket.llm.jaccard import one_of_each
from thicket.llm.mix import mixed_order
from thicket.llm.quality import filter_quality
from thicket.llm.shard import sharded

SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on weak labels of these documents, rejects go.

    Null and empty texts are judged as texts without words, texts of any length whole; repeated rows go or stay
    together, ties at the threshold stay.  An empty table gives no rows; columns may have any names."""
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more stays.

    It is the first as the rows are read.  Null, empty and blank texts have no group and all stay; of repeated rows
    one stays.  Texts are read whole.  An empty table gives no rows; columns may have any names."""
    return one_of_each(docs, n=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of the five-word shingles of a benchmark item go.

    Null and empty texts stay, on either side they match nothing; repeated rows go or stay together.  Texts are read
    whole.  An empty table gives no rows, an empty benchmark leaves all; columns may have any names."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order in which Pfair scheduling interleaves their sources.

    A null source is a source of its own.  Rows of a source come by doc_id, nulls first, those of one id (repeated
    rows too) in the order of the files.  Texts are not looked at.  An empty table gives no rows; columns may have any
    names."""
    return mixed_order(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard, and their slot in it in the order in which the mixture was written.

    A null doc_id counts as 0; repeated rows share a shard and have slots of their own.  Texts are not looked at.  An
    empty table gives no rows; columns may have any names, but shard and slot are replaced."""
    return sharded(docs, SHARDS)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark), ("mixing sources", mixture), ("sharding", shards)]

#: SQL can't express the trained classifier of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to `documents`."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = saved(docs, f"stage-{at}")
    return docs.select("doc_id", "source", F.col("shard"), F.col("slot"))
