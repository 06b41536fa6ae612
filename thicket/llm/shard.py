"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and appending a shard moves
only the rows that go to it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import at_once, certainly_named, lean, mix64, place_of, plain, ranked, saved, table, with_columns


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The bucket from 0 to shards - 1 of each 64-bit key."""
    key = keys.astype(np.uint64).copy()
    bucket = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    at = np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = at[live]
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            step = 2147483648.0 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
            at[live] = np.floor((bucket[live] + 1) * step).astype(np.int64)
            live = live[at[live] < shards]
    return bucket.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Struct of the shard of an integer key and its shard with one shard more (grown); a null key counts as key 0."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("shard int, grown int")
    def deal(keys: pd.Series) -> pd.DataFrame:
        mixed = mix64(keys.to_numpy().astype(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": jump(mixed, shards), "grown": jump(mixed, shards + 1)})

    return deal(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", rows_per_block: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    The law is `key`: the key and the number of shards alone decide, so equal keys share a shard and one more
    shard takes rows only into itself.  slot numbers a shard's rows from 0 without gaps in the order of the key
    (nulls first), then checksum and size; rows that agree in all three are alike, and any order of them is
    right.  Null keys count as key 0; a null text has size 1 and checksum 0; texts of any length are read whole.  An
    empty table gives no rows.  Columns other than the key and the text are not read, so their names can't clash.
    """
    both = plain(docs.select(F.col(key).cast("long"), F.col(text)))
    rows = both.select(
        F.col("c0").alias("doc_id"),
        (F.coalesce(F.octet_length("c1"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("c1").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        shard_of(F.col("c0"), shards).alias("d"),
    )
    narrow = saved(rows.select("doc_id", "size", "text_crc32", F.col("d.shard").alias("shard"), F.col("d.grown").alias("grown_shard")), "sizes")
    out = ranked(narrow, "shard", [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")], "slot", rows_per_block)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id", rows_per_block: int | None = None) -> DataFrame:
    """All columns of docs and shard, slot: slot numbers a shard's rows from 0 in the order in which docs was written.

    That order is the number of the part file and the place in it; a table that isn't a selection of the rows of
    Parquet files is saved first.  Ranks are found from the names of rows and the keys alone.  A null key counts as key
    0; repeated rows have slots of their own.  An empty table gives no rows.  Columns of docs may have any names; those
    called shard or slot are replaced.  A row without a slot ends the query: files that changed meanwhile are an error.
    """
    lean(docs.sparkSession)
    rows = certainly_named(plain(docs))
    with_shard = rows.withColumn("d", shard_of(F.col(place_of(docs, key)), shards))
    narrow = saved(with_shard.select("part", "file", "row", F.col("d.shard").alias("shard")), "shards")
    places = saved(ranked(narrow, "shard", [F.col("part"), F.col("file"), F.col("row")], "slot", rows_per_block).select(F.col("file").alias("f"), F.col("row").alias("r"), "shard", "slot"), "slots")
    out = rows.join(at_once(places), (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left")
    lost = F.raise_error("a row has no slot: the files changed while they were read").cast("long")
    return with_columns(out.withColumn("slot", F.coalesce("slot", lost)), docs.columns, shard="shard", slot="slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id") -> None:
    """Writes the rows, all columns, as one folder shard=k for each shard that has rows; a hot shard is written by
    several tasks.  Null keys count as key 0; a column of docs called shard is replaced."""
    out = plain(docs).withColumn("shard", shard_of(F.col(place_of(docs, key)), shards)["shard"])
    with_columns(out, docs.columns, shard="shard").write.partitionBy("shard").parquet(path)


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 8)
