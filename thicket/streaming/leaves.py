"""Leaf counts and sums of a stream: mergeable partial sums, appended batch by batch and compacted now and then.

A batch writes its partial sums under its own number, so that a batch that runs again after a failure replaces what it had
written: each row counts once.  No state grows with the rows, and nothing runs in Python.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class LeafSums:
    """Sums by keys in a folder: `base-k`, the sums of all batches up to k, and `batch-k`, one for each batch after it.

    `sums` are (name: what is summed); `n` counts rows.  `compact_every` batches become one base; the folders that it
    replaces stay until the next base, for readers that have listed them."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], sums: dict[str, Column], compact_every: int = 16) -> None:
        self.spark, self.path, self.keys, self.sums, self.every = spark, path, keys, sums, compact_every
        self._root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def partial(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for k, c in self.sums.items()])

    def merged(self, parts: DataFrame) -> DataFrame:
        """The sums of partial sums; null where no row had a value."""
        return parts.groupBy(*self.keys).agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in self.sums])

    def append(self, rows: DataFrame, batch: int) -> None:
        """What foreachBatch calls.  A batch that a base holds already is left out."""
        base, later = self._found()
        if base is not None and batch <= base:
            return
        self._write(self.partial(rows), f"batch-{batch}")
        later = sorted({*later, batch})
        if len(later) >= self.every:
            self._write(self.merged(self._parts(base, later)), f"base-{later[-1]}")
            self._clear(base, later[-1])

    def read(self) -> DataFrame | None:
        """The sums of all batches; None before the first."""
        base, later = self._found()
        return None if base is None and not later else self.merged(self._parts(base, later))

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        """A query that appends a stream's batches; with the same checkpoint it goes on after a restart."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def _write(self, df: DataFrame, name: str) -> None:
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}")

    def _parts(self, base: int | None, later: list[int]) -> DataFrame:
        names = [*([] if base is None else [f"base-{base}"]), *(f"batch-{k}" for k in later)]
        return self.spark.read.parquet(*(f"{self.path}/{n}" for n in names))

    def _listed(self) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {"base": [], "batch": []}
        for status in self._fs.listStatus(self._root) if self._fs.exists(self._root) else []:
            kind, _, number = status.getPath().getName().partition("-")
            whole = self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
            if kind in out and number.isdigit() and whole:  # a folder that a failed write left isn't read
                out[kind].append(int(number))
        return out

    def _found(self) -> tuple[int | None, list[int]]:
        listed = self._listed()
        base = max(listed["base"], default=None)
        return base, sorted(k for k in listed["batch"] if base is None or k > base)

    def _clear(self, kept: int | None, new: int) -> None:
        """Removes what was replaced before the last base, and keeps what the new one replaces."""
        for kind, numbers in self._listed().items():
            for k in numbers:
                if kept is not None and (k < kept if kind == "base" else k <= kept) and k != new:
                    self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}-{k}"), True)

    def describe(self) -> str:
        base, later = self._found()
        return json.dumps({"base": base, "batches": later})
