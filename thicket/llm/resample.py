"""Importance resampling towards a target distribution: hashed n-gram features give each document a weight, Gumbel noise
a score, and the documents of the highest scores are drawn, without replacement.

A batch of texts is scored on arrays.  The CRC-32 of an n-gram follows from that of the shorter one before its last
word: appending k bytes is a linear map of the 32 bits, so that no n-gram is ever built.  The eligible rows become
sorted runs, one a partition.  Regular samples of the runs deal all keys to ranges of about equal size, counts of the
runs' slices give the ranks at which ranges begin, and each range that the draw reaches is merged from its slices by a
tournament tree, up to the last rank that is drawn.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import at_once, lean, saved, table, utf8

#: Upper case is made lower, and every ASCII byte that is no letter or digit ends a word.
_AS_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The polynomial of CRC-32, lowest degree in the highest bit.
POLYNOMIAL = 0xEDB88320
#: Appending up to this many bytes goes by tables of 4 KB; longer words are appended by zlib, one by one.
MOST_APPENDED = 48
#: Words whose checksums a task remembers from step to step and their bytes, and bytes of text in one step on arrays.
REMEMBERED_WORDS, REMEMBERED_BYTES, STEP_BYTES = 300_000, 16 << 20, 1 << 20


def appending(most: int) -> np.ndarray:
    """tables[k, j, b]: what byte j of a CRC-32 of value b becomes when k zero bytes are appended (without inversions)."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, (byte >> 1) ^ np.uint32(POLYNOMIAL), byte >> 1).astype(np.uint32)
    tables = np.empty((most + 1, 4, 256), np.uint32)
    for j in range(4):
        tables[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for k in range(1, most + 1):
        tables[k] = byte[tables[k - 1] & 255] ^ (tables[k - 1] >> 8)
    return tables


class Buckets:
    """The buckets of all runs of 1 to `longest` words of texts."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest = buckets, longest
        self.tables = appending(MOST_APPENDED)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known: list[bytes] = []
        self.held = 0
        self.word_sums = self.blank_sums = self.sizes = np.empty(0, np.int64)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """A number for each word; its checksum, that of a blank and the word, and its bytes plus 1 are at that place."""
        number, known = self.number, self.known
        got = np.empty(len(words), np.int64)
        for at, word in enumerate(words):
            k = number.get(word)
            if k is None:
                k = number[word] = len(known)
                known.append(word)
            got[at] = k
        if new := known[len(self.sizes) :]:
            self.held += sum(map(len, new))
            self.word_sums = np.append(self.word_sums, np.fromiter(map(zlib.crc32, new), np.int64, len(new)))
            self.blank_sums = np.append(self.blank_sums, np.fromiter((zlib.crc32(b" " + w) for w in new), np.int64, len(new)))
            self.sizes = np.append(self.sizes, np.fromiter((len(w) + 1 for w in new), np.int64, len(new)))
        return got

    def _append(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Checksums after a blank and a word more."""
        size, t = self.sizes[words], self.tables
        short = np.minimum(size, MOST_APPENDED)
        out = t[short, 0, sums & 255] ^ t[short, 1, sums >> 8 & 255] ^ t[short, 2, sums >> 16 & 255] ^ t[short, 3, sums >> 24]
        out = out.astype(np.int64) ^ self.blank_sums[words]
        for at in np.flatnonzero(size > MOST_APPENDED):
            out[at] = zlib.crc32(b" " + self.known[words[at]], int(sums[at]))
        return out

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Words of each text; then for each length of run the texts that the runs belong to, and the runs' buckets."""
        if len(self.known) > REMEMBERED_WORDS or self.held > REMEMBERED_BYTES:
            self.forget()
        split = [t.translate(_AS_WORDS).split() if t else [] for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        words = self._numbers([w for ws in split for w in ws])
        owner = np.repeat(np.arange(len(split)), n_words)
        owners, found = [], []
        sums, at = self.word_sums[words], np.arange(len(words))
        for n in range(1, self.longest + 1):
            if n > 1:
                whole = (at + n - 1 < len(words)) & (owner[at] == owner[np.minimum(at + n - 1, len(words) - 1)]) if len(words) else np.zeros(0, bool)
                at, sums = at[whole], sums[whole]
                sums = self._append(sums, words[at + n - 1])
            owners.append(owner[at])
            found.append(sums % self.buckets)
        return n_words, owners, found


def steps(column: pa.Array) -> Iterator[list[bytes | None]]:
    """The texts of a batch, about STEP_BYTES at a time and one whole text at least."""
    held, n = [], 0
    for raw in utf8(column):
        held.append(raw)
        n += len(raw or b"") + 64
        if n >= STEP_BYTES:
            yield held
            held, n = [], 0
    if held:
        yield held


def counted(texts: DataFrame, buckets: int, longest: int, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket: counts by task, added up by Spark; `buckets` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Buckets(buckets, longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in steps(batch.column(0)):
                for found in of.of(part)[2]:
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at), "n": pa.array(total[at])})

    rows = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of target to source, each bucket counted once more) of every bucket."""
    s_all, t_all, n = float(source.sum()), float(target.sum()), len(source)
    ratios = (target + 1.0) * (s_all + n) / ((source + 1.0) * (t_all + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios.tolist()], np.int64)


def noise(key: int | None, seed: int) -> int:
    """floor(1000 times a Gumbel variate) that key and seed decide; a null key counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row: a map over the texts."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets, longest)
        for batch in batches:
            keys, n_words, n_features, weights = batch.column(0).to_pylist(), [], [], []
            for part in steps(batch.column(1)):
                words, owners, found = of.of(part)
                features, weight = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
                for owner, at in zip(owners, found, strict=True):
                    own = np.bincount(owner, minlength=len(part))
                    ends = np.cumsum(own)
                    sums = np.append(0, np.cumsum(gain[at]))
                    features += own
                    weight += sums[ends] - sums[ends - own]
                n_words += words.tolist()
                n_features += features.tolist()
                weights += weight.tolist()
            scores = [w + noise(k, seed) for k, w in zip(keys, weights, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, n_words, n_features, weights, scores)], names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCORED)


class Tournament:
    """A tree of losers over sorted runs: the winner is the least head, and its path is replayed when it is taken."""

    def __init__(self, runs: list[list[tuple]]) -> None:
        self.runs, self.places, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [run[0] if run else None for run in runs]
        self.losers = [-1] * max(self.k, 1)
        self.winner = -1
        for run in range(self.k):
            self._enter(run)

    def _beats(self, a: int, b: int) -> bool:
        """A run that is used up beats none."""
        return self.heads[a] is not None and (self.heads[b] is None or self.heads[a] < self.heads[b])

    def _enter(self, run: int) -> None:
        """The first of two that meet at a node waits there; the winner goes on."""
        at = (run + self.k) // 2
        while at:
            if self.losers[at] == -1:
                self.losers[at] = run
                return
            if self._beats(self.losers[at], run):
                self.losers[at], run = run, self.losers[at]
            at //= 2
        self.winner = run

    def take(self, n: int) -> Iterator[tuple]:
        """The next n entries in order, fewer if the runs end before."""
        for _ in range(n):
            if self.k == 0 or self.heads[self.winner] is None:
                return
            run = self.winner
            yield self.heads[run]
            self.places[run] += 1
            self.heads[run] = self.runs[run][self.places[run]] if self.places[run] < len(self.runs[run]) else None
            at = (run + self.k) // 2
            while at:
                if self._beats(self.losers[at], run):
                    self.losers[at], run = run, self.losers[at]
                at //= 2
            self.winner = run


#: Rows of a range on average, and most samples that choose the ranges (32 bytes each, on the driver).
RANGE_ROWS, MOST_SAMPLES = 50_000, 100_000
_KEY = ["down", "id", "row"]


def ranges(runs: DataFrame, rows: int, range_rows: int = RANGE_ROWS) -> np.ndarray:
    """Keys (down, id, row) that begin a range: regular samples of sorted runs.

    No range has more than its share of rows and one step of each run, whatever keys are frequent: the row's name
    is part of the key."""
    wanted = rows // range_rows
    step = max(1, range_rows // 16, rows // MOST_SAMPLES)
    if not wanted:
        return np.empty((0, 3), np.int64)
    # each run offers every step-th row; `at` counts the rows of a run from 0
    got = runs.where((F.col("at").bitwiseAND((1 << 33) - 1) % step) == 0).select(*_KEY).toArrow()
    sample = np.stack([got.column(c).to_numpy() for c in _KEY], axis=1)
    sample = sample[np.lexsort(sample.T[::-1])]
    return sample[[len(sample) * k // (wanted + 1) for k in range(1, wanted + 1)]]


def in_range(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each key the number of ranges that begin at or before it, less the first: its range."""
    both = np.concatenate([starts, keys])
    order = np.lexsort([np.r_[np.zeros(len(starts)), np.ones(len(keys))], *both.T[::-1]])
    before = np.empty(len(both), np.int64)
    before[order] = np.cumsum(order < len(starts))
    return before[len(starts) :]


def drawn(eligible: DataFrame, share: tuple[int, int], range_rows: int = RANGE_ROWS) -> DataFrame:
    """`row` and its rank from 1 of the floor(N * share) highest scores of eligible (doc_id, score, row).

    Ties go to the smaller doc_id, nulls last, then to the smaller row."""
    spark = eligible.sparkSession
    key = eligible.select((-F.col("score")).alias("down"), F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "row")
    runs = saved(key.sortWithinPartitions(*_KEY).withColumn("at", F.monotonically_increasing_id()), "runs")
    rows = runs.count()
    quota = rows * share[0] // share[1]
    if not quota:
        return spark.createDataFrame([], "row long, rank long")
    starts = ranges(runs, rows, range_rows)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(in_range(keys, starts))], names=[*_KEY, "at", "part"])

    parts = runs.mapInArrow(dealt, "down long, id long, row long, at long, part long")
    sizes = np.zeros(len(starts) + 1, np.int64)
    for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect():
        sizes[r["part"]] = r["n"]
    before = np.concatenate([[0], np.cumsum(sizes)])
    last = int(np.searchsorted(before, quota)) - 1  # the range in which the draw ends

    def merged(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        columns = [group.column(c).to_numpy() for c in (*_KEY, "at")]
        order = np.argsort(columns[3])  # the slices of the runs again, one after another
        cuts = np.flatnonzero(np.diff(columns[3][order] >> 33)) + 1
        slices = [list(zip(*(c[at].tolist() for c in columns[:3]), strict=True)) for at in np.split(order, cuts)]
        best = [key[2] for key in Tournament(slices).take(quota - int(before[part]))]
        return pa.table({"row": pa.array(best, pa.int64()), "rank": pa.array(np.arange(1, len(best) + 1) + before[part])})

    return parts.where(F.col("part") <= last).groupBy("part").applyInArrow(merged, "row long, rank long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), seed: int = 42, buckets: int = 10_000, longest: int = 3, least_words: int = 20, key: str = "doc_id", text: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; rank is null for rows that are not drawn.

    Words are runs of ASCII letters, made lower case, digits and characters beyond ASCII; features are the runs of 1 to
    `longest` words.  All texts of docs and of target are counted whole, and floor(N * share) of the N rows with at
    least least_words words are drawn, ties to the smaller doc_id, null ids last.  Null and empty texts have no feature
    and weight 0; rows that are alike have scores alike and ranks of their own, in any order.  A null doc_id draws its
    noise as an empty one.  An empty table gives no rows, an empty target is a uniform one.  Only the key and the text
    are read, so other columns' names can't clash.  The driver gets `buckets` counts, at most 100,000 samples of keys and
    a count a range.
    """
    lean(docs.sparkSession)
    source, wanted = counted(docs, buckets, longest, text), counted(target, buckets, longest)
    rows = saved(scored(docs, gains(source, wanted), longest, seed, key, text).withColumn("row", F.monotonically_increasing_id()), "scores")
    ranks = saved(drawn(rows.where(F.col("n_words") >= least_words).select("doc_id", "score", "row"), share, range_rows).withColumnRenamed("row", "of"), "ranks")
    return rows.join(at_once(ranks), F.col("row") == F.col("of"), "left").select("doc_id", "n_features", "weight", "score", "rank")


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
