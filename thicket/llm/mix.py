"""Mixing sources to target weights by Pfair scheduling (Baruah et al., 1996): each block of a source has a release
time and a deadline from the source's weight, and earliest deadline first interleaves the sources so that after
any number of slots each has had its share to within less than one block."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import at_once, certainly_named, lean, place_of, plain, ranked, saved, table, with_columns


def units(weights: dict[str, float], total: int) -> dict[str, int]:
    """Whole shares of `total`, at least 1 each, by largest remainder."""
    whole = sum(weights.values())
    exact = {s: max(Fraction(w) / Fraction(whole) * total, Fraction(1)) for s, w in weights.items()}
    scale = Fraction(total) / sum(exact.values())
    exact = {s: x * scale for s, x in exact.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) >= total:
            break
        out[s] += 1
    while sum(out.values()) > total:
        out[max(out, key=lambda s: (out[s], s))] -= 1
    return out


def paced(shares: dict[str, int], slots: int, left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """The slots of each source by earliest deadline first, until `slots` are filled or a source has none `left`.

    Block j of a source with share n of D is released at floor((j - 1) D / n) and due at ceil(j D / n).
    """
    total = sum(shares.values())
    waiting = [(0, -(-total // n), s, 1) for s, n in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out: dict[str, list[int]] = {s: [] for s in shares}
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        due, s, j = heapq.heappop(ready)
        assert slot < due, "a deadline was missed"
        out[s].append(slot)
        if left is not None and j == left[s]:
            break
        n = shares[s]
        heapq.heappush(waiting, (j * total // n, -(-(j + 1) * total // n), s, j + 1))
    return out


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source in one period of sum(shares) slots; the schedule repeats after it."""
    return paced(shares, sum(shares.values()))


def exact(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the very proportions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in parts.values()))
    return {s: int(x * scale) for s, x in parts.items()}


@dataclass
class Plan:
    """For each source the phases in which it has blocks: first block, first slot, slots in a period, period."""

    phases: dict[str, list[tuple[int, int, np.ndarray, int]]] = field(default_factory=dict)
    weights: list[dict[str, float]] = field(default_factory=list)

    def slots(self, source: str, blocks: np.ndarray) -> np.ndarray:
        parts = self.phases[source]
        firsts = np.array([p[0] for p in parts])
        which = np.searchsorted(firsts, blocks, side="right") - 1
        out = np.zeros(len(blocks), dtype=np.int64)
        for k in np.unique(which):
            first, start, places, total = parts[k]
            own = which == k
            turn, place = np.divmod(blocks[own] - first, len(places))
            out[own] = start + turn * total + places[place]
        return out


def schedule(blocks: dict[str, int], weights: dict[str, float], resolution: int | None = None) -> Plan:
    """The slot of every block of every source.

    A phase lasts until some source has no block left; the weights of the others are then scaled up to 1.  Every
    block of a phase is placed by the weights as they are: the work and the plan (8 bytes a block) grow with the blocks.
    With a `resolution`, weights are rounded to whole shares of that many slots (or ten a source) and one period of
    each phase is simulated; a source can then leave its target by more than a block.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    plan = Plan({s: [] for s in left})
    start = 0
    while left:
        own = {s: weights[s] for s in left}
        if resolution is None:
            shares = exact(own)
            total = sum(shares.values())
            places = {s: np.array(p, dtype=np.int64) for s, p in paced(shares, sum(left.values()), left).items()}
            used = {s: len(p) for s, p in places.items()}
            end, turn = sum(used.values()), sum(left.values())
        else:
            total = turn = max(resolution, 10 * len(left))
            shares = units(own, total)
            places = {s: np.array(p, dtype=np.int64) for s, p in period(shares).items()}
            end = min((left[s] - 1) // shares[s] * total + int(places[s][(left[s] - 1) % shares[s]]) + 1 for s in left)
            used = {s: end // total * shares[s] + int(np.searchsorted(places[s], end % total)) for s in left}
        plan.weights.append({s: n / total for s, n in shares.items()})
        for s, n in used.items():
            plan.phases[s].append((blocks[s] - left[s], start, places[s], turn))
            left[s] -= n
            if left[s] == 0:
                del left[s]
        start += end
    return plan


def _labelled(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


#: Blocks whose slots are sent to all tasks (8 bytes each); the slots of more are written as a table and joined.
BLOCKS_AT_ONCE = 1_000_000


def _slots(placed: DataFrame, sizes: dict[str, int], weights: dict[str | None, float] | None, block_rows: int, power: float) -> DataFrame:
    """placed (source, rank and more) with block, place and slot."""
    blocks = {s: -(-n // block_rows) for s, n in sizes.items()}
    if weights is None:
        plans = [schedule(blocks, {s: float(n) ** power for s, n in sizes.items()})]
    else:
        given = {"-" if s is None else f"={s}": float(w) for s, w in weights.items() if w and w > 0}
        plans = [schedule({s: n for s, n in blocks.items() if s in given}, given), schedule({s: n for s, n in blocks.items() if s not in given}, {s: float(n) for s, n in sizes.items()})]
    late = sum(blocks[s] for s in plans[0].phases)

    def found(name: str, at: np.ndarray) -> np.ndarray:
        first = name in plans[0].phases
        return plans[0 if first else 1].slots(name, at) + (0 if first else late)

    out = placed.withColumn("block", F.floor(F.col("rank") / block_rows).cast("long")).withColumn("place", (F.col("rank") % block_rows).cast("long")).drop("rank")
    if sum(blocks.values()) <= BLOCKS_AT_ONCE:

        @F.pandas_udf("long")
        def slot_of(s: pd.Series, b: pd.Series) -> pd.Series:
            slots = np.zeros(len(s), dtype=np.int64)
            for name, at in s.groupby(s).indices.items():
                slots[at] = found(name, b.to_numpy()[at])
            return pd.Series(slots)

        return out.withColumn("slot", slot_of("source", "block"))
    spark, path = placed.sparkSession, None
    for name, n in blocks.items():
        for first in range(0, n, BLOCKS_AT_ONCE):
            at = np.arange(first, min(n, first + BLOCKS_AT_ONCE), dtype=np.int64)
            part = spark.createDataFrame(pa.table({"of": pa.array([name] * len(at)), "at": at, "slot": found(name, at)}))
            if path is None:
                path = saved(part, "plan").inputFiles()[0].rsplit("/", 1)[0]
            else:
                part.write.mode("append").option("compression", "zstd").parquet(path)
    plan = spark.read.schema("of string, at long, slot long").parquet(path)
    return out.join(plan, (F.col("source") == F.col("of")) & (F.col("block") == F.col("at"))).drop("of", "at")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 32, power: float = 0.5, source: str = "source", key: str = "doc_id", rows_per_block: int | None = None) -> DataFrame:
    """All columns of docs and block, slot, place: the block of the row in its source, the block's slot in the
    interleaved order, and the row's place in the block.

    Every row is placed once.  Without weights, a source's weight is its number of rows to `power`; sources that
    weights leaves out, or gives no positive weight, follow after the others by their rows.  Rows of a source go
    into blocks in the order of the key, nulls first, rows of one key in the order of the scan; repeated rows are
    alike, and any order of them is right.  A null source is a source of its own.  An empty table gives no rows.
    Columns of docs may have any names; those called block, slot or place are replaced.  The whole rows are dealt by
    range and saved: give the narrow columns, or use mixed_order.  The number of sources is taken to be small: their
    sizes go to the driver, which places the blocks one after another.
    """
    own = plain(docs).withColumns({"source": _labelled(F.col(place_of(docs, source))), "key": F.col(place_of(docs, key)).cast("long")})
    rows = saved(own, "rows")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}
    placed = ranked(rows, "source", [F.col("key").asc_nulls_first()], "rank", rows_per_block)
    return with_columns(_slots(placed, sizes, weights, block_rows, power), docs.columns, block="block", slot="slot", place="place")


def mixed_order(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = 32, power: float = 0.5, source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of docs, all columns, written in the order of the mixture: a range sort over (slot, place).

    Places are found as by `mix` from the names of rows, sources and keys alone, so that whole rows are moved for the
    sort only.  What is not a selection of rows of Parquet files is saved first.  A null source is a source of its own,
    null keys come first, rows of one key in the order of the files, and repeated rows have places of their own.  An
    empty table gives no rows.  Columns may have any names.  A row without a place ends the query: files that
    changed between the two scans are an error, not a loss.
    """
    lean(docs.sparkSession)
    rows = certainly_named(plain(docs))
    narrow = saved(rows.select("file", "row", "part", _labelled(F.col(place_of(docs, source))).alias("source"), F.col(place_of(docs, key)).cast("long").alias("key")), "names")
    sizes = {r["source"]: r["n"] for r in narrow.groupBy("source").agg(F.count("*").alias("n")).collect()}
    placed = ranked(narrow, "source", [F.col("key").asc_nulls_first(), F.col("part"), F.col("file"), F.col("row")], "rank")
    found = _slots(placed, sizes, weights, block_rows, power).select(F.col("file").alias("f"), F.col("row").alias("r"), "slot", "place")
    places = saved(found, "places")
    out = rows.join(at_once(places), (F.col("file") == F.col("f")) & (F.col("row") == F.col("r")), "left")
    lost = F.raise_error("a row has no place: the files changed while they were read").cast("long")
    ordered = out.withColumn("slot", F.coalesce("slot", lost)).orderBy("slot", "place")
    return ordered.select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "block", "slot", "place")
