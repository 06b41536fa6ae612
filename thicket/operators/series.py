"""Long series over many tasks: running sums, places, moving means, smoothing and lags within a series.

A window over a series is one task, however long the series is.  Here it is cut into blocks of its order, so that a task
holds a block and what it needs of the neighbours:

* running sums: each block gets a header row with the sum of all blocks before it, from a table of block totals;
* windows of some rows to either side: blocks are cut by place, and rows near a border are copied to the next block.

The rows themselves are shuffled once for each of the two, whatever the keys and however hot one of them is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block on average, and the most blocks that an order is cut into.
BLOCK_ROWS, MOST_BLOCKS = 200_000, 1024


def cuts(df: DataFrame, order: str, block_rows: int = BLOCK_ROWS) -> list:
    """Values of `order` that cut the rows into about equal blocks, from one aggregation; none for a few rows.

    Only numbers, dates and times are cut; any other order is one block for each key."""
    if not isinstance(df.schema[order].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return []
    shares = [k / MOST_BLOCKS for k in range(1, MOST_BLOCKS)]
    found = df.agg(F.count("*").alias("n"), F.percentile_approx(order, shares).alias("q")).first()
    blocks = min(MOST_BLOCKS, -(-found["n"] // block_rows))
    picked = [found["q"][k * MOST_BLOCKS // blocks - 1] for k in range(1, blocks)] if found["q"] else []
    return list(dict.fromkeys(v for v in picked if v == v))


def block_of(order: Column, bounds: list) -> Column:
    """The number of bounds below a value: nulls are in the first block, NaN in the last, as they are sorted."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(order <= F.lit(bounds[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(order.isNull(), F.lit(0)).otherwise(search(0, len(bounds))) if bounds else F.lit(0)


def running_sums(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], totals: dict[str, Column] | None = None, peers: dict[str, Column] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with running sums (name: what is summed) within keys up to and including each row, with `totals` of whole
    keys, and with `peers`, sums up to and including all rows of the same order.

    Rows of one key and order come in any order, in one block.  A sum is null until there is a value that isn't; null
    keys are a key of their own.  An empty table gives no rows.  df is read three times, so it has to be the same each
    time.  Block totals are one row for each key and block, and only those of a key meet in one task.
    """
    totals, peers = totals or {}, peers or {}
    summed = sums | peers
    bounds = cuts(df, order, block_rows)
    sort = F.col(order).asc_nulls_first()
    if not bounds:
        w = Window.partitionBy(*keys).orderBy(sort)
        up, peer = w.rowsBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        made = {n: F.sum(c).over(up) for n, c in sums.items()} | {n: F.sum(c).over(peer) for n, c in peers.items()}
        return df.withColumns(made | {n: F.sum(c).over(Window.partitionBy(*keys)) for n, c in totals.items()})
    values = {f"__s{k}": c for k, c in enumerate(summed.values())}
    whole = {f"__t{k}": c for k, c in enumerate(totals.values())}
    rows = df.withColumns({"__block": block_of(F.col(order), bounds)} | values | whole)
    by = rows.groupBy(*keys, "__block").agg(*[F.sum(c).alias(c) for c in (*values, *whole)])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    header = by.select(*keys, "__block", *[F.sum(c).over(before).alias(c) for c in values], *[F.sum(c).over(Window.partitionBy(*keys)).alias(c) for c in whole], F.lit(0).alias("__row"))
    both = rows.withColumns({c: F.lit(None) for c in whole} | {"__row": F.lit(1)}).unionByName(header, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "__block").orderBy("__row", sort)
    up, peer = w.rowsBetween(Window.unboundedPreceding, 0), w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    made = {n: F.sum(v).over(up if n in sums else peer) for n, v in zip(summed, values, strict=True)}
    made |= {n: F.max(v).over(up) for n, v in zip(totals, whole, strict=True)}
    return both.withColumns({f"__m{k}": c for k, c in enumerate(made.values())}).where("__row = 1").select(*df.columns, *[F.col(f"__m{k}").alias(n) for k, n in enumerate(made)])


def places(df: DataFrame, keys: list[str], order: str, out: str = "place", size: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with the place from 0 of each row within its keys and, if named, the number of the keys' rows."""
    one = F.lit(1).cast("long")
    made = running_sums(df, keys, order, {out: one}, {size: one} if size else None, block_rows=block_rows)
    return made.withColumn(out, F.col(out) - 1)


def _spread(df: DataFrame, place: str, before: int, after: int, block_rows: int, least: int) -> DataFrame:
    """Each row in its own block of places (__own) and in those that it is within reach of."""
    at = F.col(place) - least
    block = lambda c: F.floor(c / block_rows)
    return df.withColumn("__block", F.explode(F.sequence(F.greatest(block(at - after), F.lit(0)), block(at + before)))).withColumn("__own", F.col("__block") == block(at))


def over_neighbours(df: DataFrame, keys: list[str], place: str, before: int, after: int, made: Callable[[Window], dict[str, Column]], block_rows: int = BLOCK_ROWS, least: int = 0) -> DataFrame:
    """df with columns made over windows that look at most `before` rows back and `after` rows ahead; `place` numbers the
    rows of a key without gaps, from `least` on.

    Blocks are cut by place; a row goes to its own and to those whose border is that near."""
    spread = _spread(df, place, before, after, block_rows, least)
    w = Window.partitionBy(*keys, "__block").orderBy(place)
    columns = made(w)
    return spread.withColumns(columns).where("__own").select(*df.columns, *columns)


def moving_average(df: DataFrame, keys: list[str], order: str, value: str, width: int, out: str = "smooth", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred mean over an odd width that shrinks at the edges.  Null values don't count; rows of one key and order
    come in any order; an empty table gives no rows."""
    if width % 2 == 0:
        raise ValueError("the width must be odd")
    half = width // 2
    placed = places(df, keys, order, "__i", block_rows=block_rows)
    if isinstance(df.schema[value].dataType, T.DecimalType):
        return over_neighbours(placed, keys, "__i", half, half, lambda w: {out: F.avg(value).over(w.rowsBetween(-half, half))}, block_rows).drop("__i")
    # a window is the end of one segment of `width` rows and the beginning of the next: two running sums, whatever the width
    own = placed.withColumn("__seg", F.floor(F.col("__i") / width))
    w, v = Window.partitionBy(*keys, "__seg"), F.col(value).cast("double")
    up, down = (w.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("__i").asc(), F.col("__i").desc()))
    sums = lambda frame: F.struct(F.col("__seg").alias("seg"), F.coalesce(F.sum(v).over(frame), F.lit(0.0)).alias("s"), F.count(v).over(frame).alias("n"))
    own = own.withColumns({"__head": sums(up), "__tail": sums(down)})

    def ends(w: Window) -> dict[str, Column]:
        last = F.last("__head").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return {"__a": F.lag("__tail", half).over(w), "__z": F.coalesce(F.lead("__head", half).over(w), last)}

    made = over_neighbours(own, keys, "__i", half, half, ends, block_rows)
    a, z = F.col("__a"), F.col("__z")
    # without a row that far back the window begins with the first segment; within one segment the end is all of it
    pick = lambda f: F.when(a.isNull(), z[f]).when(a["seg"] == z["seg"], a[f]).otherwise(a[f] + z[f])
    return made.withColumn(out, F.try_divide(pick("s"), pick("n"))).select(*df.columns, out)


def gaussian_smooth(df: DataFrame, keys: list[str], order: str, value: str, sigma: float, out: str = "smooth", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Gaussian weights up to four deviations, the series reflected at its edges, as often as a short one needs.

    Null values count as 0; rows of one key and order come in any order; an empty table gives no rows."""
    reach = int(4 * sigma + 0.5)
    weight = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    placed = places(df, keys, order, "__i", "__n", block_rows)
    # the row of place i stands at i + 2 n m and, mirrored, at 2 n m - 1 - i, wherever that is within reach of the series
    i, n = F.col("__i"), F.col("__n")
    turns = F.ceil((n + reach) / (2 * n)).cast("long")
    at = F.transform(F.sequence(-turns, turns), lambda m: F.array(i + 2 * n * m, 2 * n * m - 1 - i))
    spread = placed.withColumn("__p", F.explode(F.filter(F.flatten(at), lambda p: (p >= -reach) & (p < n + reach))))
    dot = lambda seen: F.aggregate(F.zip_with(seen, F.array(*map(F.lit, weight)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    near = lambda w: {out: dot(F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(0.0))).over(w.rowsBetween(-reach, reach))) / F.lit(sum(weight))}
    made = over_neighbours(spread, keys, "__p", reach, reach, near, block_rows, -reach)
    return made.where(F.col("__p") == F.col("__i")).select(*df.columns, out)


def lag_sums(df: DataFrame, keys: list[str], place: str, value: str, lags: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, lag, n, now, before, now2, before2, both) for lags 1 to `lags`: sums over the pairs of a value and the one
    `lag` places before it, n their number, now2 and before2 sums of squares, both of products.

    Rows are packed into blocks with the `lags` values before them, once for all lags.  A block's sums come from products
    of Fourier transforms, so values should be centred.  A pair with a null doesn't count; a lag without pairs has n = 0.
    """
    spread = _spread(df.select(*keys, place, F.col(value).cast("double").alias("__v")), place, max(lags, 1), 0, block_rows, 0)
    packed = spread.groupBy(*keys, "__block").agg(F.min(F.when(F.col("__own"), F.col(place))).alias("__first"), F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col("__v").alias("v")))).alias("__all"))
    blocks = packed.where("__first is not null").select(*keys, (F.col("__first") - F.element_at("__all", 1)["p"]).alias("__from"), F.col("__all.v").alias("__v"))
    schema = T.StructType([df.schema[k] for k in keys]).add("lag", T.IntegerType()).add("n", T.LongType())
    for c in ("now", "before", "now2", "before2", "both"):
        schema = schema.add(c, T.DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                first, values = batch.column(len(keys))[at].as_py(), batch.column(len(keys) + 1)[at].values
                found = _pair_sums(np.asarray(values.fill_null(np.nan), dtype=float), first, lags)
                own = [batch.column(k).take(pa.array([at] * lags)) for k in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(range(1, lags + 1), pa.int32()), pa.array(np.rint(found[0]).astype(np.int64)), *map(pa.array, found[1:])], names=schema.names)

    return blocks.mapInArrow(run, schema).groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in schema.names[len(keys) + 1 :]])


def _pair_sums(v: np.ndarray, first: int, lags: int) -> np.ndarray:
    """n, now, before, now2, before2 and both, by lag, of the pairs of v[i], i >= first, with v[i - lag]."""
    size = 1 << (len(v) + lags).bit_length()
    there = ~np.isnan(v)
    x = np.where(there, v, 0.0)
    own = np.arange(len(v)) >= first
    a, a2, m = (np.fft.rfft(np.where(own, z, 0.0), size) for z in (x, x * x, there.astype(float)))
    b, b2, n = (np.conj(np.fft.rfft(z, size)) for z in (x, x * x, there.astype(float)))
    return np.stack([np.fft.irfft(p, size)[1 : lags + 1] for p in (m * n, a * n, m * b, a2 * n, m * b2, a * b)])
