"""Rows to the leaves whose box lo < x <= hi they lie in, by an index of cells instead of a loop over all boxes.

A table of tree nodes gives each leaf's box from the splits above it.  Some thresholds of each feature cut the space into
cells; a row lies in one cell and a box in those that it meets, so rows and boxes are joined on equal cells and what
is left is compared exactly.  The choice of cells changes the work only, never the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table of cells and boxes that are sent to all tasks; beyond it, it is joined by shuffle.
BOXES_AT_ONCE = 200_000
#: The most cells, and the most cut points of a feature.
MOST_CELLS, MOST_CUTS = 1 << 16, 255


def _bits(n: Column) -> Column:
    return F.length(F.bin(n))


def leaf_boxes(nodes: DataFrame, keys: list[str], features: int) -> DataFrame:
    """keys, leaf, lo_0, hi_0, lo_1, ...: the box of each leaf of nodes (keys, node, var, thr); null is no bound.

    node numbers a heap, var is negative in leaves.  A leaf's splits are found by its own number, so no tree is walked
    and none has to fit a task.  Boxes that no row can be in (lo >= hi) are left out."""
    place = F.col("leaf") + 1
    leaves = nodes.where("var < 0").select(*keys, F.col("node").cast("long").alias("leaf"))
    steps = leaves.withColumn("__up", F.explode_outer(F.when(F.col("leaf") > 0, F.sequence(F.lit(1), _bits(place) - 1))))
    above = F.floor(place / F.pow(F.lit(2.0), F.col("__up"))).cast("long") - 1
    right = F.floor(place / F.pow(F.lit(2.0), F.col("__up") - 1)).cast("long") % 2 == 1
    path = steps.select(*keys, "leaf", above.alias("__node"), right.alias("__right"))
    splits = nodes.where("var >= 0").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("node").cast("long").alias("__split"), "var", F.col("thr").cast("double").alias("thr"))
    on = F.col("__node") == F.col("__split")
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    bounds = []
    for f in range(features):
        of = lambda side, f=f: F.when((F.col("var") == f) & side, F.col("thr"))
        bounds += [F.max(of(F.col("__right"))).alias(f"lo_{f}"), F.min(of(~F.col("__right"))).alias(f"hi_{f}")]
    made = path.join(splits, on, "left").groupBy(*keys, "leaf").agg(*bounds)
    for f in range(features):
        made = made.where(f"lo_{f} is null or hi_{f} is null or lo_{f} < hi_{f}")
    return made


def _below(value: Column, cuts: list[float], equal: bool) -> Column:
    """The number of cuts below a value, or at most it."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        left = value < cuts[mid] if equal else value <= cuts[mid]
        return F.when(left, search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts))


def _crossed(cells: Column, parts: Column, size: int) -> Column:
    """The cells of one feature more."""
    return F.flatten(F.transform(cells, lambda a: F.transform(parts, lambda c: a * size + c)))


@dataclass(frozen=True)
class Cells:
    """Cut points of each feature."""

    cuts: list[list[float]]

    @staticmethod
    def of(boxes: DataFrame, features: int, cells: int | None = None) -> Cells:
        """About `cells` cells (twice the boxes' number by default) from quantiles of the boxes' bounds, more for features
        that bound more boxes; one aggregation."""
        both = [F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"{side}_{f}").alias("v")) for f in range(features) for side in ("lo", "hi")))).alias("b")]
        shares = [k / (MOST_CUTS + 1) for k in range(1, MOST_CUTS + 1)]
        bounds = boxes.select(*both).where("b.v is not null").groupBy("b.f").agg(F.count("*").alias("n"), F.percentile_approx("b.v", shares).alias("q")).collect()
        wanted = min(MOST_CELLS, cells or 2 * max(1, boxes.count()))
        cuts: list[list[float]] = [[] for _ in range(features)]
        rest, left = math.log2(wanted), sum(math.log2(1 + r["n"]) for r in bounds)
        for r in sorted(bounds, key=lambda r: (r["n"], r["f"])):
            share = rest * math.log2(1 + r["n"]) / left
            n = min(MOST_CUTS, round(2**share) - 1)
            picked = sorted({r["q"][(k + 1) * MOST_CUTS // (n + 1)] for k in range(n)}) if n > 0 else []
            cuts[r["f"]] = picked
            rest, left = rest - math.log2(1 + len(picked)), left - math.log2(1 + r["n"])
        return Cells(cuts)

    def of_row(self, x: list[Column]) -> Column:
        cell = F.lit(0).cast("long")
        for value, cuts in zip(x, self.cuts, strict=True):
            cell = cell * (len(cuts) + 1) + _below(value, cuts, False)
        return cell

    def of_box(self) -> Column:
        """All cells that a box meets."""
        found = F.array(F.lit(0).cast("long"))
        for f, cuts in enumerate(self.cuts):
            lo, hi = F.col(f"lo_{f}"), F.col(f"hi_{f}")
            first = F.when(lo.isNull(), 0).otherwise(_below(lo, cuts, True))
            last = F.when(hi.isNull(), len(cuts)).otherwise(_below(hi, cuts, False))
            found = _crossed(found, F.sequence(first, last), len(cuts) + 1)
        return found


def join_boxes(rows: DataFrame, x: list[Column], boxes: DataFrame, cells: int | None = None) -> DataFrame:
    """rows joined with the boxes that they lie in: all columns of both but the bounds.

    `boxes` has lo_f and hi_f for each column of x, null where there is no bound.  A null or NaN in x is above every
    bound, as in a tree, whose split it passes on the right.  Repeated rows and boxes are joined on their own; without
    rows or boxes there is no result.  The boxes are read three times; with their cells they are sent to all tasks if
    they are few, and joined by shuffle otherwise, where adaptive execution splits a cell of very many rows.
    """
    own = [c for c in boxes.columns if c not in {f"{s}_{f}" for s in ("lo", "hi") for f in range(len(x))}]
    index = Cells.of(boxes, len(x), cells)
    values = [F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in x]
    placed = rows.withColumns({f"__x{f}": c for f, c in enumerate(values)}).withColumn("__cell", index.of_row([F.col(f"__x{f}") for f in range(len(x))]))
    met = boxes.withColumn("__met", F.explode(index.of_box()))
    few = met.limit(BOXES_AT_ONCE + 1).count() <= BOXES_AT_ONCE
    on = F.col("__cell") == F.col("__met")
    for f in range(len(x)):
        lo, hi, v = F.col(f"lo_{f}"), F.col(f"hi_{f}"), F.col(f"__x{f}")
        on = on & (lo.isNull() | (v > lo)) & (hi.isNull() | (v <= hi))
    return placed.join(F.broadcast(met) if few else met, on).select(*rows.columns, *own)
