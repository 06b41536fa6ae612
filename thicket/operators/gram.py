"""Several trees' leaves at once: Gram matrices of a leaf basis by aggregation, and what follows from their factorisation.

Rows are counted by the leaves that they are in, then by pairs of leaves; the driver gets a number for each pair, whatever
the rows.  The factorisation eliminates the first tree, whose leaves don't overlap, by division, and what is left by
Cholesky's method.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.forest import Tree, case_leaf, leaves

#: Leaves of all trees together: their Gram matrix goes to the driver (512 MB at most).
MOST_LEAVES = 8192


@dataclass(frozen=True)
class LeafGram:
    """(tree, leaf) of each column, the first tree's columns first; counts of rows in two leaves, sums of y by leaf, the
    sum of its squares and the number of rows."""

    columns: list[tuple[int, int]]
    counts: np.ndarray
    sums: np.ndarray
    squares: float
    rows: int


def leaf_gram(df: DataFrame, forest: list[Tree], x: list[Column], y: Column) -> LeafGram:
    """Of all rows with a y; leaves without rows have a column of zeros, so that they keep their prior."""
    columns = [(k, i) for k, t in enumerate(forest) for i in leaves(t)]
    if len(columns) > MOST_LEAVES:
        raise ValueError(f"{len(columns)} leaves are more than {MOST_LEAVES}")
    at = {c: k for k, c in enumerate(columns)}
    own = F.array(*[F.struct(F.lit(k).alias("t"), case_leaf(t, x).alias("l")) for k, t in enumerate(forest)])
    v = y.cast("double")
    by = df.where(v.isNotNull()).groupBy(own.alias("p")).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    one = by.select(F.explode("p").alias("a"), "p", "n", F.when(F.col("a.t") == 0, F.col("q")).alias("q"), "s")
    pairs = one.select("a", F.explode("p").alias("b"), "n", "s", "q").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    counts, sums, squares = np.zeros((len(columns),) * 2), np.zeros(len(columns)), 0.0
    for r in pairs.collect():
        a, b = at[r["a"]["t"], r["a"]["l"]], at[r["b"]["t"], r["b"]["l"]]
        counts[a, b] = r["n"]
        if a == b:
            sums[a], squares = r["s"], squares + (r["q"] or 0.0)
    rows = int(sum(counts[k, k] for k, (t, _) in enumerate(columns) if t == 0))
    return LeafGram(columns, counts, sums, squares, rows)


def _eliminated(g: LeafGram, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first tree's diagonal, the factor of what its elimination leaves, the right side there, and the first's size."""
    n = sum(t == 0 for t, _ in g.columns)
    first = np.diag(g.counts)[:n] + ridge
    across = g.counts[:n, n:]
    rest = g.counts[n:, n:] + ridge * np.eye(len(g.columns) - n) - across.T @ (across / first[:, None])
    return first, np.linalg.cholesky(rest), g.sums[n:] - across.T @ (g.sums[:n] / first), n


def log_marginal_many(g: LeafGram, sigma2: float, f_sigma2: float) -> float:
    """Gaussian log marginal likelihood of several trees; constants are left out."""
    ridge = sigma2 / f_sigma2
    first, factor, right, n = _eliminated(g, ridge)
    half = np.linalg.solve(factor, right)
    fit = (g.sums[:n] ** 2 / first).sum() + half @ half
    gain = np.log(first / ridge).sum() + 2 * np.log(np.diag(factor)).sum() - len(half) * np.log(ridge)
    return float(-0.5 * (gain + (g.squares - fit) / sigma2))


def leaf_posterior_many(g: LeafGram, sigma2: float, f_sigma2: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior means and variances of all leaves."""
    first, factor, right, n = _eliminated(g, sigma2 / f_sigma2)
    across = g.counts[:n, n:] / first[:, None]
    inverse = np.linalg.solve(factor, np.eye(len(right)))
    rest = inverse.T @ (inverse @ right)
    spread = inverse @ across.T
    mean = np.concatenate([g.sums[:n] / first - across @ rest, rest])
    return mean, sigma2 * np.concatenate([1 / first + (spread**2).sum(axis=0), (inverse**2).sum(axis=0)])
