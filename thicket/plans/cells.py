"""Rows counted by cells: those that no cut of a feature tells apart are one cell, with their number and the sums of their
targets.  A chain over cells is the chain over the rows, and its memory is bounded by the numbers of cuts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.forest import vectors
from thicket.plans.chain import CountedChain, CountedLogisticChain, Settings
from thicket.plans.summed import Grid, SummedChain, suits

#: Bits of a target, and of each half of it whose whole-number sums are exact.
BITS, HALF = 52, 26


def all_cuts(thresholds: list, trees: list | None = None) -> list[np.ndarray]:
    """The thresholds of each feature and those of the given trees, which are lists of (node, var, thr, leaf)."""
    found = [set(map(float, t)) for t in thresholds]
    for nodes in trees or []:
        for n in nodes:
            if n[1] >= 0:
                found[int(n[1])].add(float(n[2]))
    return [np.array(sorted(f), dtype=float) for f in found]


def sizes(cuts: list[list[np.ndarray]]) -> list[int]:
    """How many codes each feature has, for the most cuts that a model has on it."""
    return [max(map(len, own), default=0) + 1 for own in zip(*cuts, strict=True)]


def _words(codes: list[int]) -> list[list[int]]:
    """Features by the long that holds their codes."""
    out, size = [], 1 << 62
    for k, n in enumerate(codes):
        if size * n >= 1 << 62:
            out.append([])
            size = 1
        out[-1].append(k)
        size *= n
    return out


def coded(rows: DataFrame, cuts: list[np.ndarray] | dict[str, list[np.ndarray]], x: str = "x", of: str | None = None) -> tuple[DataFrame, list[str]]:
    """rows with longs for the number of cuts below each feature instead of x, so that a value is at most a cut where its
    code is at most the cut's place.  NaN is above all.  With `of`, a string column, a row has the cuts of its own model."""
    by = {None: cuts} if of is None else cuts
    codes = sizes(list(by.values()))
    words, at = _words(codes), rows.columns.index(x)
    model = None if of is None else rows.columns.index(of)
    names = [f"__k{i}" for i in range(len(words))]
    keep = [c for c in rows.columns if c != x]
    schema = rows.drop(x).withColumns({n: F.lit(0).cast("long") for n in names}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = vectors(batch.column(at))
            made = np.zeros((len(words), batch.num_rows), dtype=np.int64)
            own = {None: slice(None)} if model is None else {name: np.array(v) for name, v in pd.Series(batch.column(model).to_pylist()).groupby(batch.column(model).to_pylist()).indices.items()}
            for name, some in own.items():
                for i, word in enumerate(words):
                    for k in word:
                        made[i, some] = made[i, some] * codes[k] + np.searchsorted(by[name][k], z[some, k], "left")
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *map(pa.array, made)], names=[*keep, *names])

    return rows.mapInArrow(run, schema), names


def codes_of(keys: np.ndarray, codes: list[int]) -> np.ndarray:
    """For each row of keys, the number of cuts below each feature."""
    out = np.empty((len(keys), len(codes)), dtype=np.int64, order="F")
    for i, word in enumerate(_words(codes)):
        left = keys[:, i].copy()
        for k in reversed(word):
            left, out[:, k] = np.divmod(left, codes[k])
    return out


def points(keys: np.ndarray, cuts: list[np.ndarray], codes: list[int] | None = None) -> np.ndarray:
    """A row for each row of keys that lies on the same side of every cut as the rows of its cell."""
    code = codes_of(keys, codes or sizes([cuts]))
    out = np.empty((len(keys), len(cuts)), order="F")
    for k, own in enumerate(cuts):
        out[:, k] = np.append(own, np.inf)[code[:, k]]
    return out


def counted(rows: DataFrame, by: list[str], scale: float) -> DataFrame:
    """n, and the sums of y and of its square as two whole numbers each (see `total`); |y| is at most `scale`.  These sums
    are exact, so that they don't depend on how the rows are dealt."""

    def halves(v, name: str) -> list:
        whole = F.round(v * F.lit(2.0**BITS)).cast("long")
        return [F.sum(F.shiftright(whole, HALF)).alias(f"{name}_high"), F.sum(whole.bitwiseAND(F.lit((1 << HALF) - 1))).alias(f"{name}_low")]

    z = F.col("y") / F.lit(scale)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *halves(z, "s"), *halves(z * z, "q"))


def total(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The sums whose halves `counted` gives, in units of the scale (or of its square)."""
    return high * 2.0 ** (HALF - BITS) + low * 2.0**-BITS


def sigma_guesses(rows: DataFrame, by: str, features: int) -> dict[int, float]:
    """For each value of `by` the deviation of y from its least squares on 1 and x, from centred sums of products."""
    z = [F.get("x", k) for k in range(features)] + [F.col("y")]
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    c = [v - F.lit(mean[f"m{i}"]) for i, v in enumerate(z)]
    d = len(z)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs])
    out = {}
    for r in sums.collect():
        s = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        cov = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"] - np.outer(s, s)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        sd[sd == 0] = 1.0
        cor = cov / np.outer(sd, sd)
        values, axes = np.linalg.eigh(cor[:-1, :-1])
        keep = values > 1e-12 * max(values.max(), 1e-300)
        gain = (axes[:, keep].T @ cor[:-1, -1]) ** 2 / values[keep]
        out[r[by]] = float(f"{float(sd[-1] * np.sqrt(max(cor[-1, -1] - gain.sum(), 0.0))):.9g}")
    return out


def chain_of(g: pd.DataFrame, names: list[str], cuts: list[np.ndarray], kind: str, thresholds: list[np.ndarray], s: Settings, seed, categories: int, scale: float, guess: float | None, codes: list[int] | None = None) -> tuple[np.ndarray | Grid, CountedChain | CountedLogisticChain]:
    """The points of counted cells (many of them: their grid) and the chain over them.  A regression has the sums of `counted`,
    a classifier a row for each cell and class.  Without a guess of the deviation that of the targets is taken."""
    g = g.sort_values(names if kind == "regression" else [*names, "y"], ignore_index=True)
    keys, n = np.column_stack([g[c].to_numpy() for c in names]), g["n"].to_numpy(dtype=float)
    if kind == "regression":
        y, q = (total(g[f"{c}_high"].to_numpy(dtype=float), g[f"{c}_low"].to_numpy(dtype=float)) for c in "sq")
        if guess is None:
            guess = scale * math.sqrt(max(float(q.sum() / n.sum() - (y.sum() / n.sum()) ** 2), 0.0))
        if suits(cuts, len(keys)):
            chain = SummedChain(codes_of(keys, codes or sizes([cuts])), n, scale * y, scale**2 * float(q.sum()), guess, cuts, thresholds, s, seed)
            return chain.grid, chain
        x = points(keys, cuts, codes)
        return x, CountedChain(x, n, scale * y, scale**2 * float(np.maximum(q - y * y / n, 0.0).sum()), guess, thresholds, s, seed)
    new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
    counts = np.zeros((categories if kind == "logistic" else 2, int(new.sum())))
    counts[g["y"].to_numpy(dtype=np.int64), np.cumsum(new) - 1] = n
    if kind == "probit" and suits(cuts, int(new.sum())):
        chain = SummedChain(codes_of(keys[new], codes or sizes([cuts])), counts.sum(axis=0), counts[1], 0.0, 1.0, cuts, thresholds, s, seed, probit=True)
        return chain.grid, chain
    x = points(keys[new], cuts, codes)
    if kind == "logistic":
        return x, CountedLogisticChain(x, counts, thresholds, s, seed, categories)
    return x, CountedChain(x, counts.sum(axis=0), counts[1], 0.0, 1.0, thresholds, s, seed, probit=True)
