"""Data drawn from the model itself: a forest from the tree prior, and targets around its sum."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import forest as fo
from thicket.sources.scenarios import grid


def split_chance(depth: int, alpha: float, beta: float, quick_decay: bool) -> float:
    return min(1.0, max(0.0, alpha**depth if quick_decay else alpha / (1 + depth) ** beta))


def draw_tree(rng: np.random.Generator, x: np.ndarray, alpha: float, beta: float, quick_decay: bool, sd: float, weights: np.ndarray | None, tries: int = 32, deepest: int = 10, least: int = 1) -> fo.Tree:
    """Nodes split with the prior's chance on a feature and value of the rows they hold."""
    tree: fo.Tree = {}
    todo = [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, rows = todo.pop()
        rule = None
        if depth < deepest and rng.random() < split_chance(depth, alpha, beta, quick_decay):
            for _ in range(tries):
                var = int(rng.choice(x.shape[1], p=weights))
                thr = float(x[rows[rng.integers(len(rows))], var])
                left = x[rows, var] <= thr
                if least <= left.sum() <= len(rows) - least:
                    rule = var, thr, left
                    break
        if rule is None:
            tree[node] = fo.leaf(rng.normal(0, sd))
            continue
        var, thr, left = rule
        tree[node] = fo.split(var, thr)
        todo += [(2 * node + 1, depth + 1, rows[left]), (2 * node + 2, depth + 1, rows[~left])]
    return tree


def draw_forest(x: np.ndarray, n_trees: int = 200, alpha: float = 0.95, beta: float = 2.0, quick_decay: bool = False, f_sigma2: float | None = None, dirichlet: float | None = None, seed: int = 42) -> list[fo.Tree]:
    rng = np.random.default_rng(seed)
    weights = None if dirichlet is None else rng.dirichlet(np.full(x.shape[1], dirichlet / x.shape[1]))
    sd = np.sqrt(0.25 / (4 * n_trees) if f_sigma2 is None else f_sigma2)
    return [draw_tree(rng, x, alpha, beta, quick_decay, sd, weights) for _ in range(n_trees)]


def heatmap(spark: SparkSession, forest: list[fo.Tree], bins: int = 100) -> DataFrame:
    """(row_id, x0, x1, f): a forest of two features on a mesh of the unit square, for a plot."""
    points = grid(spark, bins * bins, 2, bins)
    valued = fo.with_draws(points.withColumn("x", F.array("x0", "x1")), [forest], "x", "f")
    return valued.select("row_id", "x0", "x1", F.get("f", 0).alias("f"))


def prior_heatmap(spark: SparkSession, bins: int = 100, design_rows: int = 2000, seed: int = 42, **options) -> DataFrame:
    """The heatmap of a forest that is drawn from the prior."""
    design = grid(spark, min(bins * bins, design_rows), 2, seed=seed).select("x0", "x1").toPandas().to_numpy(dtype=float)
    return heatmap(spark, draw_forest(design, seed=seed, **options), bins)


def prior_predictive(spark: SparkSession, rows: int, features: int, eps_nu: float = 3.0, eps_lambda: float = 0.1, design_rows: int = 2000, seed: int = 42, latent: bool = False, **options) -> DataFrame:
    """(row_id, x0, ..., y) with y = forest + normal noise of an inverse gamma variance.  The forest is drawn over a
    bounded design of at most design_rows grid points and then evaluated on all rows where they are."""
    points = grid(spark, rows, features, seed=seed)
    names = [f"x{k}" for k in range(features)]
    design = grid(spark, min(rows, design_rows), features, seed=seed).select(*names).toPandas().to_numpy(dtype=float)
    forest = draw_forest(design, seed=seed, **options)
    rng = np.random.default_rng([seed, 1])
    sigma = float(np.sqrt((eps_nu * eps_lambda / 2) / rng.gamma(eps_nu / 2)))
    valued = fo.with_draws(points.withColumn("x", F.array(*names)), [forest], "x", "f").withColumn("f", F.get("f", 0)).drop("x")
    from thicket.sources.scenarios import normal_sql

    out = valued.withColumn("y", F.col("f") + F.lit(sigma) * F.expr(normal_sql("row_id", 1499, seed)))
    return out if latent else out.drop("f")
