"""Statistics of trees over rows as aggregates: sufficient statistics, priors, likelihoods and acceptance ratios."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.columns import depth, log_p_split
from thicket.operators.forest import LEAF, Tree


def leaf_stats(df: DataFrame, resid: Column, keys: tuple[str, ...] = ("leaf",)) -> DataFrame:
    """Rows, sum and sum of squares of the residuals of each leaf."""
    r = resid.cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(r).alias("r"), F.sum(r * r).alias("q"))


def logistic_leaf_stats(df: DataFrame, category: int, phi: Column, other: Column, y: str = "y", keys: tuple[str, ...] = ("leaf",)) -> DataFrame:
    """Rows of the category, and the sum of the latent rates with the other trees' share, of each leaf."""
    return df.groupBy(*keys).agg(F.sum((F.col(y) == category).cast("long")).alias("r_h"), F.sum(phi * F.exp(other)).alias("s_h"))


def log_prior(nodes: DataFrame, alpha: float = 0.95, beta: float = 2.0, quick_decay: bool = False, keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """Log prior of trees from (tree, node, var): log(1 - p) for leaves and log p for splits."""
    log_p = log_p_split(depth("node"), alpha, beta, quick_decay)
    term = F.when(F.col("var") == LEAF, F.ln(F.lit(1.0) - F.exp(log_p))).otherwise(log_p)
    return nodes.groupBy(*keys).agg(F.sum(term).alias("log_prior"))


def leaf_prior_sd2(f_k: float, n_trees: int) -> float:
    return 0.25 / (f_k * f_k * n_trees)


def log_marginal(stats: DataFrame, sigma2: float, f_sigma2: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian log marginal likelihood of one tree from its leaves' n, r and q; constants are left out."""
    ratio = sigma2 / f_sigma2
    fit = F.col("r") * F.col("r") / F.col("n")
    gain = F.col("n") / F.lit(ratio) + 1
    return stats.groupBy(*keys).agg((F.lit(-0.5) * (F.sum(F.ln(gain)) + (F.sum("q") - F.sum(fit) + F.sum(fit / gain)) / F.lit(sigma2))).alias("log_marginal"))


def leaf_posterior(stats: DataFrame, sigma2: float, f_sigma2: float) -> DataFrame:
    """Posterior mean and variance of each leaf."""
    shrunk = F.col("n") + F.lit(sigma2 / f_sigma2)
    return stats.withColumn("mean", F.col("r") / shrunk).withColumn("var", F.lit(sigma2) / shrunk)


def sigma2_posterior(df: DataFrame, resid: Column, nu: float, lam: float) -> DataFrame:
    """Shape and scale of the inverse gamma posterior of the noise variance."""
    return df.agg(((F.lit(nu) + F.count("*")) / 2).alias("shape"), ((F.lit(nu * lam) + F.sum(resid * resid)) / 2).alias("scale"))


def sigma_hat_naive(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.stddev_pop(y).alias("sigma_hat"))


def gram(df: DataFrame, x: list[Column], y: Column) -> DataFrame:
    """One row of sums: x_i x_j, x_i y and y y with an intercept; partial sums are all that is shuffled."""
    full = [F.lit(1.0), *[c.cast("double") for c in x]]
    y = y.cast("double")
    sums = [F.sum(full[i] * full[j]).alias(f"g_{i}_{j}") for i in range(len(full)) for j in range(i, len(full))]
    return df.agg(*sums, *[F.sum(c * y).alias(f"h_{i}") for i, c in enumerate(full)], F.sum(y * y).alias("yy"))


def ols(df: DataFrame, x: list[Column], y: Column) -> tuple[list[float], float]:
    """Coefficients (intercept first) and the population deviation of the residuals, from one aggregate."""
    import numpy as np

    row, p = gram(df, x, y).first(), len(x) + 1
    g = np.array([[row[f"g_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    h = np.array([row[f"h_{i}"] for i in range(p)])
    coef = np.linalg.lstsq(g, h, rcond=None)[0]
    sse = max(row["yy"] - 2 * coef @ h + coef @ g @ coef, 0.0)
    return coef.tolist(), math.sqrt(sse / g[0, 0])


def transition_counts(tree: Tree) -> dict[str, int]:
    from thicket.operators.forest import leaves, splits, terminal_splits

    return {"leaves": len(leaves(tree)), "splits": len(splits(tree)), "terminal": len(terminal_splits(tree))}


def node_table(spark, forests: dict[str, Tree]) -> DataFrame:
    """(tree, node, var, thr, leaf) of named trees."""
    rows = [(name, i, n.var, n.thr, n.leaf) for name, t in forests.items() for i, n in sorted(t.items())]
    return spark.createDataFrame(rows, "tree string, node int, var int, thr double, leaf double")


def terminal_counts(nodes: DataFrame) -> DataFrame:
    """Leaves, splits and terminal splits of each tree, by joining splits with their children on the heap index."""
    left = nodes.select("tree", F.floor((F.col("node") - 1) / 2).cast("int").alias("node"), (F.col("var") == LEAF).cast("int").alias("is_leaf")).where("node >= 0")
    below = left.groupBy("tree", "node").agg(F.sum("is_leaf").alias("leaf_children"))
    joined = nodes.join(below, ["tree", "node"], "left")
    return joined.groupBy("tree").agg(
        F.sum((F.col("var") == LEAF).cast("long")).alias("n_leaves"), F.sum((F.col("var") != LEAF).cast("long")).alias("n_splits"), F.sum((F.coalesce("leaf_children", F.lit(0)) == 2).cast("long")).alias("n_terminal")
    )


def log_mh_ratio(prior: Column, marginal: Column, transition: Column, forth: float, back: float, temperature: float = 1.0) -> Column:
    """(difference of log prior + difference of log marginal) / T + transition + log P(back) - log P(forth)."""
    return (prior + marginal) / F.lit(temperature) + transition + F.lit(math.log(back) - math.log(forth))
