"""Seeded choices that depend on keys and not on partitions: folds, splits, permutations, bootstraps, weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def uniform(key: Column, k: int = 0, seed: int = 0) -> Column:
    """A value in (0, 1) for each whole-number key, by the arithmetic of the synthetic scenarios."""
    a, b = 7919 + 104 * (2 * k + 1), 104729 + 15485 * (k + 1) + 31 * seed
    mixed = (F.pmod(key, F.lit(1000003)) * a + b) % 999983 * 48271 + (k * 37 + seed)
    return (mixed.cast("long") % 1000033 + F.lit(0.5)) / F.lit(1000033.0)


def uniform_sql(key: str, k: int = 0, seed: int = 0) -> str:
    from thicket.sources.scenarios import uniform_sql as sql

    return sql(key, k, seed)


def fold(key: Column, folds: int, seed: int = 0) -> Column:
    return F.least(F.floor(uniform(key, 0, seed) * folds), F.lit(folds - 1)).cast("int")


def split(df: DataFrame, key: str, test: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows for training and for testing."""
    u = uniform(F.col(key), 1, seed)
    return df.where(u >= test), df.where(u < test)


def permutation(df: DataFrame, keys: list[str], item: str, seed: int = 0, out: str = "place") -> DataFrame:
    """A random order of the items of each key, from 0: the queue of draws not yet used, or a round of arms."""
    w = Window.partitionBy(*keys).orderBy(uniform(F.col(item) + 131 * F.hash(*keys) % 65536 if keys else F.col(item), 2, seed), F.col(item))
    return df.withColumn(out, F.row_number().over(w) - 1)


def bootstrap(df: DataFrame, key: str, rounds: int, seed: int = 0) -> DataFrame:
    """Each row with its number of copies in each round, Poisson(1) by inversion; rows without copies are left out."""
    spread = df.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = uniform(F.col(key) * 64 + F.col("round"), 3, seed)
    # fixed values: the Poisson(1) distribution function
    steps = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)
    copies = F.lit(0)
    for s in steps:
        copies = copies + (u > s).cast("int")
    return spread.withColumn("copies", copies).where("copies > 0")


def choose(options: Column, u: Column) -> Column:
    """A uniform choice from an array."""
    return F.get(options, F.least(F.floor(u * F.size(options)), F.size(options) - 1).cast("int"))


def choose_weighted(weights: Column, u: Column) -> Column:
    """Index of the first weight whose running sum reaches u times the total."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    need = u * total
    counted = F.aggregate(weights, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + (s["sum"] + x < need).cast("int")).alias("n")))
    return F.least(counted["n"], F.size(weights) - 1)


def choose_softmax(scores: Column, u: Column) -> Column:
    """A draw with chances in proportion to exp(score), shifted by the largest."""
    shifted = F.transform(F.array(scores), lambda z: F.transform(z, lambda v: F.exp(v - F.array_max(z))))
    return choose_weighted(F.element_at(shifted, 1), u)
