"""Synthetic regression scenarios as SQL expressions over features x0, x1, ... that Spark and other engines read alike.

Features are uniform (or normal by Box-Muller) values made by arithmetic on the row id, so that a table is the same
on any cluster; `random=True` uses Spark's seeded generator instead.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_sql(row: str, k: int, seed: int) -> str:
    """A value in (0, 1) from whole-number arithmetic (all products below 2^53)."""
    a, b = 7919 + 104 * (2 * k + 1), 104729 + 15485 * (k + 1) + 31 * seed
    return f"(CAST(((({row}) % 1000003) * {a} + {b}) % 999983 * 48271 + {k * 37 + seed} AS BIGINT) % 1000033 + CAST(0.5 AS DOUBLE)) / CAST(1000033 AS DOUBLE)"


def normal_sql(row: str, k: int, seed: int) -> str:
    return f"sqrt(-2.0 * ln({uniform_sql(row, 2 * k, seed)})) * cos({2 * math.pi!r} * ({uniform_sql(row, 2 * k + 1, seed)}))"


@dataclass(frozen=True)
class Scenario:
    """p features, how each is drawn, the signal, and the deviation of noise that belongs to the scenario."""

    features: int
    signal: str
    kind: str = "uniform"
    ranges: dict[int, tuple[float, float]] = field(default_factory=dict)
    low: float = 0.0
    high: float = 1.0
    noise: str | None = None  # {noise} is the asked deviation
    fixed: bool = False  # whether the number of features is fixed
    shape: str | None = None  # what becomes of a drawn feature {x} of row {row}

    def feature_sql(self, row: str, k: int, seed: int) -> str:
        if self.kind == "normal":
            return normal_sql(row, k, seed)
        if self.kind == "factor":  # unit variances and covariance 0.01 by one shared factor
            return f"sqrt(0.99) * {normal_sql(row, k, seed)} + sqrt(0.01) * {normal_sql(row, 997, seed)}"
        if self.kind == "paired":  # feature i shares covariance 0.01 with feature i - 10
            return normal_sql(row, k, seed) if k < 10 else f"0.01 * {normal_sql(row, k - 10, seed)} + sqrt(1 - 0.0001) * {normal_sql(row, k, seed)}"
        a, b = self.ranges.get(k, (self.low, self.high))
        x = f"{a!r} + {b - a!r} * ({uniform_sql(row, k, seed)})"
        return self.shape.format(x=x, row=row) if self.shape else x


def _sum(p: int, weight=lambda k: None, term="x{k}") -> str:
    return " + ".join(term.format(k=k) if weight(k) is None else f"({weight(k)}) * ({term.format(k=k)})" for k in range(p))


def _weight(k: int) -> str:
    return repr(1.0 + (k * 37 % 41) / 10.25)


def _linear(p: int) -> str:
    return _sum(p, _weight)


def _half_even(z: str) -> str:
    """The nearest whole number, of two the even one."""
    up = f"floor({z} + 0.5)"
    return f"({up} - CASE WHEN {up} = {z} + 0.5 AND CAST({up} AS BIGINT) % 2 <> 0 THEN 1.0 ELSE 0.0 END)"


#: Weights of the additive scenarios.
ADDITIVE = (0.2, -1.0, 0.6, -0.9, 0.85, 0.0, 0.0, 0.0, 0.0, 0.0)
_P = 5
_S = _sum(_P)
_FAR = f"sqrt({' + '.join(f'(x{k} - 0.5) * (x{k} - 0.5)' for k in range(_P))})"
_LOGIT = "2.0 / (1.0 + exp(-12.0 * (x{k} - 0.5)))"
_LEI = f"({_LOGIT.format(k=0)}) * ({_LOGIT.format(k=1)})"


def _coefs(seed: int) -> list[float]:
    return [round(-15 + 30 * (((k + 1) * 7919 * seed + 31 * k * k) % 1009) / 1009, 6) for k in range(10)]


def _lin(coefs: list[float]) -> str:
    return " + ".join(f"({c!r}) * x{k}" for k, c in enumerate(coefs))


SCENARIOS: dict[str, Scenario] = {
    "linear": Scenario(_P, _linear(_P)),
    "sparse_linear": Scenario(_P, "x0 + x1"),
    "piecewise_flat": Scenario(_P, f"CASE WHEN {_S} < 0.3 THEN -0.5 WHEN {_S} < 0.7 THEN 0.0 ELSE 0.5 END"),
    "heteroscedastic": Scenario(_P, _linear(_P), noise=f"sqrt({' + '.join(f'x{k} * x{k}' for k in range(_P))})"),
    "nonoverlapping": Scenario(_P, f"CASE WHEN {_FAR} < 0.3 THEN 2.0 ELSE 8.0 END"),
    "overlapping": Scenario(_P, f"CASE WHEN {_FAR} < 0.3 THEN 2.0 ELSE 8.0 END", noise="3.0 * {noise}"),
    "spiky": Scenario(_P, f"CASE WHEN row_id % 10 = CAST(floor(10.0 * ({uniform_sql('(row_id - row_id % 10)', 1999, 42)})) AS BIGINT) THEN 10.0 ELSE 0.0 END"),
    "smooth": Scenario(_P, f"exp(-({_linear(_P)} - 2.0) * ({_linear(_P)} - 2.0) / 0.05)"),
    "cyclic": Scenario(_P, f"sin({_linear(_P)})", high=10.0),
    "distribution_shift_train": Scenario(_P, _linear(_P), high=0.5),
    "distribution_shift_test": Scenario(_P, _linear(_P), low=0.5),
    "multimodal": Scenario(_P, f"CASE WHEN {_FAR} < 0.3 THEN 2.0 ELSE 8.0 END", noise="0.1"),
    "imbalanced": Scenario(_P, _linear(_P), shape="{x} + CASE WHEN ({row}) % 10 = 9 THEN 2.0 ELSE 0.0 END"),
    "piecewise_linear": Scenario(_P, f"CASE WHEN {_S} < 0.3 THEN 2.0 * ({_S}) WHEN {_S} < 0.7 THEN 3.0 * ({_S}) + 1.0 ELSE 3.0 - ({_S}) END"),
    "tied_x": Scenario(_P, _linear(_P), shape="floor(({x}) * 50.0) / 50.0"),
    "tied_y": Scenario(_P, f"{_half_even(f'({_linear(_P)}) * 10.0')} / 10.0"),
    "friedman1": Scenario(_P, f"10.0 * sin({math.pi!r} * x0 * x1) + 20.0 * (x2 - 0.5) * (x2 - 0.5) + 10.0 * x3 + 5.0 * x4"),
    "friedman2": Scenario(4, "sqrt(x0 * x0 + (x1 * x2 - 1.0 / (x1 * x3)) * (x1 * x2 - 1.0 / (x1 * x3)))", ranges={0: (0.0, 100.0), 1: (40 * math.pi, 560 * math.pi), 2: (0.0, 1.0), 3: (1.0, 11.0)}),
    "friedman3": Scenario(4, "atan((x1 * x2 - 1.0 / (x1 * x3)) / x0)", ranges={0: (0.0, 100.0), 1: (40 * math.pi, 560 * math.pi), 2: (0.0, 1.0), 3: (1.0, 11.0)}),
    "linear_additive": Scenario(10, _sum(10, lambda k: repr(ADDITIVE[k])), kind="normal", fixed=True),
    "smooth_additive": Scenario(10, f"{ADDITIVE[0]} * x0 * x0 + ({ADDITIVE[1]}) * x1 + {ADDITIVE[2]} * cos(x2) + ({ADDITIVE[3]}) * sqrt(abs(x3)) + {ADDITIVE[4]} * sin(x4)", kind="normal", fixed=True),
    "dgp_1": Scenario(3, "CASE WHEN x0 <= 0.1 THEN CASE WHEN x2 <= -0.2 THEN 6.0 ELSE 3.0 END ELSE CASE WHEN x1 <= 0.7 THEN 9.0 ELSE 12.0 END END", kind="normal"),
    "dgp_2": Scenario(
        7,
        "CASE WHEN x0 <= 0.1 THEN CASE WHEN x2 <= -0.2 THEN CASE WHEN x6 <= 0.15 THEN 1.0 ELSE 2.0 END ELSE CASE WHEN x5 <= 0.2 THEN 4.0 ELSE 3.0 END END "
        "ELSE CASE WHEN x1 <= 0.7 THEN CASE WHEN x4 <= 0.1 THEN 4.0 ELSE 3.0 END ELSE CASE WHEN x3 <= 0.1 THEN 9.0 ELSE 12.0 END END END",
        kind="normal", fixed=True,
    ),
    "low_lei_candes": Scenario(10, _LEI, kind="factor", fixed=True),
    "high_lei_candes": Scenario(100, _LEI, kind="factor", fixed=True),
    "lss": Scenario(
        10, "2.0 * CASE WHEN x0 < 0 AND x2 > 0 THEN 1 ELSE 0 END - 3.0 * CASE WHEN x4 > 0 AND x5 > 1 THEN 1 ELSE 0 END + 0.8 * CASE WHEN x2 < 1.5 AND x4 < 1 THEN 1 ELSE 0 END", kind="factor", fixed=True
    ),
    "piecewise_linear_kunzel": Scenario(10, f"CASE WHEN x9 > 4 THEN {_lin(_coefs(1))} WHEN x9 < -4 THEN {_lin(_coefs(2))} ELSE {_lin(_coefs(3))} END", kind="factor", fixed=True),
    "sum": Scenario(20, _sum(20), kind="paired", fixed=True),
    "tree": Scenario(10, "CASE WHEN x0 <= 0.4 THEN CASE WHEN x1 <= 0.6 THEN CASE WHEN x2 <= 0.5 THEN 0.1 ELSE 0.7 END ELSE 0.3 END ELSE CASE WHEN x3 <= 0.2 THEN 0.9 ELSE CASE WHEN x4 <= 0.8 THEN 0.4 ELSE 0.6 END END END", fixed=True),
}


def names() -> list[str]:
    return sorted(SCENARIOS)


def signal(rows: DataFrame, name: str, seed: int = 42, row: str = "row_id") -> DataFrame:
    """row_id, the features and the noiseless target y, for the rows of a table with the row id."""
    s = SCENARIOS[name]
    ids = rows.select(F.col(row).alias("row_id"))
    made = ids.select("row_id", *(F.expr(s.feature_sql("row_id", k, seed)).alias(f"x{k}") for k in range(s.features)))
    return made.withColumn("y", F.expr(s.signal).cast("double"))


def noise_sd(df: DataFrame, noise: float = 0.1, snr: float | None = None, y: str = "y") -> float:
    """The deviation of the noise: `noise`, or from a signal-to-noise ratio (infinite: none; not positive: an error)."""
    if snr is None:
        return noise
    if snr <= 0:
        raise ValueError("the ratio must be positive")
    if math.isinf(snr):
        return 0.0
    variance = df.agg(F.var_pop(y).alias("v")).first()["v"] or 0.0
    return math.sqrt(variance / snr)


def generate(spark: SparkSession, name: str, rows: int = 100, noise: float = 0.1, snr: float | None = None, seed: int = 42, features: int | None = None) -> DataFrame:
    """(row_id, x0, ..., y) of a scenario with noise.  Scenarios that bring noise of their own get no other."""
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}")
    s = SCENARIOS[name]
    if features is not None and (s.fixed and features != s.features or features < s.features):
        raise ValueError(f"{name} has {s.features} features")
    df = signal(spark.range(rows).withColumnRenamed("id", "row_id"), name, seed)
    for k in range(s.features, features or 0):
        df = df.withColumn(f"x{k}", F.expr(s.feature_sql("row_id", k, seed)))
    z = F.expr(normal_sql("row_id", 1499, seed))
    if s.noise is not None:
        return df.withColumn("y", F.col("y") + F.expr(s.noise.format(noise=repr(noise))) * z)
    return df.withColumn("y", F.col("y") + F.lit(noise_sd(df, noise, snr)) * z)


#: Points of a mesh that one task takes by their hash.
GRID_AT_ONCE = 10_000


def _least(ids: DataFrame, mixed: Column, n: int) -> DataFrame:
    """The n ids of least (hash, id).  For many, counts by the hash's upper bits show which are taken whole, and one task
    gets those of a single value of these bits."""
    if n <= GRID_AT_ONCE:
        return ids.orderBy(mixed, "id").limit(n)
    part = F.shiftright(mixed, 50)
    before, last = 0, None
    for r in sorted(ids.groupBy(part.alias("p")).count().collect()):  # 16,384 at most
        last = r["p"]
        if before + r["count"] >= n:
            break
        before += r["count"]
    return ids.where(part < last).unionByName(ids.where(part == last).orderBy(mixed, "id").limit(n - before))


def grid(spark: SparkSession, rows: int, features: int, bins: int | None = None, seed: int = 42) -> DataFrame:
    """A mesh of bins^p points on the unit cube, of which `rows` are taken by a seeded hash."""
    bins = bins or max(2, math.ceil(rows ** (1 / features)))
    total = bins**features
    digit = [F.pmod(F.floor(F.col("id") / bins**k), F.lit(bins)) / F.lit(float(max(1, bins - 1))) for k in range(features)]
    chosen = _least(spark.range(total), F.xxhash64("id", F.lit(seed)), rows) if rows < total or total <= GRID_AT_ONCE else spark.range(total)
    return chosen.select(F.col("id").alias("row_id"), *[d.alias(f"x{k}") for k, d in enumerate(digit)])
