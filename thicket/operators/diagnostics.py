"""Convergence of chains: native aggregates over (chain, draw, value), and rank-normalised statistics per group."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.forest import vectors
from thicket.operators.series import BLOCK_ROWS, lag_sums, running_sums


def psrf(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Gelman-Rubin factor sqrt(V / W) with sample variances."""
    by = df.groupBy(*keys, "chain").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    n, w = F.avg("n"), F.avg("v")
    between = n * F.var_samp("m")
    return by.groupBy(*keys).agg(F.sqrt(((n - 1) / n * w + between / n) / w).alias("psrf"))


def psrf_population(df: DataFrame, value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """The variant (B / n + W n / (n - 1)) / W without a root: W is the mean population variance of the chains and
    B / n the variance of their means."""
    by = df.groupBy(*keys, "chain").agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    n, w = F.avg("n"), F.avg("v")
    return by.groupBy(*keys).agg(((F.var_samp("m") + w * n / (n - 1)) / w).alias("psrf"))


def geweke(df: DataFrame, value: str = "value", first: float = 0.1, last: float = 0.5) -> DataFrame:
    """Difference of the means of the first and last parts of each chain, over its standard error."""
    w = Window.partitionBy("chain")
    placed = df.withColumn("__i", F.row_number().over(w.orderBy("draw"))).withColumn("__n", F.count("*").over(w))
    a, b = F.col("__i") <= F.floor(F.col("__n") * first), F.col("__i") > F.col("__n") - F.floor(F.col("__n") * last)
    part = lambda c: F.when(c, F.col(value))
    by = placed.groupBy("chain").agg(*[f(part(c)).alias(k + s) for s, c in (("1", a), ("2", b)) for k, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    return by.select("chain", ((F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).alias("z"))


def autocorrelation(df: DataFrame, lags: int, value: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pearson correlation of each chain with itself, for lags 1 to `lags`; no row where a chain has no pair of a lag, null
    where one of the two has no variance.  A long chain is dealt to many tasks, and its rows move as often for many lags as
    for one."""
    mean = F.try_divide(F.col("__sum"), F.col("__n"))
    placed = running_sums(df, ["chain"], "draw", {"__i": F.lit(1).cast("long")}, {"__n": F.when(F.col(value).isNotNull(), 1), "__sum": F.col(value).cast("double")}, block_rows=block_rows)
    sums = lag_sums(placed.select("chain", (F.col("__i") - 1).alias("__i"), (F.col(value) - mean).alias("__v")), ["chain"], "__i", "__v", lags, block_rows)
    n = F.col("n")
    spread = lambda c: F.greatest(F.col(f"{c}2") - F.col(c) * F.col(c) / n, F.lit(0.0))
    rho = F.try_divide(F.col("both") - F.col("now") * F.col("before") / n, F.sqrt(spread("now") * spread("before")))
    return sums.where("n > 0").select("chain", "lag", rho.alias("rho"))


def effective_size(df: DataFrame, lags: int, value: str = "value") -> DataFrame:
    """n / (1 + 2 sum of autocorrelations up to the first negative one), by chain."""
    rho = autocorrelation(df, lags, value)
    w = Window.partitionBy("chain").orderBy("lag")
    positive = rho.withColumn("low", F.min("rho").over(w)).where("low >= 0").groupBy("chain").agg(F.sum("rho").alias("s"))
    n = df.groupBy("chain").agg(F.count("*").alias("n"))
    return n.join(positive, "chain", "left").select("chain", (F.col("n") / (1 + 2 * F.coalesce("s", F.lit(0.0)))).alias("ess"))


# -- rank-normalised statistics (Vehtari et al., 2021) -----------------------------------------------------------


def _split(x: np.ndarray) -> np.ndarray:
    half = x.shape[1] // 2
    return np.concatenate([x[:, :half], x[:, x.shape[1] - half :]])


def _ranks(x: np.ndarray) -> np.ndarray:
    flat = pd.Series(x.ravel()).rank(method="average").to_numpy()
    inv = NormalDist().inv_cdf
    return np.array([inv(r) for r in (flat - 0.375) / (x.size + 0.25)]).reshape(x.shape)


def _rhat(x: np.ndarray) -> float:
    n, w = x.shape[1], x.var(axis=1, ddof=1).mean()
    return float(np.sqrt(((n - 1) / n * w + x.mean(axis=1).var(ddof=1)) / w)) if w > 0 else float("nan")


def rank_rhat(x: np.ndarray) -> float:
    """x is chains by draws; the larger of the bulk and the folded value."""
    s = _split(x)
    return max(_rhat(_ranks(s)), _rhat(_ranks(np.abs(s - np.median(s)))))


def _ess(x: np.ndarray) -> float:
    m, n = x.shape
    if n < 4 or np.allclose(x, x.flat[0]):
        return float("nan") if n < 4 else float(m * n)
    centred = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(centred, size, axis=1)
    acov = np.fft.irfft(f * np.conj(f), size, axis=1)[:, :n] / n
    w = acov[:, 0].mean() * n / (n - 1)
    var = w * (n - 1) / n + (x.mean(axis=1).var(ddof=1) if m > 1 else 0)
    rho = 1 - (w - acov.mean(axis=0) * n / (n - 1)) / var
    rho[0] = 1
    pairs = rho[: n - n % 2].reshape(-1, 2).sum(axis=1)
    stop = int(np.argmax(pairs < 0)) if (pairs < 0).any() else len(pairs)
    tau = -1 + 2 * np.minimum.accumulate(pairs[:stop]).sum()
    return float(m * n / max(tau, 1 / np.log10(m * n)))


def bulk_ess(x: np.ndarray) -> float:
    return _ess(_ranks(_split(x)))


def mcse(x: np.ndarray) -> float:
    return float(x.std(ddof=1) / np.sqrt(_ess(_split(x))))


def rank_diagnostics(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """rhat, ess_bulk, mcse and mcse_sd of each key's chains, cut to the shortest.  A key's draws fit one task: they
    are bounded by the length of the trace."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        chains = [c.sort_values("draw")[value].to_numpy(dtype=float) for _, c in g.groupby("chain")]
        x = np.stack([c[: min(map(len, chains))] for c in chains])
        err = mcse(x)
        return pd.DataFrame([[*key, rank_rhat(x), bulk_ess(x), err, err / x.std(ddof=1)]], columns=[*keys, "rhat", "ess_bulk", "mcse", "mcse_sd"])

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "rhat double", "ess_bulk double", "mcse double", "mcse_sd double"])
    return df.groupBy(*keys).applyInPandas(run, schema)


def _ranks_of_rows(x: np.ndarray) -> np.ndarray:
    """`_ranks` of each row's chains; x is (row, chain, draw)."""
    flat = x.reshape(len(x), -1)
    n = flat.shape[1]
    order = np.argsort(flat, axis=1, kind="stable")
    ordered = np.take_along_axis(flat, order, axis=1)
    place = np.broadcast_to(np.arange(n), flat.shape)
    new = np.concatenate([np.ones((len(x), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
    first = np.maximum.accumulate(np.where(new, place, 0), axis=1)
    end = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1)
    last = np.minimum.accumulate(np.where(end, place, n)[:, ::-1], axis=1)[:, ::-1]
    inv = NormalDist().inv_cdf
    table = np.array([inv((1 + k / 2 - 0.375) / (n + 0.25)) for k in range(2 * n - 1)])  # ranks are whole or half
    out = np.empty(flat.shape)
    np.put_along_axis(out, order, table[first + last], axis=1)
    return out.reshape(x.shape)


def _rhat_of_rows(x: np.ndarray) -> np.ndarray:
    n, w = x.shape[2], x.var(axis=2, ddof=1).mean(axis=1)
    with np.errstate(all="ignore"):
        return np.where(w > 0, np.sqrt(((n - 1) / n * w + x.mean(axis=2).var(axis=1, ddof=1)) / w), np.nan)


def _ess_of_rows(x: np.ndarray) -> np.ndarray:
    r, m, n = x.shape
    if n < 4:
        return np.full(r, np.nan)
    flat = x.reshape(r, -1)
    same = (np.abs(flat - flat[:, :1]) <= 1e-8 + 1e-5 * np.abs(flat[:, :1])).all(axis=1)
    size = 1 << (2 * n - 1).bit_length()
    f = np.fft.rfft(x - x.mean(axis=2, keepdims=True), size, axis=2)
    acov = np.fft.irfft(f * np.conj(f), size, axis=2)[:, :, :n] / n
    w = acov[:, :, 0].mean(axis=1) * n / (n - 1)
    var = w * (n - 1) / n + (x.mean(axis=2).var(axis=1, ddof=1) if m > 1 else 0)
    with np.errstate(all="ignore"):
        rho = 1 - (w[:, None] - acov.mean(axis=1) * n / (n - 1)) / var[:, None]
        rho[:, 0] = 1
        pairs = rho[:, : n - n % 2].reshape(r, -1, 2).sum(axis=2)
        kept = ~np.maximum.accumulate(pairs < 0, axis=1)
        tau = -1 + 2 * np.where(kept, np.minimum.accumulate(pairs, axis=1), 0.0).sum(axis=1)
        return np.where(same, float(m * n), m * n / np.maximum(tau, 1 / np.log10(m * n)))


def rank_diagnostics_of_rows(df: DataFrame, keep: list[str], draws: str, lengths: list[int]) -> DataFrame:
    """`rank_diagnostics` where a row has the draws of all chains in one array, chain after chain, of the given lengths:
    (keep, rhat, ess_bulk, mcse, mcse_sd).  Rows stay where they are, and a batch of them is diagnosed at once."""
    names = ["rhat", "ess_bulk", "mcse", "mcse_sd"]
    schema = df.select(*keep, *[F.lit(0.0).cast("double").alias(c) for c in names]).schema
    starts, n = np.cumsum([0, *lengths])[:-1], min(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                flat = vectors(batch.column(len(keep)))
                x = np.stack([flat[:, a : a + n] for a in starts], axis=1)
                half = n // 2
                s = np.concatenate([x[:, :, :half], x[:, :, n - half :]], axis=1)
                z = _ranks_of_rows(s)
                far = np.abs(s - np.median(s.reshape(len(s), -1), axis=1)[:, None, None])
                rhat, folded = _rhat_of_rows(z), _rhat_of_rows(_ranks_of_rows(far))
                sd = x.reshape(len(x), -1).std(axis=1, ddof=1)
                with np.errstate(all="ignore"):
                    err = sd / np.sqrt(_ess_of_rows(s))
                    made = [np.where(folded > rhat, folded, rhat), _ess_of_rows(z), err, err / sd]  # as max() takes them
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, made)], names=schema.names)

    return df.select(*keep, draws).mapInArrow(run, schema)


def move_rates(moves: DataFrame) -> DataFrame:
    """Counts and rates of each move and of all: accepted / proposed and proposed / selected, null on zero."""
    total = moves.rollup("move").agg(*[F.sum(c).alias(c) for c in ("selected", "proposed", "accepted")])
    return total.select(
        F.coalesce("move", F.lit("overall")).alias("move"), "selected", "proposed", "accepted", F.try_divide("accepted", "proposed").alias("acceptance"), F.try_divide("proposed", "selected").alias("proposal")
    )
