"""Posterior quantities from an array of draws per row, and importance from a table of tree nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.columns import normal_cdf
from thicket.sources.files import stored


def array_mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def posterior_mean(df: DataFrame, draws: str = "draws", out: str = "mean") -> DataFrame:
    return df.withColumn(out, array_mean(F.col(draws)))


def array_quantile(a: Column, q: float) -> Column:
    """Linear quantile of an array: sorted once, then two neighbours are weighed."""
    s = F.array_sort(a)

    def at(v: Column) -> Column:
        place = (F.size(v) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        high = F.least(low + 1, F.size(v) - 1)
        return F.get(v, low) + (place - low) * (F.get(v, high) - F.get(v, low))

    return F.element_at(F.transform(F.array(s), at), 1)


def intervals(df: DataFrame, draws: str = "draws", level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return df.withColumn("lo", array_quantile(F.col(draws), tail)).withColumn("hi", array_quantile(F.col(draws), 1 - tail))


def coverage(df: DataFrame, y: Column) -> DataFrame:
    """Share of rows inside their interval, and its mean length; lo and hi are columns."""
    return df.agg(F.avg(((y >= F.col("lo")) & (y <= F.col("hi"))).cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("length"))


def sketches(long: DataFrame, keys: list[str], value: str = "f", k: int = 400) -> DataFrame:
    """(keys, sketch): a quantile sketch (KLL) of each key's draws, of bounded size whatever their number.

    Sketches of chains, or of chunks of a trace, are merged by `merged_sketches`.  Quantiles are draws whose rank differs
    from the wanted one by at most `rank_error(k)` of all draws (with 99 % chance); up to k draws all are kept, and the
    quantiles are exact: the least draw that the share q of them doesn't exceed."""
    return long.groupBy(*keys).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def rank_error(k: int) -> float:
    """The part of all draws by which a sketch's rank may be off."""
    return 2.296 / k**0.9021  # fixed values of the sketch


def sketch_intervals(merged: DataFrame, level: float = 0.95) -> DataFrame:
    """merged with lo and hi instead of its sketch."""
    tail = (1 - level) / 2
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(q))
    return merged.withColumn("lo", at(tail)).withColumn("hi", at(1 - tail)).drop("sketch")


def exact_intervals(long: DataFrame, keys: list[str], merged: DataFrame, value: str = "f", level: float = 0.95, k: int = 400) -> DataFrame:
    """(keys, lo, hi): the least draws that the shares of the tails don't exceed, exactly, whatever the number of draws.

    A key's sketch of size k brackets each of the two within twice its rank error; draws below the bracket are counted, and
    those inside are counted by value.  A key whose bracket misses takes all of its draws for it.  Null draws don't count,
    NaN is above all, and null keys are a key of their own."""
    tail, off = (1 - level) / 2, 2 * rank_error(k)
    at = lambda q: F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(q, 0.0), 1.0)))
    ends = F.array(*[F.struct(F.lit(side).alias("side"), F.lit(q).alias("q"), at(q - off).alias("a"), at(q + off).alias("z")) for side, q in (("lo", tail), ("hi", 1 - tail))])
    brackets = stored(merged.select(*[F.col(c).alias(f"__{c}") for c in keys], F.explode(ends).alias("e")).select("*", "e.*").drop("e"), "brackets")
    rows = long.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))

    def found(ends: DataFrame) -> DataFrame:
        v = F.col("__v")
        inside = rows.join(ends, same)
        where = F.when(v < F.col("a"), 0).when(v > F.col("z"), 2).otherwise(1)
        by = inside.groupBy(*keys, "side", "q", where.alias("__part"), F.when(where == 1, v).alias("__v")).agg(F.count("*").alias("n"))
        w = Window.partitionBy(*keys, "side")
        upto = F.sum("n").over(w.orderBy("__part", "__v").rowsBetween(Window.unboundedPreceding, 0))
        rank = F.greatest(F.ceil(F.round(F.sum("n").over(w) * F.col("q"), 6)), F.lit(1))
        hit = by.withColumns({"__upto": upto, "__rank": rank}).where((F.col("__upto") >= F.col("__rank")) & (F.col("__upto") - F.col("n") < F.col("__rank")))
        return hit.select(*keys, "side", "__part", "__v")

    first = stored(found(brackets), "quantiles")
    missed = first.where("__part <> 1").select(*[F.col(c).alias(f"__{c}") for c in keys], F.col("side").alias("__side"))
    if not missed.isEmpty():
        again = F.lit(True)
        for c in keys:
            again = again & brackets[f"__{c}"].eqNullSafe(missed[f"__{c}"])
        wide = brackets.join(missed, again & (F.col("side") == F.col("__side")), "left_semi").withColumns({"a": F.lit(float("-inf")), "z": F.lit(float("nan"))})
        first = first.where("__part = 1").unionByName(found(wide))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("__v"))).alias(s)
    return first.groupBy(*keys).agg(side("lo"), side("hi"))


def long_draws(df: DataFrame, keep: list[str], draws: str = "draws") -> DataFrame:
    return df.select(*keep, F.posexplode(draws).alias("draw", "f"))


def pooled_mean(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the chains' means: each chain counts alike, whatever its length."""
    by_chain = long.groupBy(*keys, "chain").agg(F.avg("f").alias("f"))
    return by_chain.groupBy(*keys).agg(F.avg("f").alias("mean"))


def trimmed(long: DataFrame, per_chain: int, ndpost: int) -> DataFrame:
    """Draws of all chains one after another, as many as were asked for; k lies in chain k div per_chain."""
    return long.withColumn("k", F.col("chain") * per_chain + F.col("draw")).where(F.col("k") < ndpost)


def last_draws(trace: DataFrame, length: int, ndpost: int) -> DataFrame:
    if ndpost > length:
        raise ValueError("fewer draws than asked for")
    return trace.where(F.col("draw") >= length - ndpost)


# -- importance ----------------------------------------------------------------------------------------------------


def split_histogram(nodes: DataFrame, features: int, keys: tuple[str, ...] = ("draw",)) -> DataFrame:
    """Splits on each feature in each draw, zeros included."""
    every = nodes.select(*keys).distinct().withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(features - 1))))
    counted = nodes.where("var >= 0").groupBy(*keys, "var").agg(F.count("*").alias("n"))
    return every.join(counted, [*keys, "var"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def inclusion_probability(histogram: DataFrame) -> DataFrame:
    """Share of the draws that use a feature."""
    return histogram.groupBy("var").agg(F.avg((F.col("n") > 0).cast("double")).alias("inclusion"))


def inclusion_frequency(histogram: DataFrame, kind: str = "split", keys: tuple[str, ...] = ("draw",)) -> DataFrame:
    """split: share of all splits; per_draw: mean of the draws' shares, over draws that split at all."""
    if kind == "split":
        every = F.broadcast(histogram.agg(F.sum("n").alias("all")))  # one row
        return histogram.groupBy("var").agg(F.sum("n").alias("n")).join(every, F.lit(True)).select("var", (F.col("n") / F.col("all")).alias("frequency"))
    if kind == "per_draw":
        share = histogram.withColumn("all", F.sum("n").over(Window.partitionBy(*keys))).where("all > 0")
        return share.groupBy("var").agg(F.avg(F.col("n") / F.col("all")).alias("frequency"))
    raise ValueError(f"unknown kind {kind!r}")


def chain_frequency(histogram: DataFrame) -> DataFrame:
    """Mean over the chains of each chain's share of splits."""
    by = histogram.groupBy("chain", "var").agg(F.sum("n").alias("n"))
    total = histogram.groupBy("chain").agg(F.sum("n").alias("all"))
    return by.join(total, "chain").groupBy("var").agg(F.avg(F.col("n") / F.col("all")).alias("frequency"))


# -- predictive draws ------------------------------------------------------------------------------------------------


def _noise(keys: list[int] | np.ndarray, seed: int, n: int, normal: bool) -> np.ndarray:
    if not normal:
        return uniforms(keys, seed, n)
    return np.stack([np.random.default_rng([seed & 0xFFFFFFFF, k & _WORD]).standard_normal(n) for k in map(int, keys)])


_WORD = 0xFFFFFFFFFFFFFFFF


def _mixed(z: np.ndarray) -> np.ndarray:
    # fixed values: the finaliser of SplitMix64
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def uniforms(keys: list[int] | np.ndarray, seed: int, n: int) -> np.ndarray:
    """(row, draw) in [0, 1), by SplitMix64 from a start that each whole-number key has of its own: all rows at once, and the
    same for a key in any batch."""
    if not isinstance(keys, np.ndarray):
        keys = np.array([int(k) & _WORD for k in keys], np.uint64)
    start = _mixed(keys.astype(np.uint64) ^ _mixed(np.array([seed & _WORD], np.uint64)))
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (_mixed(start[:, None] + steps) >> np.uint64(11)) * 2.0**-53


def whole_keys(column: pa.Array) -> np.ndarray | list[int]:
    """A batch's keys for `uniforms`."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy(zero_copy_only=False)
    return [int(k) for k in column.to_pylist()]


def predictive(df: DataFrame, key: str, sigma: list[float], seed: int, draws: str = "draws", out: str = "predicted") -> DataFrame:
    """f + N(0, sigma_k^2) for each draw; noise depends on the row's key, not on its partition."""
    sd = np.sqrt(np.array(sigma))
    return _appended(df, key, draws, out, "double", True, seed, lambda f, z: f + sd * z)


def _appended(df: DataFrame, key: str, given: str, out: str, kind: str, normal: bool, seed: int, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Appends an array made of a row's column `given` and as many draws for the row's key as it has entries.  `make` gets
    rows of equal lengths at once: given as (row, draw) or (row, draw, class), and the draws as (row, draw)."""
    schema = df.withColumn(out, F.array(F.lit(0).cast(kind))).schema
    k, p = df.columns.index(key), df.columns.index(given)
    arrow = pa.list_(pa.float64() if kind == "double" else pa.int32())

    def cube(column: pa.Array) -> np.ndarray | None:
        """Equal lengths without nulls as one array."""
        shape, flat = [len(column)], column
        while pa.types.is_list(flat.type):
            if flat.null_count:
                return None
            sizes = np.diff(flat.offsets.to_numpy(zero_copy_only=False))
            if not len(sizes) or sizes.min() != sizes.max() or not sizes[0]:
                return None
            shape.append(int(sizes[0]))
            flat = flat.flatten()
        return None if flat.null_count else flat.to_numpy(zero_copy_only=False).astype(float).reshape(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                keys, v = whole_keys(batch.column(k)), cube(batch.column(p))
                if v is None:
                    made = pa.array([make(np.array([b], dtype=float), _noise([a], seed, len(b), normal))[0].tolist() for a, b in zip(keys, batch.column(p).to_pylist(), strict=True)], arrow)
                else:
                    new = make(v, _noise(keys, seed, v.shape[1], normal))
                    made = pa.ListArray.from_arrays(pa.array(np.arange(len(new) + 1, dtype=np.int32) * new.shape[1]), pa.array(new.ravel(), arrow.value_type))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return df.mapInArrow(run, schema)


def drawn_binary(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    return (u < p).astype(np.int32)


def drawn_class(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Classes of (row, draw) by inverse distribution function over p (row, draw, class)."""
    upto = np.cumsum(p, axis=2)
    u, c = u * upto[:, :, -1], np.zeros(u.shape, np.int32)
    for k in range(p.shape[2] - 1):
        c += upto[:, :, k] <= u
    return c


def predictive_binary(df: DataFrame, key: str, seed: int, proba: str = "proba", out: str = "predicted") -> DataFrame:
    """A 0/1 draw for each probability."""
    return _appended(df, key, proba, out, "int", False, seed, drawn_binary)


def predictive_class(df: DataFrame, key: str, seed: int, proba: str = "proba", out: str = "predicted") -> DataFrame:
    """One class for each draw, by inverse distribution function over array<array<double>> (draw, class)."""
    return _appended(df, key, proba, out, "int", False, seed, drawn_class)


def probit_proba(draws: Column) -> Column:
    return F.transform(draws, normal_cdf)


def argmax_class(df: DataFrame, keys: list[str], category: str, p: str, out: str = "predicted") -> DataFrame:
    """The likeliest category; ties go to the smallest."""
    return df.groupBy(*keys).agg(F.max_by(F.col(category), F.struct(F.col(p), -F.col(category))).alias(out))
