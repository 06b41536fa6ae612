"""Rank-normalised diagnostics (Vehtari et al., 2021) of chains of any length as aggregates.

Chains are split in halves by place; ranks of all values of a key are running counts of its distinct values, so that no
task holds a whole trace, and neither equal values nor a single long key make a hot group.  Autocovariances come from
sums over blocks, for more and more lags until every key's sequence has ended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.columns import normal_quantile
from thicket.operators.series import BLOCK_ROWS, lag_sums, running_sums
from thicket.sources.files import stored

#: Rows of a narrow table by key that are sent to all tasks.
KEYS_AT_ONCE = 200_000
#: Lags of the first round; each later round has four times as many.
FIRST_LAGS = 64


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(KEYS_AT_ONCE + 1).count() <= KEYS_AT_ONCE else df


def halves(df: DataFrame, keys: list[str], value: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored rows (keys, chain, late, place, v, n, inside) of each key's chains, cut to the shortest: late tells the
    second half from the first, both have n rows with places from 0; the middle row of an odd number is in neither, and
    only `inside` the cut.  Rows without a value are left out first; keys are not null."""
    one = F.lit(1).cast("long")
    rows = df.select(*keys, "chain", "draw", F.col(value).cast("double").alias("v")).where("v is not null")
    shortest = rows.groupBy(*keys, "chain").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min("n").alias("__n"))
    placed = running_sums(rows, [*keys, "chain"], "draw", {"place": one}, block_rows=block_rows).withColumn("place", F.col("place") - 1)
    n, half, place = F.col("__n"), F.floor(F.col("__n") / 2), F.col("place")
    cut = placed.join(_few(shortest), keys).where(place < n)
    late = F.when(place < half, False).when(place >= n - half, True)
    return stored(cut.select(*keys, "chain", late.alias("late"), F.when(late, place - (n - half)).otherwise(place).alias("place"), "v", half.alias("n")), "halves")


def ranks(rows: DataFrame, keys: list[str], value: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, value, n, first, all, z) of each distinct value of a key: its number, the rows below it, all rows, and the
    normal score of the mean of its ranks.  Stored."""
    counted = stored(rows.groupBy(*keys, value).agg(F.count("*").alias("n")), "values")
    made = running_sums(counted, keys, value, {"__up": F.col("n")}, {"all": F.col("n")}, block_rows=block_rows)
    rank = F.col("__up") - (F.col("n") - 1) / F.lit(2.0)
    z = normal_quantile((rank - F.lit(0.375)) / (F.col("all") + F.lit(0.25)))
    return stored(made.select(*keys, value, "n", (F.col("__up") - F.col("n")).alias("first"), "all", z.alias("z")), "ranks")


def _psrf(rows: DataFrame, scores: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """The factor of the halves' normal scores: values are counted by half before they meet their scores."""
    by_value = rows.groupBy(*keys, "chain", "late", value).agg(F.count("*").alias("__c"), F.first("n").alias("__n"))
    both = by_value.join(scores.select(*keys, value, "z"), [*keys, value])
    c, z, n = F.col("__c"), F.col("z"), F.first("__n")
    mean = F.sum(c * z) / n
    by = both.groupBy(*keys, "chain", "late").agg(mean.alias("m"), F.try_divide(F.sum(c * z * z) - n * mean * mean, n - 1).alias("v"), n.alias("n"))
    m, w = F.avg("n"), F.avg("v")
    return by.groupBy(*keys).agg(F.sqrt(F.try_divide((m - 1) / m * w + F.var_samp("m"), w)).alias(out))


def rank_rhats(df: DataFrame, keys: list[str], value: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, rhat): the larger of the factors of rank-normalised and of folded values of the split chains.

    DataFrame functions only.  Chains are cut to the shortest; rows without a value don't count; an empty table gives no
    rows, and a key whose values are all alike has no factor (null or NaN)."""
    rows = halves(df, keys, value, block_rows)
    return _rhats(rows.where("late is not null"), keys, block_rows)[0]


def _rhats(split: DataFrame, keys: list[str], block_rows: int) -> tuple[DataFrame, DataFrame]:
    bulk = ranks(split, keys, "v", block_rows)
    at = lambda place: F.max(F.when((F.col("first") <= place) & (place < F.col("first") + F.col("n")), F.col("v")))
    middle = bulk.groupBy(*keys).agg(((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("__m"))
    folded = stored(split.join(_few(middle), keys).withColumn("f", F.abs(F.col("v") - F.col("__m"))).drop("__m"), "folded")
    a, b = _psrf(split, bulk, keys, "v", "__a"), _psrf(folded, ranks(folded, keys, "f", block_rows), keys, "f", "__b")
    return a.join(b, keys).select(*keys, F.greatest("__a", "__b").alias("rhat")), bulk


def sizes(rows: DataFrame, keys: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, ess): the effective number of the halves' values, by Geyer's initial monotone sequence of the mean
    autocovariances.  NaN with fewer than 4 rows a half; all of them where the values are alike."""
    by = rows.groupBy(*keys, "chain", "late").agg(F.first("n").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("a0"))
    by = stored(by, "moments")
    n = F.col("n")
    whole = by.groupBy(*keys).agg(F.first("n").alias("n"), F.count("*").alias("chains"), (F.avg("a0") * n_over(F.first("n"))).alias("w"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"))
    whole = stored(whole.withColumn("var", F.col("w") * (n - 1) / n + F.col("between")), "variances")
    alike = whole.where("n < 4 or coalesce(var, 0) <= 0").select(*keys, F.when(n < 4, F.lit(float("nan"))).otherwise((F.col("chains") * n).cast("double")).alias("ess"))
    open_, out, lags = whole.where("n >= 4 and var > 0"), alike, FIRST_LAGS
    most = open_.agg(F.max("n")).first()[0]
    while most is not None:
        lags = min(lags, most - 1)
        here = rows.join(_few(open_.select(*keys)), keys, "left_semi").join(_few(by.select(*keys, "chain", "late", "m")), [*keys, "chain", "late"])
        both = lag_sums(here.withColumn("__z", F.col(value) - F.col("m")), [*keys, "chain", "late"], "place", "__z", lags, block_rows)
        mean = both.where("n > 0").groupBy(*keys, "lag").agg(F.sum("both").alias("both"))
        listed = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "both"))).alias("a"))
        rho = F.concat(F.array(F.lit(1.0)), F.transform("a", lambda p: F.lit(1.0) - (F.col("w") - p["both"] / F.col("chains") / n * n_over(n)) / F.col("var")))
        found = open_.join(listed, keys).withColumn("ended", _sequence(rho, n)).select(*open_.columns, "ended.*")
        size = F.col("chains") * n
        found = stored(found.withColumn("ess", size / F.greatest(F.lit(2.0) * F.col("sum") - 1, F.lit(1.0) / F.log10(size.cast("double")))), "sizes")
        done = F.col("done") | (n - 1 <= lags)
        out = out.unionByName(found.where(done).select(*keys, "ess"))
        open_ = found.where(~done).select(*open_.columns)
        most = open_.agg(F.max("n")).first()[0]
        lags *= 4
    return out


def n_over(n: Column) -> Column:
    """n / (n - 1), null for 1."""
    return F.try_divide(n, n - 1)


def _sequence(rho: Column, n: Column) -> Column:
    """(sum, done): the sum of the running minima of the pairs of neighbouring correlations before the first negative
    pair, and whether there was one.  A last correlation without partner, or beyond an even n, is left out."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("least"), F.lit(False).alias("done"))

    def step(s: Column, k: Column, r: Column) -> Column:
        pair = F.get(r, 2 * k) + F.get(r, 2 * k + 1)
        done = s["done"] | (pair < 0)
        least = F.least(s["least"], pair)
        return F.struct((s["sum"] + F.when(done, 0.0).otherwise(least)).alias("sum"), least.alias("least"), done.alias("done"))

    def over(r: Column) -> Column:
        pairs = F.floor(F.least(F.size(r), n - n % 2) / 2).cast("int")
        return F.aggregate(F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>")), start, lambda s, k: step(s, k, r))

    return F.element_at(F.transform(F.array(rho), over), 1)


def long_rank_diagnostics(df: DataFrame, keys: list[str], value: str = "value", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rhat, ess_bulk, mcse and mcse_sd of each key's chains, cut to the shortest, for traces that no task has to hold.

    Rows without a value don't count; an empty table gives no rows."""
    rows = halves(df, keys, value, block_rows)
    split = rows.where("late is not null")
    rhats, scores = _rhats(split, keys, block_rows)
    scored = stored(split.join(scores.select(*keys, "v", "z"), [*keys, "v"]), "scored")
    bulk = sizes(scored, keys, "z", block_rows).withColumnRenamed("ess", "ess_bulk")
    plain = sizes(split, keys, "v", block_rows)
    spread = rows.groupBy(*keys).agg(F.stddev_samp("v").alias("__sd"))
    err = F.col("__sd") / F.sqrt("ess")
    return rhats.join(bulk, keys).join(plain, keys).join(spread, keys).select(*keys, "rhat", "ess_bulk", err.alias("mcse"), (F.lit(1.0) / F.sqrt("ess")).alias("mcse_sd"))
