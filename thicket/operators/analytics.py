"""Analytics of bandit simulations, tuning runs and logged policies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.special import welch_p
from thicket.operators.series import BLOCK_ROWS, gaussian_smooth, moving_average, running_sums  # noqa: F401


def running(df: DataFrame, value: str, keys: list[str], order: str, out: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sum of a value within keys; a long series is dealt to many tasks."""
    return running_sums(df, keys, order, {out: F.col(value)}, block_rows=block_rows)


def cumulative_regret(df: DataFrame, best: str = "best_mean", chosen: str = "chosen_mean", keys: tuple[str, ...] = ("agent",), order: str = "draw", block_rows: int = BLOCK_ROWS) -> DataFrame:
    return running(df.withColumn("regret", F.col(best) - F.col(chosen)), "regret", list(keys), order, "cum_regret", block_rows)


def cumulative_share(df: DataFrame, weight: str, keys: list[str], order: str, out: str = "share", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sum of weights within keys over their total: the distribution function that a weighted draw inverts.
    Null where the total is 0 or null."""
    made = running_sums(df, keys, order, {"__run": F.col(weight)}, {"__all": F.col(weight)}, block_rows=block_rows)
    return made.withColumn(out, F.try_divide(F.col("__run").cast("double"), F.col("__all").cast("double"))).drop("__run", "__all")


def logged_step(draw: Column, last: int) -> Column:
    """Steps worth a log line: 10, squares above 10 and the last."""
    root = F.floor(F.sqrt(draw.cast("double")))
    return (draw == 10) | ((draw > 10) & (root * root == draw)) | (draw == last)


def final_summary(sim: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return sim.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def curve_band(sim: DataFrame, value: str, keys: list[str], step: str = "draw", widths: float = 1.0) -> DataFrame:
    """(keys, step, n, mean, low, high): the pointwise mean over simulations and a band of so many deviations."""
    by = sim.groupBy(*keys, step).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("__sd"))
    return by.select(*keys, step, "n", "mean", (F.col("mean") - widths * F.col("__sd")).alias("low"), (F.col("mean") + widths * F.col("__sd")).alias("high"))


def complexity(sim: DataFrame, value: str, keys: list[str], step: str = "draw") -> DataFrame:
    """How the mean curve of each key grows: both fits, their AIC and the better one, as `growth_fits` gives them."""
    return growth_fits(curve_band(sim, value, keys, step), step, "mean", keys)


def merged_counts(left: DataFrame, right: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Sums of both tables over the union of their keys; a key that one of them lacks counts 0 there."""
    other = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in counts])
    joined = left.join(other, F.col(key) == F.col("__key"), "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(F.coalesce(key, "__key").alias(key), *[(zero(c) + zero(f"__{c}")).alias(c) for c in counts])


def final_pivot(sim: DataFrame, value: str, rows: str, columns: str, names: list[str]) -> DataFrame:
    return sim.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def relative_performance(final: DataFrame, baseline: str, agent: str = "agent", scenario: str = "scenario", value: str = "regret") -> DataFrame:
    """Each agent's mean regret over the baseline's, then the harmonic mean, deviation and error over scenarios."""
    mean = final.groupBy(scenario, agent).agg(F.avg(value).alias("m"))
    base = mean.where(F.col(agent) == baseline).select(scenario, F.col("m").alias("base"))
    rel = mean.join(base, scenario).withColumn("rel", F.col("m") / F.col("base"))
    n = F.count("*")
    return rel.groupBy(agent).agg((n / F.sum(1 / F.col("rel"))).alias("hmean"), F.stddev_samp("rel").alias("sd"), n.alias("n"), (F.stddev_samp("rel") / F.sqrt(n)).alias("se"))


def with_average(final: DataFrame, baseline: str, agent: str = "agent", scenario: str = "scenario", value: str = "regret") -> DataFrame:
    """Appends a scenario "Average" that holds all regrets over the baseline's mean."""
    base = final.where(F.col(agent) == baseline).groupBy(scenario).agg(F.avg(value).alias("__base"))
    rel = final.join(base, scenario).withColumn(value, F.col(value) / F.col("__base")).drop("__base").withColumn(scenario, F.lit("Average"))
    return final.unionByName(rel.select(*final.columns))


def top_agents(mean: DataFrame, n: int, scenario: str = "scenario", value: str = "mean", agent: str = "agent") -> DataFrame:
    w = Window.partitionBy(scenario).orderBy(F.col(value), F.col(agent))
    return mean.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def pairs_of_agents(final: DataFrame, value: str = "regret") -> DataFrame:
    """Moments of each two agents of a scenario, names in order."""
    m = final.groupBy("scenario", "agent").agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    a = m.select("scenario", F.col("agent").alias("a1"), F.col("m").alias("m1"), F.col("v").alias("v1"), F.col("n").alias("n1"))
    b = m.select(F.col("scenario").alias("s2"), F.col("agent").alias("a2"), F.col("m").alias("m2"), F.col("v").alias("v2"), F.col("n").alias("n2"))
    return a.join(b, (F.col("scenario") == F.col("s2")) & (F.col("a1") < F.col("a2"))).drop("s2")


def win_tie_lose(final: DataFrame, value: str = "regret", level: float = 0.05) -> DataFrame:
    """Adds Welch's p-value and who had less regret; 0 where the difference isn't significant."""

    @F.pandas_udf("double")
    def p_value(m1: pd.Series, v1: pd.Series, n1: pd.Series, m2: pd.Series, v2: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([welch_p(*r) for r in zip(m1, v1, n1, m2, v2, n2, strict=True)], dtype=float)

    pairs = pairs_of_agents(final, value).withColumn("p", p_value("m1", "v1", "n1", "m2", "v2", "n2"))
    return pairs.withColumn("outcome", F.when(F.isnan("p") | (F.col("p") >= level), 0).when(F.col("m1") < F.col("m2"), 1).otherwise(-1))


def growth_fits(df: DataFrame, t: str, value: str, keys: list[str]) -> DataFrame:
    """Power law (least squares on logs) and logarithmic growth of a curve, with residual sums on the value's axis,
    AIC = n ln(RSS / n) + 4, and the better model; the logarithm wins ties."""
    lt, lv = F.ln(F.col(t).cast("double")), F.ln(F.col(value))
    base = df.where((F.col(t) > 0) & (F.col(value) > 0))
    fit = base.groupBy(*keys).agg(F.regr_slope(lv, lt).alias("b"), F.regr_intercept(lv, lt).alias("la"), F.regr_slope(F.col(value), lt).alias("k"), F.regr_intercept(F.col(value), lt).alias("c"))
    joined = base.join(F.broadcast(fit) if not keys else fit, keys) if keys else base.join(F.broadcast(fit), F.lit(True))
    sq = lambda e: F.sum(e * e)
    rss = joined.groupBy(*keys).agg(
        F.first("b").alias("power"), F.exp(F.first("la")).alias("scale"), F.first("k").alias("slope"), F.first("c").alias("intercept"), F.count("*").alias("n"),
        sq(F.col(value) - F.exp(F.col("la") + F.col("b") * lt)).alias("rss_power"), sq(F.col(value) - F.col("c") - F.col("k") * lt).alias("rss_log"),
    )
    aic = lambda c: F.col("n") * F.ln(F.col(c) / F.col("n")) + 4
    out = rss.withColumn("aic_power", aic("rss_power")).withColumn("aic_log", aic("rss_log"))
    return out.withColumn("best", F.when(F.col("aic_power") < F.col("aic_log"), "power").otherwise("log"))


def first_split(roots: DataFrame, correct: int) -> DataFrame:
    """Share of draws whose root splits on the right feature, and how often the root's feature changes."""
    before = F.lag("var").over(Window.partitionBy("chain").orderBy("draw"))
    marked = roots.withColumn("__moved", (F.col("var") != before).cast("int"))
    return marked.groupBy("chain").agg(F.avg((F.col("var") == correct).cast("double")).alias("share"), F.coalesce(F.sum("__moved"), F.lit(0)).alias("changes"))


FACTOR = r"_{name}=?([^_]+)"


def parse_factors(df: DataFrame, agent: str, factors: list[str]) -> DataFrame:
    """Factor values from names such as Trees_m=50_enc=multi."""
    return df.withColumns({f: F.regexp_extract(F.col(agent), FACTOR.format(name=f), 1) for f in factors})


def factor_means(df: DataFrame, factors: list[str], value: str) -> DataFrame:
    """(factor, level, mean): a factor counts only rows that have a partner that differs in nothing else."""
    parts = None
    for f in factors:
        rest = [c for c in factors if c != f]
        levels = df.select(*factors).distinct().groupBy(*rest).agg(F.count("*").alias("__levels")) if rest else df.select(f).distinct().agg(F.count("*").alias("__levels"))
        joined = df.join(levels, rest) if rest else df.join(F.broadcast(levels), F.lit(True))
        part = joined.where("__levels > 1").groupBy(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")).agg(F.avg(value).alias("mean"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def arm_share(df: DataFrame, step: str, arm: str, choices: int) -> DataFrame:
    """How often each arm is chosen at each step."""
    return df.groupBy(step, arm).agg((F.count("*") / F.lit(choices)).alias("share"))


def empirical_outcome(df: DataFrame, context: list[str], arm: str, hit: Column, arms: DataFrame) -> DataFrame:
    """Chance of a hit for each context and arm; 0.5 where nothing was seen."""
    seen = df.groupBy(*context, arm).agg(F.avg(hit.cast("double")).alias("p"))
    every = df.select(*context).distinct().join(F.broadcast(arms), F.lit(True))
    return every.join(seen, [*context, arm], "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


def sufficient(log: DataFrame, arms: int, least: int = 5, separate: bool = True, arm: str = "arm") -> DataFrame:
    """(enough, least): whether there are `least` observations, of every arm (0 for arms that the log lacks) where each
    has a model of its own, and the smallest number."""
    if not separate:
        return log.agg((F.count("*") >= least).alias("enough"), F.count("*").alias("least"))
    seen = log.groupBy(F.col(arm).alias("__arm")).agg(F.count("*").alias("__n"))
    every = log.sparkSession.range(arms).join(F.broadcast(seen.where(F.col("__arm").between(0, arms - 1))), F.col("id") == F.col("__arm"), "left")  # one row an arm
    n = F.coalesce("__n", F.lit(0))
    return every.agg((F.min(n) >= least).alias("enough"), F.min(n).alias("least"))


def feel_good(log: DataFrame, values: list[list[Column]], most: float = 0.5) -> DataFrame:
    """(draw, s): the sum over the log's contexts of the best arm's value, at most `most`; values[draw][arm] are columns.
    One aggregation: the log is read once for all draws."""
    sums = log.agg(*[F.sum(F.least(F.lit(most), F.greatest(*by))).alias(f"s{d}") for d, by in enumerate(values)])
    return sums.select(F.posexplode(F.array(*[f"s{d}" for d in range(len(values))])).alias("draw", "s"))


def hits_by_key(keys: DataFrame, events: DataFrame, key: str, of: str, out: str) -> DataFrame:
    """Every key with its number of events, 0 where there are none."""
    counted = events.groupBy(F.col(of).alias("__of")).agg(F.count("*").alias("__n"))
    return keys.join(counted, F.col(key) == F.col("__of"), "left").withColumn(out, F.coalesce("__n", F.lit(0))).drop("__of", "__n")


def bootstrap_summary(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    q = F.percentile(F.col(value), F.array(F.lit(0.025), F.lit(0.975)))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.get(q, 0).alias("lo"), F.get(q, 1).alias("hi"))


def not_yet_run(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(done, keys, "left_anti")


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of both tables, joined by key, in which some column differs."""
    b = right.select(F.col(key).alias("__key"), *[F.col(c).alias(f"{c}_b") for c in columns])
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"{c}_b"))
    return left.join(b, F.col(key) == F.col("__key")).where(differ).drop("__key")
