import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import analytics as an
from thicket.operators import diagnostics as dg
from thicket.operators import series as se


def table(spark, n=240, seed=1):
    """Keys of very different lengths, one of them null, with null values; orders are unique in a key."""
    deal = random.Random(seed)
    rows = [(deal.choice(["hot"] * 6 + ["a", None]), k, None if k % 17 == 0 else deal.uniform(-3, 5)) for k in deal.sample(range(-500, 500), n)]
    rows.append(("one", 7, 1.5))
    return rows, spark.createDataFrame(rows, "k string, t long, v double").repartition(4)


def by_key(rows):
    out = {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        out.setdefault(k, []).append((t, v))
    return out


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
def test_running_sums(spark, block_rows):
    rows, df = table(spark)
    made = se.running_sums(df, ["k"], "t", {"run": F.col("v")}, {"all": F.lit(1).cast("long")}, block_rows=block_rows)
    got = {(r["k"], r["t"]): (r["run"], r["all"]) for r in made.collect()}
    assert len(got) == len(rows)
    for k, series in by_key(rows).items():
        total = None
        for t, v in series:
            total = v if total is None else total if v is None else total + v
            run, n = got[k, t]
            assert n == len(series) and (run is None) == (total is None) and (run is None or run == pytest.approx(total))


@pytest.mark.parametrize("block_rows", [5, 10_000])
def test_peers_count_with_their_order(spark, block_rows):
    rows = [("a", t // 3, 1) for t in range(60)]
    made = se.running_sums(spark.createDataFrame(rows, "k string, t long, v int"), ["k"], "t", {"run": F.col("v")}, peers={"peer": F.col("v")}, block_rows=block_rows)
    got = made.collect()
    assert sorted(r["run"] for r in got) == list(range(1, 61)) and all(r["peer"] == 3 * (r["t"] + 1) for r in got)


@pytest.mark.parametrize("kind", ["double", "date", "timestamp", "string"])
def test_orders_of_other_types(spark, kind):
    to = {"double": F.col("t") / 7, "date": F.date_add(F.lit("2024-01-01").cast("date"), F.col("t").cast("int")), "timestamp": F.timestamp_seconds(F.col("t") * 1000), "string": F.lpad((F.col("t") + 500).cast("string"), 5, "0")}
    rows, df = table(spark)
    got = se.places(df.withColumn("o", to[kind]), ["k"], "o", "i", "n", block_rows=20).collect()
    want = {(k, t): (i, len(s)) for k, s in by_key(rows).items() for i, (t, _) in enumerate(s)}
    assert {(r["k"], r["t"]): (r["i"], r["n"]) for r in got} == want


def test_nulls_and_nan_in_the_order(spark):
    rows = [(None, 1), (float("nan"), 1), *((float(t), 1) for t in range(50))]
    got = se.running_sums(spark.createDataFrame(rows, "t double, v int"), [], "t", {"run": F.col("v")}, block_rows=6).collect()
    assert {(-1 if r["t"] is None else 99 if math.isnan(r["t"]) else r["t"]): r["run"] for r in got} == {-1: 1, 99: 52} | {t: t + 2 for t in range(50)}


def test_no_task_holds_a_whole_series(spark):
    """One key, very many blocks: the window's groups are blocks, and its rows are dealt by them."""
    df = spark.range(20_000).select(F.lit("one").alias("agent"), F.col("id").alias("draw"), (F.col("id") % 7).cast("double").alias("best_mean"), F.lit(1.0).alias("chosen_mean"))
    made = an.cumulative_regret(df, block_rows=500)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(agent#" in plan and all("__block" in line for line in plan.splitlines() if "Exchange hashpartitioning(agent" in line and "agent#" in line and "__row" in line)
    inside = made.withColumn("part", F.spark_partition_id()).groupBy("part").count()
    assert inside.count() == 4 and inside.agg(F.max("count")).first()[0] < 9_000
    assert made.agg(F.max(F.when(F.col("draw") == 19_999, F.col("cum_regret")))).first()[0] == pytest.approx(sum(k % 7 - 1 for k in range(20_000)))


@pytest.mark.parametrize(("width", "block_rows"), [(1, 10), (7, 10), (7, 1000), (41, 6), (301, 25)])
def test_moving_average_across_borders(spark, width, block_rows):
    rows, df = table(spark)
    got = {(r["k"], r["t"]): r["smooth"] for r in an.moving_average(df, ["k"], "t", "v", width, block_rows=block_rows).collect()}
    for k, series in by_key(rows).items():
        for i, (t, _) in enumerate(series):
            near = [v for _, v in series[max(0, i - width // 2) : i + width // 2 + 1] if v is not None]
            assert (got[k, t] is None) == (not near) and (not near or got[k, t] == pytest.approx(np.mean(near)))


@pytest.mark.parametrize(("sigma", "block_rows"), [(0.4, 10), (1.5, 7), (1.5, 1000), (30, 12)])
def test_gaussian_smoothing_across_borders_and_reflections(spark, sigma, block_rows):
    """sigma 30 reaches over short series many times."""
    rows, df = table(spark)
    got = {(r["k"], r["t"]): r["smooth"] for r in an.gaussian_smooth(df, ["k"], "t", "v", sigma, block_rows=block_rows).collect()}
    assert len(got) == len(rows)
    reach = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    for k, series in by_key(rows).items():
        v = np.array([x or 0.0 for _, x in series])
        place = np.arange(-reach, len(v) + reach) % (2 * len(v))
        whole = np.where(place < len(v), v[np.minimum(place, len(v) - 1)], v[np.clip(2 * len(v) - 1 - place, 0, len(v) - 1)])
        want = np.convolve(whole, weight / weight.sum(), "valid")
        assert [got[k, t] for t, _ in series] == pytest.approx(want.tolist())


@pytest.mark.parametrize("block_rows", [5, 40, 1000])
def test_autocorrelation_across_borders(spark, block_rows):
    rng = np.random.default_rng(3)
    chains = {c: np.cumsum(rng.normal(size=n)) + 1e6 for c, n in ((0, 150), (1, 9), (2, 60))}
    df = spark.createDataFrame([(c, d, float(v)) for c, x in chains.items() for d, v in enumerate(x)], "chain int, draw int, value double")
    got = {(r["chain"], r["lag"]): r["rho"] for r in dg.autocorrelation(df, 12, block_rows=block_rows).collect()}
    assert set(got) == {(c, k) for c, x in chains.items() for k in range(1, 13) if k < len(x)}
    for (c, k), rho in got.items():
        x = chains[c]
        if len(x) - k > 1:
            assert rho == pytest.approx(np.corrcoef(x[k:], x[:-k])[0, 1], abs=1e-6)


def test_the_lags_do_not_change_how_often_rows_move(spark):
    df = spark.range(400).select(F.lit(0).alias("chain"), F.col("id").alias("draw"), F.sin(F.col("id").cast("double")).alias("value"))

    def exchanges(lags):
        return dg.autocorrelation(df, lags, block_rows=50)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(2) == exchanges(300)


def test_lags_of_a_chain_with_nulls_and_beyond_a_block(spark):
    rng = np.random.default_rng(8)
    v = [None if k % 11 == 0 else float(x) for k, x in enumerate(rng.normal(size=90))]
    df = spark.createDataFrame([(0, d, x) for d, x in enumerate(v)], "chain int, draw int, value double")
    got = {r["lag"]: r["rho"] for r in dg.autocorrelation(df, 85, block_rows=7).collect()}
    for k in range(1, 86):
        pairs = [(a, b) for a, b in zip(v[k:], v, strict=False) if a is not None and b is not None]
        if len(pairs) > 2:
            assert got[k] == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-9)


def test_cumulative_share(spark):
    rows = [("a", t, float(t)) for t in range(1, 31)] + [("z", 1, 0.0)]
    got = an.cumulative_share(spark.createDataFrame(rows, "k string, t int, w double"), "w", ["k"], "t", block_rows=4)
    assert {(r["k"], r["t"]): r["share"] for r in got.collect()} == {("a", t): pytest.approx(t * (t + 1) / 930) for t in range(1, 31)} | {("z", 1): None}


def test_empty_series(spark):
    df = spark.createDataFrame([], "k string, t long, v double")
    assert an.running(df, "v", ["k"], "t", "s").count() == 0 and an.moving_average(df, ["k"], "t", "v", 5).count() == 0 and an.gaussian_smooth(df, ["k"], "t", "v", 1.0).count() == 0
