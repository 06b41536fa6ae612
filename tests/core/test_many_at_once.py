"""What is made for many rows at once is what was made row by row, without work for each step."""

import time

import numpy as np
import pytest

from thicket.functions.special import chi2_ppf, chi2_ppf_all
from thicket.streaming.agents import LinearAgent, RandomAgent, refresh_index, steps_to_refresh
from thicket.streaming.simulate import _replayed, replay_log


@pytest.mark.parametrize("schedule", ["log", "sqrt", "hybrid", "rev_hybrid"])
def test_steps_to_refresh_are_found_by_halving(schedule):
    def plain(t):
        k = 1
        while refresh_index(t + k, schedule) <= refresh_index(t + k - 1, schedule):
            k += 1
        return k

    assert all(steps_to_refresh(t, schedule) == plain(t) for t in [*range(1, 200), 1999, 2000, 2001, 5000])
    begun = time.perf_counter()
    assert steps_to_refresh(10**13, "sqrt") > 10**5
    assert time.perf_counter() - begun < 0.1


def test_chi_squared_quantiles_of_arrays():
    q = np.concatenate([np.random.default_rng(1).random(200), [1e-9, 0.5, 0.999999]])
    df = np.resize([1.0, 2.0, 3.5, 6.0, 40.0], len(q))
    assert chi2_ppf_all(q, df) == pytest.approx([chi2_ppf(a, b) for a, b in zip(q, df, strict=True)], rel=1e-10)
    assert len(chi2_ppf_all(q[:0], df[:0])) == 0


@pytest.mark.parametrize("mode", ["replay", "logged"])
@pytest.mark.parametrize("make", [lambda: LinearAgent(3, 2, "ucb"), lambda: RandomAgent(3, 2, seed=4), lambda: LinearAgent(3, 2, "ts", seed=1)])
def test_a_block_of_events_is_replayed_as_one_by_one(make, mode):
    rng = np.random.default_rng(2)
    x, action, reward = rng.integers(0, 6, (700, 2)) / 6, rng.integers(0, 3, 700), rng.normal(size=700)
    action[action == 2] = 1
    plain, agent = make(), make()
    want = list(replay_log(zip(range(700), x, action, reward, strict=True), plain, 2, mode))
    parts = [p for k in (0, 300) for p in _replayed("a", (np.arange(700)[k : k + 300 + k], x[k : k + 300 + k], action[k : k + 300 + k], reward[k : k + 300 + k]), agent, 2, mode)]
    got = [tuple(r[1:]) for p in parts for r in p.itertuples(index=False, name=None)]
    assert [(*r[:4], list(r[4])) for r in got] == [(int(r[0]), int(r[1]), *r[2:4], list(r[4])) for r in want]
    if isinstance(agent, LinearAgent):
        assert np.array_equal(agent.b, plain.b) and np.array_equal(agent.m, plain.m)
        assert agent.replay_block(x, action, reward, 1, True) is None or agent.kind == "ucb"  # draws go one by one


def test_exact_intervals_beyond_what_a_sketch_keeps(spark):
    from pyspark.sql import functions as F

    from thicket.operators import posterior as po

    rows = spark.range(40_000).select((F.col("id") % 2).alias("g"), (F.xxhash64("id") % 100_003).cast("double").alias("f"))
    merged = po.merged_sketches(po.sketches(rows, ["g"], k=50), ["g"])
    got = {r["g"]: (r["lo"], r["hi"]) for r in po.exact_intervals(rows, ["g"], merged, level=0.8, k=50).collect()}
    every = rows.toPandas().groupby("g")["f"]
    assert got == {g: (np.sort(v)[1999], np.sort(v)[17999]) for g, v in every}
    far = merged.join(rows.where("f < 0").groupBy("g").agg(F.kll_sketch_agg_double("f", F.lit(50)).alias("s")), "g").select("g", F.col("s").alias("sketch"))
    assert {r["g"]: (r["lo"], r["hi"]) for r in po.exact_intervals(rows, ["g"], far, level=0.8, k=50).collect()} == got  # brackets that miss


def test_diagnostics_of_rows_are_those_of_each(spark):
    from thicket.operators import diagnostics as dg

    rng = np.random.default_rng(5)
    draws = [rng.normal(size=47).tolist(), np.round(rng.normal(size=47)).tolist(), np.cumsum(rng.normal(size=47)).tolist(), [1.0] * 47]
    rows = spark.createDataFrame(list(enumerate(draws)), "k int, d array<double>")
    got = dg.rank_diagnostics_of_rows(rows, ["k"], "d", [24, 23]).orderBy("k").toPandas().drop(columns="k").to_numpy()
    for made, d in zip(got, draws, strict=True):
        x = np.stack([np.array(d[:23]), np.array(d[24:])])
        with np.errstate(all="ignore"):
            want = [dg.rank_rhat(x), dg.bulk_ess(x), dg.mcse(x), dg.mcse(x) / x.std(ddof=1)]
        assert made == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_a_part_of_a_large_mesh_is_that_of_least_hashes(spark):
    from pyspark.sql import functions as F

    from thicket.sources.scenarios import _least

    ids = spark.range(60_000)
    mixed = F.xxhash64("id", F.lit(42))
    want = {r["id"] for r in ids.orderBy(mixed, "id").limit(20_001).collect()}
    made = _least(ids, mixed, 20_001)
    assert {r["id"] for r in made.collect()} == want and made.count() == 20_001 and made.rdd.getNumPartitions() > 1


def test_bessel_needs_few_steps():
    from thicket.functions.special import log_bessel_k

    x = np.geomspace(1e-3, 1e3, 2000)
    assert np.allclose(log_bessel_k(0.5, x[:2000]), 0.5 * np.log(np.pi / (2 * x[:2000])) - x[:2000], atol=1e-9, rtol=1e-12)
    assert np.allclose(log_bessel_k(1.5, x[800:2000]), 0.5 * np.log(np.pi / (2 * x[800:2000])) - x[800:2000] + np.log1p(1 / x[800:2000]), atol=1e-9, rtol=1e-12)
    few = np.linspace(0.3, 30, 20_000)
    begun = time.perf_counter()
    log_bessel_k(2.5, few)
    assert time.perf_counter() - begun < 1.5
