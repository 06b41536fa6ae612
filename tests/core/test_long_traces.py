from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.functions.columns import normal_quantile
from thicket.operators import diagnostics as dg
from thicket.operators import long_traces as lt


def test_normal_quantile(spark):
    p = [1e-300, 1e-30, 1e-12, 1e-7, 0.001, 0.0749, 0.075, 0.3, 0.5, 0.7, 0.925, 0.9251, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-13, abs=1e-15) for r in got)


def traces():
    """Keys of chains: mixing well and slowly, apart, of equal and of few values, of odd and of different lengths."""
    rng = np.random.default_rng(2)
    slow = np.zeros((3, 260))
    for t in range(1, 260):
        slow[:, t] = 0.95 * slow[:, t - 1] + rng.normal(size=3)
    return {
        "well": list(rng.normal(size=(4, 101))),
        "slow": list(slow),
        "apart": list(rng.normal(size=(2, 60)) + np.array([[0], [4]])),
        "few": list(rng.integers(0, 3, (3, 80)).astype(float)),
        "lengths": [rng.normal(size=n) for n in (40, 33, 51)],
        "short": list(rng.normal(size=(2, 9))),
    }


@pytest.mark.parametrize("block_rows", [25, 10_000])
def test_as_over_whole_arrays(spark, block_rows, monkeypatch):
    monkeypatch.setattr(lt, "FIRST_LAGS", 8)
    rows = [(k, c, d, float(v)) for k, chains in traces().items() for c, x in enumerate(chains) for d, v in enumerate(x)]
    rows += [("well", 0, 1000, None)]
    df = spark.createDataFrame(rows, "key string, chain int, draw int, value double").repartition(4)
    got = {r["key"]: r for r in lt.long_rank_diagnostics(df, ["key"], block_rows=block_rows).collect()}
    assert set(got) == set(traces())
    for key, chains in traces().items():
        x = np.stack([c[: min(map(len, chains))] for c in chains])
        err = dg.mcse(x)
        want = (dg.rank_rhat(x), dg.bulk_ess(x), err, err / x.std(ddof=1))
        assert [got[key][c] for c in ("rhat", "ess_bulk", "mcse", "mcse_sd")] == pytest.approx(want, rel=1e-8), key


def test_factors_without_python(spark):
    df = spark.range(400).select(F.lit(1).alias("key"), (F.col("id") % 2).alias("chain"), F.col("id").alias("draw"), F.sin(F.col("id").cast("double") * 7).alias("value"))
    made = lt.rank_rhats(df, ["key"], block_rows=30)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and 0.9 < made.first()["rhat"] < 1.1


def test_values_that_are_alike_and_no_rows(spark):
    df = spark.createDataFrame([(1, c, d, 2.0) for c in range(2) for d in range(12)], "key int, chain int, draw int, value double")
    got = lt.long_rank_diagnostics(df, ["key"]).first()
    assert got["rhat"] is None or got["rhat"] != got["rhat"]
    assert got["ess_bulk"] == 24 and got["mcse"] == 0
    assert lt.long_rank_diagnostics(df.where("key > 1"), ["key"]).count() == 0
    for n in (1, 2, 3):
        got = lt.long_rank_diagnostics(df.where(f"draw < {n}"), ["key"]).collect()
        assert all(r["ess_bulk"] != r["ess_bulk"] for r in got)
