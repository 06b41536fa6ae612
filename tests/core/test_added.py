"""Warm starts, models that go on after loading, models by arm, plug-ins, callbacks and frames."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import analytics as an
from thicket.operators import forest as fo
from thicket.operators import preprocess as pp
from thicket.plans.chain import CONTRARY, Gaussian, RegressionChain, log_prior
from thicket.plans.model import Model, fit
from thicket.plans.separate import fit_each
from thicket.sources.files import resumed, stored
from thicket.sources.prior import heatmap, prior_heatmap
from thicket.sources.scenarios import generate
from thicket.streaming import agents as ag
from thicket.streaming import simulate as sm

SMALL = {"n_trees": 6, "ndpost": 8, "nskip": 5, "max_bins": 10}
FEATURES = [f"x{k}" for k in range(5)]
DUMP = [
    {"nodeid": 0, "split": "f0", "split_condition": 0.5, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.1}, {"nodeid": 2, "split": "f3", "split_condition": 0.25, "yes": 3, "no": 4, "children": [{"nodeid": 3, "leaf": 0.0}, {"nodeid": 4, "leaf": 0.2}]}]},
    {"nodeid": 0, "split": "f1", "split_condition": 7.0, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": 0.05}, {"nodeid": 2, "leaf": 9.0}]},
]  # no row reaches the last leaf


@pytest.fixture(scope="module")
def data(spark):
    return generate(spark, "friedman1", 160, noise=0.2).cache()


def test_chains_start_from_a_boosted_forest(data):
    m = fit(data, FEATURES, "y", chains=2, seed=3, boosted=DUMP, ndpost=6, nskip=0, max_bins=10)
    assert m.settings.n_trees == 2
    first = m.trace.where("draw = -1").collect()
    assert len(first) == 2 and first[0]["sigma2"] != first[1]["sigma2"]
    for r in first:
        trees = [{n["node"]: (n["var"], n["leaf"]) for n in t} for t in r["trees"]]
        assert {k: v for k, (v, _) in trees[0].items()} == {0: 0, 1: -1, 2: 3, 5: -1, 6: -1}
        assert trees[0][1][1] != -0.1 and trees[1][2][1] == 9.0  # redrawn where rows are
    assert m.trace.where("draw >= 0").count() == 6
    got = m.posterior_f(data).toPandas()
    assert np.isfinite(np.stack(got["draws"])).all()
    with pytest.raises(ValueError):
        fit(data, FEATURES, "y", "probit", boosted=DUMP)


def test_a_loaded_model_goes_on(spark, data, tmp_path):
    m = fit(data.where("row_id < 120"), FEATURES, "y", seed=3, **SMALL)
    m.save(str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    a, b = (x.update(data.where("row_id >= 120"), 4) for x in (m, back))
    key = lambda x: [(r["draw"], r["sigma2"]) for r in x.trace.orderBy("draw").collect()]
    assert key(a) == key(b) and back.rows.count() == 120 and b.rows.count() == 160
    m.save(str(tmp_path / "n"), rows=False)
    with pytest.raises(ValueError):
        Model.load(spark, str(tmp_path / "n")).update(data)


def test_posterior_sample_and_control(data):
    m = fit(data, FEATURES, "y", chains=2, seed=3, **SMALL)
    only = m.posterior_sample(data, lambda k: float(k == 5), 1).toPandas().sort_values("row_id")["f"]
    assert np.allclose(only, m.predict_trace(data, 5).toPandas().sort_values("row_id")["f"])
    assert m.is_fitted and m.range_post() == range(0, 8) and m.set_ndpost(3).range_post() == range(5, 8)
    assert m.set_ndpost(3).posterior_f(data).select(F.size("draws").alias("n")).first()["n"] == 3
    assert m.set_max_bins(7).params()["max_bins"] == 7
    with pytest.raises(ValueError):
        m.set_ndpost(99).range_post()


@pytest.mark.parametrize("kind", ["regression", "probit", "logistic"])
def test_models_by_arm(data, kind):
    rows = data.withColumn("arm", (F.col("row_id") % 3).cast("int"))
    if kind != "regression":
        rows = rows.withColumn("y", (F.col("y") > 14).cast("double"))
    m = fit_each(rows, "arm", FEATURES, "y", kind, chains=2, **SMALL)
    assert m.names() == ["0", "1", "2"] and len(m) == 3
    assert {(r["model"], r["chain"]): (r["draws"], r["rows"]) for r in m.effective().collect()} == {(str(a), c): (4, 54 if a == 0 else 53) for a in range(3) for c in range(2)}
    got = m.posterior_f(m.posterior_f_batch(rows, "all"), "own").toPandas()
    for r in got.itertuples():
        assert len(r.all) == 3 and np.allclose(r.all[str(r.arm)], r.own) and len(r.own) == 8
    if kind == "logistic":
        assert np.stack(got["own"]).min() >= 0 and np.stack(got["own"]).max() <= 1
    mean = m.predict_batch(rows, "m").toPandas()
    assert np.isclose(mean["m"][0]["1"], np.mean(got.set_index("row_id").loc[mean["row_id"][0], "all"]["1"]))
    again = m.refit(rows.where("arm = 1 and row_id < 90"))
    assert again.names() == m.names() and {r["model"]: r["rows"] for r in again.effective().collect()} == {"0": 54, "1": 30, "2": 53}
    assert m["2"].where("draw >= 0 and category = 0").count() == 8
    assert m.posterior_f(rows.withColumn("arm", F.lit(7)), "own").where("own is not null").count() == 0


def test_moves_priors_likelihoods_and_chains_of_ones_own(data):
    def same(proposer, tree):
        return tree, 0.0

    m = fit(data, FEATURES, "y", moves={"grow": 0.4, "prune": 0.4, "same": 0.2}, proposals={"same": same}, prior=lambda t, s: 2 * log_prior(t, s), likelihood=Gaussian, **SMALL)
    moves = {r["move"]: r for r in m.moves.collect()}
    assert moves["same"]["proposed"] == moves["same"]["accepted"] > 0 and CONTRARY["grow"] == "prune"
    assert "proposals" not in m.params()

    class Fixed(RegressionChain):
        def sigma2(self, resid):
            return 0.125

    own = fit(data, FEATURES, "y", sampler=lambda x, y, cuts, s, seed: Fixed(x, y, cuts, s, seed), **SMALL)
    assert {r["sigma2"] for r in own.trace.collect()} == {0.125}

    class Halved(pp.Preprocessor):
        def fit(self, df):
            super().fit(df)
            self.high = 2 * self.high
            return self

    assert fit(data, FEATURES, "y", prep=Halved(FEATURES, "y", 10), **SMALL).prep.high > 1.9 * data.agg(F.max("y")).first()[0]


def test_metrics_factories_and_any_model():
    told, out = [], []
    factory = lambda arms, features, seed: ag.RandomAgent(arms, features, seed=seed)
    agents = {"mine": ag.make({"factory": factory, "arms": 2, "features": 3}, 1), "ucb": ag.make({"agent": "linear", "kind": "ucb", "arms": 2, "features": 3}, 1)}
    out = sm.simulate(sm.LinearScenario(3, 2, seed=2), agents, 10, on_metrics=lambda t, sums: told.append((t, sums)), every=4)
    assert [t for t, _ in told] == [4, 8, 10]
    assert told[-1][1]["ucb"][0] == pytest.approx(sum(r[3] for r in out if r[0] == "ucb"))
    assert len(sm.simulate(sm.LinearScenario(3, 2, seed=2), agents, 3, on_metrics=lambda *_: 1 / 0)) == 6

    def least_squares(x, y, seed):
        w = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
        return lambda z, k: np.column_stack([np.ones(len(z)), z]) @ w

    agent = ag.make({"agent": "model", "fit": least_squares, "arms": 2, "features": 1, "warm": 4, "schedule": "sqrt"}, 3)
    for _ in range(60):
        a = agent.choose([0.5])
        agent.update(a, [0.5], float(a))
    assert agent.choose([0.5]) == 1
    flat = ag.make({"agent": "model", "fit": lambda *_: 1 / 0, "arms": 2, "features": 1, "warm": 4, "schedule": "sqrt"}, 3)
    for _ in range(30):
        flat.update(flat.choose([0.5]), [0.5], 1.0)
    assert flat.model(np.zeros((2, 2)), 0).tolist() == [1.0, 1.0]


def test_agent_diagnostics(spark):
    agent = ag.TreeAgent(2, 2, encoding="multi", warm=6, chains=2, seed=5, n_trees=5, ndpost=40, nskip=10)
    r = np.random.default_rng(2)
    for _ in range(30):
        x = r.random(2)
        agent.update(agent.choose(x), x, float(x[0]))
    got = ag.diagnose(spark, agent, r.random((3, 2))).toPandas()
    assert sorted(zip(got["probe"], got["arm"], strict=True)) == [(p, a) for p in range(3) for a in range(2)]
    assert (got["ess_bulk"] > 0).all()


def test_scenario_of_a_log(spark):
    log = spark.createDataFrame([(0.0, 1.0, 0, 1), (0.0, 1.0, 0, 0), (0.0, 1.0, 1, 1), (1.0, 0.0, 1, 0)], "a double, b double, arm long, hit int")
    s = sm.scenario_of_log(log, ["a", "b"], "arm", F.col("hit"), 2)
    assert s.contexts.tolist() == [[0.0, 1.0], [1.0, 0.0]] and s.chances.tolist() == [[0.5, 1.0], [0.5, 0.0]] and s.most == 2


def test_frames(spark, tmp_path):
    sim = spark.createDataFrame([(a, i, t, float((i + 1) * math.log(t + 1))) for a in ("x", "y") for i in range(2) for t in range(1, 30)], "agent string, sim int, draw int, regret double")
    band = {(r["agent"], r["draw"]): r for r in an.curve_band(sim, "regret", ["agent"]).collect()}
    row = band[("x", 3)]
    assert (row["n"], row["mean"], row["high"]) == (2, pytest.approx(1.5 * math.log(4)), pytest.approx(2 * math.log(4)))
    assert {r["agent"]: r["best"] for r in an.complexity(sim, "regret", ["agent"]).collect()} == {"x": "log", "y": "log"}
    a, b = (spark.createDataFrame(rows, "move string, n long") for rows in ([("grow", 2), ("prune", 1)], [("swap", 4), ("grow", 3)]))
    assert {r["move"]: r["n"] for r in an.merged_counts(a, b, "move", ["n"]).collect()} == {"grow": 5, "prune": 1, "swap": 4}
    grid = spark.createDataFrame([(k,) for k in range(5)], "k int")
    runs = []

    def run(points):
        runs.append(points.count())
        return points.withColumn("v", F.col("k") * 2)

    path = str(tmp_path / "results")
    resumed(spark, grid.where("k < 3"), path, ["k"], run)
    assert resumed(spark, grid, path, ["k"], run).count() == 5 and runs == [3, 2]
    assert stored(grid, "g").count() == 5
    forest = [{0: fo.split(0, 0.5), 1: fo.leaf(1.0), 2: fo.leaf(2.0)}]
    assert heatmap(spark, forest, 4).groupBy("f").count().orderBy("f").collect() == [(1.0, 8), (2.0, 8)]
    assert prior_heatmap(spark, 6, n_trees=3).count() == 36


def test_exact_quantiles_of_many_values_and_of_few(spark, monkeypatch):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=500), np.zeros(100)])
    df = spark.createDataFrame([(float(v), float(k % 7)) for k, v in enumerate(x)] + [(None, 3.0)], "a double, b double").repartition(3)
    want = [np.unique(np.quantile(x, np.arange(20) / 20)).tolist(), np.unique(np.quantile([k % 7 for k in range(600)] + [3.0], np.arange(20) / 20)).tolist()]
    for most in (10**6, 0):
        monkeypatch.setattr(pp, "DISTINCT_AT_ONCE", most)
        got = pp.quantile_thresholds(df, ["a", "b"], 20)
        assert [g == pytest.approx(w) for g, w in zip(got, want, strict=True)] == [True, True]
    assert [t["threshold"] for t in pp.unique_values(df, "b").orderBy("threshold").collect()] == [float(k) for k in range(7)]


def test_a_stream_appends_to_what_agents_have_seen(spark, tmp_path):
    r = np.random.default_rng(5)
    schema = "t long, x array<double>, action int, reward double"
    rows = [(t, [float(v) for v in r.random(2)], int(r.integers(2)), float(r.random())) for t in range(90)]
    specs = {"trees": {"agent": "trees", "arms": 2, "features": 2, "encoding": "separate", "warm": 4, "schedule": "sqrt", "n_trees": 2, "ndpost": 5, "nskip": 2}, "ucb": {"agent": "linear", "arms": 2, "features": 2, "kind": "ucb"}}
    for part in range(3):
        spark.createDataFrame(rows[30 * part : 30 * part + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    key, made = "spark.sql.streaming.stateStore.providerClass", {}
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        for appended in (True, False):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            name = f"kept_{appended}"
            q = sm.replay_stream(stream, specs, mode="logged", appended=appended).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()
            made[appended] = sorted((x["agent"], x["t"], x["first"]) for x in spark.table(name).collect())
    finally:
        spark.conf.set(key, before)
    assert len(made[True]) == 180 and made[True] == made[False]


def test_only_values_near_a_quantile_are_counted_one_by_one(spark, monkeypatch):
    from pyspark.sql import functions as F

    from thicket.operators import preprocess as pp

    nan = F.lit(float("nan"))
    df = spark.range(60_000).select(F.rand(1).alias("a"), F.round(F.rand(2) * 500).alias("b"), F.when(F.rand(3) < 0.9, F.rand(4)).alias("c"), F.when(F.col("id") % 9 == 0, nan).otherwise(F.randn(5)).alias("d")).cache()
    at = [k / 20 for k in range(20)]
    near, all_ = pp._near_counts(df, list("abc"), at), pp._counts(df, list("abc"))
    assert near.count() < all_.count() / 10
    for i, c in enumerate("abc"):
        assert near.where(F.col("f") == i).agg(F.sum("count")).first()[0] == df.where(F.col(c).isNotNull()).count()
    assert repr(pp._ranged_quantiles(near, list("abc"), at)) == repr(pp._ranged_quantiles(all_, list("abc"), at))
    numbers = lambda found: [sorted(v for v in own if v == v) for own in found]
    want = numbers(pp._ranged_quantiles(pp._counts(df, list("abcd")), list("abcd"), at))
    monkeypatch.setattr(pp, "DISTINCT_AT_ONCE", 10)
    assert numbers(pp.quantile_thresholds(df, list("abcd"), 20)) == want
    wrong = near.withColumn("loose", F.lit(True))  # a sketch that erred
    assert pp._ranged_quantiles(wrong, list("abc"), at) is None
    monkeypatch.setattr(pp, "_near_counts", lambda *args: wrong)
    assert numbers(pp.quantile_thresholds(df, list("abc"), 20)) == want[:3]
