import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators.preprocess import Preprocessor
from thicket.plans.model import Model, fit, from_boosted
from thicket.sources.scenarios import generate
from thicket.streaming import agents as ag
from thicket.streaming import simulate as sm

SMALL = {"n_trees": 8, "ndpost": 12, "nskip": 10, "max_bins": 10}
FEATURES = [f"x{k}" for k in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    return generate(spark, "friedman1", 160, noise=0.2).cache()


@pytest.fixture(scope="module")
def model(data):
    return fit(data, FEATURES, "y", chains=2, seed=3, **SMALL)


def test_fit_is_the_same_on_any_partitioning(data, model):
    again = fit(data.repartition(5), FEATURES, "y", chains=2, seed=3, **SMALL)
    other = fit(data, FEATURES, "y", chains=2, seed=4, **SMALL)
    key = lambda m: [(r["chain"], r["draw"], r["sigma2"]) for r in m.trace.orderBy("chain", "draw").collect()]
    assert key(model) == key(again) != key(other)


def test_predictions(data, model):
    got = model.posterior_predict(model.predict(model.posterior_f(data)), "row_id", 1).toPandas()
    draws = np.stack(got["draws"])
    assert draws.shape == (160, 12)
    assert np.allclose(draws.mean(axis=1), got["prediction"])  # chains of equal length
    assert np.sqrt(np.mean((got["prediction"] - got["y"]) ** 2)) < got["y"].std()
    assert np.stack(got["predicted"]).std() > draws.std() * 0.9
    one = model.predict_trace(data, 4, "f").toPandas()
    assert np.allclose(one.sort_values("row_id")["f"], draws[np.argsort(got["row_id"])][:, 4])
    p = np.stack(model.predict_proba(data).toPandas()["proba"])
    assert ((p >= 0) & (p <= 1)).all()


def test_trace_tools(data, model):
    assert model.trace_length() == 6 and model.per_chain == 6
    assert model.histogram().groupBy("chain", "draw").count().count() == 12
    assert model.inclusion_frequency().agg(F.sum("frequency")).first()[0] == pytest.approx(1)
    assert model.inclusion_probability().count() == 5
    assert model.without(3).posterior_f(data).select(F.size("draws").alias("n")).first()["n"] == 11
    assert 0 <= model.sample(lambda k: 2.0**k, 1) < 12
    assert model.sigma_chains().count() == 12
    assert model.collect(lambda g: g.groupby("chain", as_index=False).agg(n=("draw", "size")), "chain int, n long").count() == 2
    assert {r["move"] for r in model.moves.collect()} == {"grow", "prune", "change", "swap"}
    assert model.params()["n_trees"] == 8


def test_save_and_load(spark, data, model, tmp_path):
    model.save(str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    a, b = (m.predict(data).orderBy("row_id").toPandas()["prediction"] for m in (model, back))
    assert np.allclose(a, b)
    assert back.update(data.where("row_id < 20"), 4).rows.count() == 180


def test_update_goes_on(spark, data, model):
    more = generate(spark, "friedman1", 220, noise=0.2).where("row_id >= 160")
    new = model.update(more, 8)
    assert new.trace.where("chain = 0").count() == 5  # four draws and the state they start from
    assert new.rows.count() == 220 and new.prep.thresholds == model.prep.thresholds


def test_shards_and_nulls(data):
    holes = data.withColumn("x0", F.when(F.col("row_id") < 10, None).otherwise(F.col("x0")))
    m = fit(holes, FEATURES, "y", seed=1, shards=2, **SMALL)
    assert m.rows.count() == 150 and m.trace.select("shard").distinct().count() == 2
    assert m.posterior_f(data.limit(3)).select(F.size("draws").alias("n")).first()["n"] == 12


def test_classes(data):
    rows = data.withColumn("label", F.when(F.col("y") > 14, "yes").otherwise("no"))
    probit = fit(rows, FEATURES, "label", "probit", seed=1, **SMALL)
    got = probit.posterior_predict(probit.predict(rows), "row_id", 2).toPandas()
    assert (got["prediction_label"] == got["label"]).mean() > 0.7
    assert set(np.stack(got["predicted"]).ravel()) <= {0, 1}
    three = rows.withColumn("label", F.when(F.col("y") > 17, "c").when(F.col("y") > 12, "b").otherwise("a"))
    logistic = fit(three, FEATURES, "label", "logistic", seed=1, n_trees=3, ndpost=6, nskip=6, max_bins=10)
    got = logistic.posterior_predict(logistic.predict_proba(three), "row_id", 2).toPandas()
    assert np.allclose(np.stack(got["proba"]).sum(axis=1), 1) and set(np.stack(got["predicted"]).ravel()) <= {0, 1, 2}
    assert "prediction_label" in logistic.predict(three).columns
    assert np.allclose(sum(logistic.predict_trace(three.limit(1), 2, "p").first()["p"]), 1)
    with pytest.raises(ValueError):
        fit(three, FEATURES, "label", "probit", **SMALL)
    with pytest.raises(ValueError):
        fit(rows, FEATURES, "label", "other", **SMALL)


def test_boosted_start(spark, data):
    prep = Preprocessor(FEATURES, "y", 5).fit(data)
    dump = [{"nodeid": 0, "split": "f0", "split_condition": 0.5, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -0.25}, {"nodeid": 2, "leaf": 0.25}]}]
    got = from_boosted(spark, dump, prep).predict(data).toPandas()
    f = np.where(got["x0"] < 0.5, -0.25, 0.25)
    assert np.allclose(got["prediction"], (prep.high - prep.low) * (f + 0.5) + prep.low)


# -- agents ------------------------------------------------------------------------------------------------------------


def test_linear_agents():
    rng = np.random.default_rng(1)
    rows = [(int(a), rng.random(3), float(rng.normal())) for a in rng.integers(0, 2, 60)]
    ucb = ag.LinearAgent(2, 3, "ucb")
    for a, x, y in rows:
        ucb.update(a, x, y)
    z = np.array([np.append(x, 1) for a, x, _ in rows if a == 1])
    y = np.array([y for a, _, y in rows if a == 1])
    b = np.eye(4) + z.T @ z
    x = np.array([0.2, 0.4, 0.6, 1.0])
    inv = np.linalg.inv(b)
    assert ucb.scores(x[:3])[1] == pytest.approx(x @ inv @ (z.T @ y) + np.sqrt(x @ inv @ x))
    ts = ag.LinearAgent.from_sums([(m - np.eye(4), h) for m, h in zip(ucb.b, ucb.m, strict=True)], kind="ts", v=0.5, seed=2)
    draws = ts.draws(x[None, :3], 20_000)[:, 0, 1]
    assert draws.mean() == pytest.approx(x @ inv @ (z.T @ y), abs=0.02) and draws.std() == pytest.approx(0.5 * np.sqrt(x @ inv @ x), rel=0.05)
    with pytest.raises(ValueError):
        ag.LinearAgent(2, 3, "other")
    with pytest.raises(ValueError):
        ag.RandomAgent(3, 1, [0.5, 0.5])


@pytest.mark.parametrize("encoding", ["multi", "one-hot", "separate"])
def test_tree_agent_learns(encoding):
    rng = np.random.default_rng(2)
    agent = ag.TreeAgent(2, 2, encoding=encoding, warm=10, n_trees=8, ndpost=100, nskip=20, seed=1, feel_good=0.01)
    hits = []
    for _ in range(90):
        x = rng.random(2)
        arm = agent.choose(x)
        mean = [1.0 * (x[0] > 0.5), 1.0 * (x[0] <= 0.5)]
        hits.append(mean[arm])
        agent.update(arm, x, mean[arm] + 0.05 * rng.normal())
    assert sorted(agent.queue) == [0] * 10 + [1] * 10
    assert agent.refits > 0 and np.mean(hits[-30:]) > 0.7
    assert 1 <= agent.effective() <= len(agent.weights())
    seen = np.array([x for _, x, _ in agent.log])
    assert np.allclose(agent.score, agent._good(seen).sum(axis=0))  # kept up to date one by one
    if encoding == "separate":
        assert agent.inclusion().shape == (2,) and not ag.TreeAgent(2, 2, encoding="separate").enough()
    else:
        with pytest.raises(ValueError):
            agent.inclusion()


def test_other_tree_agents():
    rng = np.random.default_rng(3)
    for agent in (
        ag.TreeAgent(2, 1, "logistic", "one-hot", "sqrt", 4, n_trees=3, ndpost=30, nskip=5),
        ag.SwitchingAgent(2, 1, switch=15, late_chains=2, schedule="sqrt", warm=5, n_trees=4, ndpost=30, nskip=5, early={"n_trees": 3, "nskip": 2}),
        ag.TreeAgent(2, 1, schedule="hybrid", warm=3, quick_decay=True, feel_good_eta=2.0, n_trees=3, ndpost=30, nskip=5),
    ):
        for _ in range(30):
            x = rng.random(1)
            arm = agent.choose(x)
            agent.update(arm, x, float(rng.random() < x[0]))
        assert agent.refits > 0 and agent.probes(np.array([[0.5]])).shape[:2] == (1, 2)
    with pytest.raises(ValueError):
        ag.TreeAgent(2, 1, encoding="other")


def test_agents_round_trip():
    trees = ag.TreeAgent(2, 1, warm=3, schedule="sqrt", n_trees=3, ndpost=30, nskip=5)
    linear, silly = ag.LinearAgent(2, 1, "ts"), ag.RandomAgent(2, 1, [0.2, 0.8])
    rng = np.random.default_rng(4)
    for agent in (trees, linear, silly):
        for _ in range(20):
            x = rng.random(1)
            agent.update(agent.choose(x), x, float(rng.random()))
        back = ag.from_json(ag.to_json(agent))
        for _ in range(30):
            x = rng.random(1)
            assert agent.choose(x) == back.choose(x)
    with pytest.raises(NotImplementedError):
        ag.to_json(ag.TreeAgent(2, 1, "logistic"))
    assert json.loads(ag.to_json(silly))["p"] == [0.2, 0.8]


def test_simulation(spark, tmp_path):
    specs = {"random": {"agent": "random"}, "ucb": {"agent": "linear", "kind": "ucb"}}
    worlds = {"w": {"kind": "linear", "features": 3, "arms": 3}}
    sim = sm.compare(spark, worlds, specs, 2, 60)
    total = {(r["agent"], r["sim"]): r["s"] for r in sim.groupBy("agent", "sim").agg(F.sum("regret").alias("s")).collect()}
    assert len(total) == 4 and total[("ucb", 0)] < total[("random", 0)]
    sm.to_json_lines(sim, str(tmp_path / "j"))
    assert sm.read_json_lines(spark, str(tmp_path / "j"), "^rand").count() == 120
    seen = []
    table = sm.TableScenario(np.array([[0.0], [1.0]]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    rows = sm.simulate(table, {"r": ag.RandomAgent(2, 1)}, 5, lambda d, a: seen.append(d) or 1 / 0)
    assert len(rows) == 2 and seen == [1, 2]


def replay_rows(n=80):
    r = random.Random(5)
    return [(t, [r.random(), r.random()], r.randint(1, 3), r.random()) for t in range(n)]


def test_replay(spark):
    log = spark.createDataFrame(replay_rows(), "t long, x array<double>, action int, reward double")
    specs = {"u": {"agent": "linear", "arms": 3, "features": 2, "kind": "ucb"}, "r": {"agent": "random", "arms": 3, "features": 2}}
    got = sm.replay(log, specs, choices=2).toPandas().sort_values(["agent", "t"])
    for name in specs:
        agent, mine = ag.make(specs[name], 0), got[got["agent"] == name]
        want = list(sm.replay_log([(t, x, a - 1, y) for t, x, a, y in replay_rows()], agent, 2))
        assert mine["first"].tolist() == [w[2] for w in want] and mine["matched"].tolist() == [w[3] for w in want]
    assert sm.replay(log, specs, mode="logged").agg(F.min("matched")).first()[0] == 1
    with pytest.raises(ValueError):
        list(sm.replay_log([(0, [0.0], 0, 0.0)], ag.RandomAgent(2, 1), mode="other"))


def test_replay_stream_is_the_batch(spark, tmp_path):
    schema = "t long, x array<double>, action int, reward double"
    rows = [(t, x, a - 1, y) for t, x, a, y in replay_rows(60)]
    specs = {"u": {"agent": "linear", "arms": 3, "features": 2, "kind": "ucb"}}
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = sm.replay_stream(stream, specs).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("replayed").count() == 60
    batch = sm.replay(spark.createDataFrame(rows, schema), specs).toPandas().sort_values("t")
    live = spark.table("replayed").toPandas().sort_values("t")
    assert live["first"].tolist() == batch["first"].tolist()


def test_linear_statistics_are_the_agents_sums(spark):
    log = spark.createDataFrame([(t, x, a - 1, y) for t, x, a, y in replay_rows()], "t long, x array<double>, action int, reward double")
    sums = sm.gather_statistics(sm.linear_statistics(log, 2), 2, 4)
    agent = ag.LinearAgent(4, 2)
    for _, x, a, y in replay_rows():
        agent.update(a - 1, x, y)
    made = ag.LinearAgent.from_sums(sums)
    assert np.allclose(made.b, agent.b) and np.allclose(made.m, agent.m)
