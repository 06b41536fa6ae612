import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from thicket.functions import columns as fc
from thicket.operators import analytics as an
from thicket.operators import diagnostics as dg
from thicket.operators import forest as fo
from thicket.operators import metrics as me
from thicket.operators import posterior as po
from thicket.operators import preprocess as pp
from thicket.operators import stats as st
from thicket.sources import files
from thicket.sources import scenarios as sc
from thicket.sources.prior import draw_forest, prior_predictive, split_chance

TREE = {0: fo.split(0, 0.5), 1: fo.split(1, 0.3), 2: fo.leaf(3.0), 3: fo.leaf(1.0), 4: fo.leaf(2.0)}
OTHER = {0: fo.leaf(0.25)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 2))
    x[:5] = [[0.5, 0.3], [0.5, 0.30001], [0.50001, 0.1], [0.0, 1.0], [1.0, 0.0]]
    pdf = pd.DataFrame({"row_id": range(300), "a": x[:, 0], "b": x[:, 1], "y": rng.normal(size=300)})
    return spark.createDataFrame(pdf).withColumn("x", F.array("a", "b")).cache()


def test_three_evaluators_agree(rows):
    cols = [F.col("a"), F.col("b")]
    var, thr, _ = fo.tree_columns(TREE)
    made = fo.with_draws(rows, [[TREE, OTHER], [TREE]])
    got = made.select("a", "b", "draws", fo.case_leaf(TREE, cols).alias("c"), fo.walk_leaf(var, thr, F.col("x"), fo.tree_depth(TREE)).alias("w"), fo.case_forest([TREE, OTHER], cols).alias("f")).collect()
    for r in got:
        leaf = 2 if r["a"] > 0.5 else 3 if r["b"] <= 0.3 else 4
        value = {2: 3.0, 3: 1.0, 4: 2.0}[leaf]
        assert r["c"] == r["w"] == leaf and r["f"] == value + 0.25 and r["draws"] == [value + 0.25, value]
    one = rows.select(fo.case_forest([TREE, OTHER], cols, tree_ids=[1]).alias("t"), fo.case_forest([TREE, OTHER], cols, all_except=[1]).alias("e")).first()
    assert one["t"] == 0.25 and one["e"] in (1.0, 2.0, 3.0)


def test_counts_and_boxes(rows):
    basis = fo.leaf_rows(rows, [TREE], [F.col("a"), F.col("b")], ["row_id"])
    n = {r["node"]: r["n"] for r in fo.node_counts(basis, 3).collect()}
    assert n[0] == 300 and n[1] == n[3] + n[4] and n[0] == n[1] + n[2]
    assert [leaf for leaf, _ in fo.boxes(TREE, 2)] == [3, 4, 2]


def test_edits_and_interchange():
    grown = fo.split_leaf(TREE, 2, 1, 0.7, 5.0, 6.0)
    assert fo.leaves(grown) == [3, 4, 5, 6] and fo.terminal_splits(grown) == [1, 2] and fo.nonterminal_splits(grown) == [0]
    assert fo.leaves(fo.prune_split(grown, 1, 9.0)) == [1, 5, 6]
    assert fo.prune_split(grown, 0, 9.0, recursive=True) == {0: fo.leaf(9.0)}
    assert fo.swap_split(grown, 0, 1)[0] == fo.split(1, 0.3)
    assert fo.change_split(grown, 0, 1, 0.1)[0].thr == 0.1 and fo.set_leaf(grown, 3, 8.0)[3].leaf == 8.0
    for bad in (lambda: fo.split_leaf(TREE, 0, 0, 0.1), lambda: fo.prune_split(grown, 0), lambda: fo.swap_split(TREE, 0, 2), lambda: fo.change_split(TREE, 2, 0, 0.1), lambda: fo.set_leaf(TREE, 0, 1.0), lambda: fo.check({0: fo.split(0, 1.0)})):
        with pytest.raises(ValueError):
            bad()
    assert fo.from_json(fo.to_json([grown, OTHER])) == [grown, OTHER]
    assert fo.from_heap(*fo.heap(grown)) == grown
    assert fo.to_text(TREE, {0: 3, 1: 2, 2: 1, 3: 1, 4: 1}).splitlines()[0] == "#0 x0 <= 0.5 [3 rows]"
    assert fo.to_dot(TREE).count("->") == 4


def test_boosted_import():
    dump = {"nodeid": 0, "split": "f1", "split_condition": 0.5, "yes": 1, "no": 2, "children": [{"nodeid": 1, "leaf": -1.0}, {"nodeid": 2, "split": 0, "split_condition": 2.0, "yes": 4, "no": 3, "children": [{"nodeid": 3, "leaf": 7.0}, {"nodeid": 4, "leaf": 5.0}]}]}
    for item in (dump, json.dumps(dump)):
        (tree,) = fo.from_boosted([item])
        packed = fo.Packed([[tree]])
        assert packed.one(0, np.array([[0.0, 0.49], [0.0, 0.5], [2.0, 0.6], [1.9, 0.6]])).tolist() == [-1.0, 5.0, 7.0, 5.0]


def test_preprocessing(spark, rows):
    prep = pp.Preprocessor(["a", "b"], "y", 10).fit(rows)
    got = prep.transform(rows, "z").withColumn("back", prep.backtransform(F.col("z"))).toPandas()
    assert got["z"].min() == -0.5 and got["z"].max() == 0.5 and np.allclose(got["back"], got["y"])
    a = rows.toPandas()["a"].to_numpy()
    assert np.allclose(prep.thresholds[0], np.unique(np.quantile(a, np.linspace(0, 1, 10, endpoint=False))))
    flat = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "a double, y double")
    one = pp.Preprocessor(["a"], "y").fit(flat)
    assert [r["z"] for r in one.transform(flat, "z").collect()] == [2.0, 2.0] and one.scale() == (1.0, 0.0)
    with pytest.raises(ValueError):
        pp.Preprocessor(["a"], "y").fit(flat.limit(0))
    labels = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "label string")
    words = pp.vocabulary(labels, "label")
    assert [tuple(r) for r in words.orderBy("idx").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert sorted(r["idx"] for r in pp.encode_labels(labels, "label", words).collect()) == [0, 0, 1, 2]
    with pytest.raises(Exception, match="unknown label"):
        pp.encode_labels(spark.createDataFrame([("z",)], "label string"), "label", words).collect()
    with pytest.raises(ValueError):
        pp.vocabulary(labels.limit(0), "label")


def test_encodings_match_the_plain_form(spark):
    from thicket.streaming.agents import encode

    df = spark.createDataFrame([([0.5, 2.0], 1)], "x array<double>, arm int")
    for kind in pp.ENCODINGS:
        got = df.select(pp.encode_arm(F.col("x"), F.col("arm"), 3, 2, kind).alias("e")).first()["e"]
        assert got == encode([0.5, 2.0], 1, 3, kind)[0].tolist()
        assert pp.encode_all_arms(df.drop("arm"), "x", 3, 2, kind).count() == len(encode([0.5, 2.0], -1, 3, kind))
    with pytest.raises(ValueError):
        pp.encode_arm(F.col("x"), F.col("arm"), 3, 2, "other")


def test_statistics_agree_with_the_chain(spark, rows):
    from thicket.plans.chain import Gaussian, Settings

    g = Gaussian(Settings(n_trees=4))
    pdf = rows.select("y", fo.case_leaf(TREE, [F.col("a"), F.col("b")]).alias("leaf")).toPandas()
    stats = st.leaf_stats(spark.createDataFrame(pdf), F.col("y"))
    got = st.log_marginal(stats, 0.4, g.f_sigma2).first()[0]
    assert got == pytest.approx(g.log_marginal(pdf["leaf"].to_numpy(), pdf["y"].to_numpy(), 0.4))
    post = {r["leaf"]: r for r in st.leaf_posterior(stats, 0.4, g.f_sigma2).collect()}
    assert post[2]["var"] == pytest.approx(0.4 / (post[2]["n"] + 0.4 / g.f_sigma2))
    prior = st.log_prior(st.node_table(spark, {"t": TREE, "stump": OTHER})).collect()
    assert {r["tree"]: r["log_prior"] for r in prior}["stump"] == pytest.approx(math.log(0.05))
    coef, sd = st.ols(rows, [F.col("a"), F.col("b")], F.col("y"))
    full = rows.toPandas()
    design = np.column_stack([np.ones(300), full["a"], full["b"]])
    want = np.linalg.lstsq(design, full["y"], rcond=None)[0]
    assert np.allclose(coef, want) and sd == pytest.approx(np.std(full["y"] - design @ want))


def test_columns(spark):
    x = spark.createDataFrame([(float(v),) for v in (-4, -1, -0.2, 0, 0.5, 3)], "x double").withColumn("k", F.lit(1))
    got = x.select("x", fc.normal_cdf(F.col("x")).alias("p"), fc.softmax(F.col("x") * 300, "k").alias("s"), fc.log_add_exp(F.col("x"), F.col("x") + 1).alias("l")).collect()
    for r in got:
        assert r["p"] == pytest.approx(0.5 * math.erfc(-r["x"] / math.sqrt(2)), abs=2e-7)
        assert r["l"] == pytest.approx(np.logaddexp(r["x"], r["x"] + 1))
    assert sum(r["s"] for r in got) == pytest.approx(1)
    with pytest.raises(ValueError):
        fc.refresh_index(F.col("x"), "never")
    from thicket.streaming.agents import refresh_index

    ts = spark.range(1, 400).withColumnRenamed("id", "t")
    for name in fc.SCHEDULES:
        for r in ts.select("t", fc.refresh_index(F.col("t"), name).alias("i")).collect():
            assert r["i"] == refresh_index(r["t"], name)
    counts = {n: refresh_index(10_000, n) - refresh_index(10, n) for n in fc.SCHEDULES}
    assert counts == {"log": 55, "sqrt": 55, "hybrid": 56, "rev_hybrid": 55}


def test_posterior(rows):
    drawn = fo.with_draws(rows, [[{0: fo.leaf(float(v))}] for v in (3, 1, 2, 10)])
    r = po.intervals(po.posterior_mean(drawn)).first()
    assert r["mean"] == 4.0 and (r["lo"], r["hi"]) == (pytest.approx(np.quantile([3, 1, 2, 10], 0.025)), pytest.approx(np.quantile([3, 1, 2, 10], 0.975)))
    same = [po.predictive(drawn.repartition(n), "row_id", [1.0] * 4, 5).orderBy("row_id").select("predicted").toPandas() for n in (1, 3)]
    assert all(np.allclose(a, b) for a, b in zip(same[0]["predicted"], same[1]["predicted"], strict=True))
    noise = np.stack(same[0]["predicted"]) - [3, 1, 2, 10]
    assert abs(noise.mean()) < 0.1 and noise.std() == pytest.approx(1, abs=0.07)
    with pytest.raises(ValueError):
        po.last_draws(rows, 3, 4)
    with pytest.raises(ValueError):
        po.inclusion_frequency(rows, "other")


def test_diagnostics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4, 200))
    x[:, 1:] += 0.5 * x[:, :-1]
    df = spark.createDataFrame([(c, d, float(x[c, d])) for c in range(4) for d in range(200)], "chain int, draw int, value double")
    w, b = x.var(axis=1, ddof=1).mean(), 200 * x.mean(axis=1).var(ddof=1)
    assert dg.psrf(df).first()[0] == pytest.approx(math.sqrt((199 / 200 * w + b / 200) / w))
    for r in dg.autocorrelation(df, 3).collect():
        assert r["rho"] == pytest.approx(np.corrcoef(x[r["chain"], : -r["lag"]], x[r["chain"], r["lag"] :])[0, 1])
    for r in dg.geweke(df).collect():
        a, z = x[r["chain"], :20], x[r["chain"], 100:]
        assert r["z"] == pytest.approx((a.mean() - z.mean()) / math.sqrt(a.var(ddof=1) / 20 + z.var(ddof=1) / 100))
    r = dg.rank_diagnostics(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert 0.98 < r["rhat"] < 1.1 and 100 < r["ess_bulk"] < 800
    apart = dg.rank_rhat(x + np.array([[0], [0], [0], [9]]))
    assert apart > 1.5
    moves = spark.createDataFrame([("grow", 10, 5, 2), ("swap", 4, 0, 0)], "move string, selected long, proposed long, accepted long")
    got = {r["move"]: r for r in dg.move_rates(moves).collect()}
    assert got["overall"]["acceptance"] == 0.4 and got["swap"]["acceptance"] is None and got["grow"]["proposal"] == 0.5


def test_metrics_and_analytics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.2), (0, 0.1)], "y int, p double")
    assert me.auc(df, F.col("y"), F.col("p")).first()[0] == pytest.approx((2.5 + 2) / 6)
    with pytest.raises(ValueError):
        an.moving_average(df, [], "p", "y", 4)
    curve = spark.createDataFrame([("a", t, 3.0 * t**0.5) for t in range(1, 200)] + [("b", t, 1 + 4.0 * math.log(t)) for t in range(2, 200)], "agent string, t long, v double")
    best = {r["agent"]: r for r in an.growth_fits(curve, "t", "v", ["agent"]).collect()}
    assert best["a"]["best"] == "power" and best["a"]["power"] == pytest.approx(0.5) and best["b"]["best"] == "log"
    smooth = {r["t"]: r["smooth"] for r in an.gaussian_smooth(curve.where("agent = 'a'"), ["agent"], "t", "v", 1.0).collect()}
    k = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    assert smooth[50] == pytest.approx((k / k.sum()) @ np.array([3.0 * t**0.5 for t in range(46, 55)]))
    rng = np.random.default_rng(3)
    final = spark.createDataFrame([("S", a, float(rng.normal(m, 1))) for a, m in (("x", 0), ("y", 5), ("z", 5)) for _ in range(30)], "scenario string, agent string, regret double")
    got = {(r["a1"], r["a2"]): r["outcome"] for r in an.win_tie_lose(final).collect()}
    assert got[("x", "y")] == 1 and got[("x", "z")] == 1


@pytest.mark.parametrize("name", sc.names())
def test_scenarios(spark, name):
    df = sc.generate(spark, name, 1200, noise=0.0)
    s = sc.SCENARIOS[name]
    got = df.toPandas()
    assert list(got.columns) == ["row_id", *[f"x{k}" for k in range(s.features)], "y"] and got["y"].notna().all()
    assert got["x0"].nunique() == 50 if name == "tied_x" else got["x0"].nunique() > 1000
    if name == "imbalanced":
        assert (got["x0"] >= 2).sum() == 120 and got["x0"].max() <= 3 and got["x0"][got["x0"] < 2].max() < 1
    if name == "spiky":
        assert (got["y"] == 10).sum() == 120 and (got["row_id"][got["y"] == 10] % 10).nunique() > 5
    if s.kind in ("normal", "factor"):
        assert abs(got["x1"].mean()) < 0.15 and got["x1"].std() == pytest.approx(1, abs=0.12)


def test_noise_and_grid(spark):
    quiet, loud = sc.generate(spark, "friedman1", 2000, noise=0.0), sc.generate(spark, "friedman1", 2000, snr=2.0)
    diff = (loud.orderBy("row_id").toPandas()["y"] - quiet.orderBy("row_id").toPandas()["y"]).to_numpy()
    assert quiet.toPandas()["y"].var(ddof=0) / diff.var() == pytest.approx(2.0, rel=0.2)
    assert sc.noise_sd(quiet, snr=math.inf) == 0.0
    for bad in (lambda: sc.noise_sd(quiet, snr=0.0), lambda: sc.generate(spark, "nothing"), lambda: sc.generate(spark, "dgp_2", features=9)):
        with pytest.raises(ValueError):
            bad()
    assert sc.generate(spark, "linear", 10, features=7).columns[-2] == "x6" or "x6" in sc.generate(spark, "linear", 10, features=7).columns
    assert sc.grid(spark, 20, 2).count() == 20


def test_prior_source(spark):
    x = np.random.default_rng(1).random((200, 3))
    forest = draw_forest(x, 30, seed=2)
    assert len(forest) == 30 and all(fo.check(t) for t in forest)
    assert split_chance(0, 0.95, 2, False) == 0.95 and split_chance(2, 0.4, 2, True) == pytest.approx(0.16)
    got = prior_predictive(spark, 150, 2, n_trees=5, latent=True).toPandas()
    assert len(got) == 150 and (got["y"] - got["f"]).std() > 0


def test_files(spark, tmp_path):
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    b = files.array_from_json(files.array_to_json(a))
    assert b.dtype == a.dtype and (a == b).all()
    rng = np.random.default_rng(4)
    again = files.generator_from_json(files.generator_to_json(rng))
    assert rng.random() == again.random()
    assert files.plain({"a": [np.int64(1), np.array([1.5])]}) == {"a": [1, [1.5]]}
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "k long, a double, b double, y double")
    back = files.wide_layout(files.vector_layout(df, "k", ["a", "b"], "y"), 2)
    assert tuple(back.first()) == (1, 2.0, 3.0, 4.0)
    for kind in ("parquet", "orc", "csv", "json"):
        path = str(tmp_path / kind)
        (df.write.option("header", "true") if kind == "csv" else df.write).format(kind).save(path)
        assert files.read(spark, path, kind).count() == 1
    files.append_results(df, str(tmp_path / "r"))
    files.append_results(df, str(tmp_path / "r"))
    assert files.read(spark, str(tmp_path / "r")).count() == 2
