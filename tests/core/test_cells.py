import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.plans import cells as ce
from thicket.plans.chain import CountedChain, CountedLogisticChain, RegressionChain, Settings, guess_sigma

RNG = np.random.default_rng(3)
X = RNG.random((3000, 2))
CUTS = [np.linspace(0, 1, 6, endpoint=False)] * 2
CODE = np.stack([np.searchsorted(c, X[:, k]) for k, c in enumerate(CUTS)], axis=1)
CELLS, OF = np.unique(CODE, axis=0, return_inverse=True)
POINTS = np.stack([np.append(c, np.inf)[CELLS[:, k]] for k, c in enumerate(CUTS)], axis=1)
N = np.bincount(OF.ravel())
Y = np.where(X[:, 0] > 0.5, 0.3, -0.3) + 0.05 * RNG.normal(size=len(X))


def test_a_chain_over_cells_is_the_chain_over_rows():
    s = Settings(n_trees=6, ndpost=10, nskip=10)
    total = np.bincount(OF.ravel(), Y)
    within = float((Y**2).sum() - (total**2 / N).sum())
    rows = list(RegressionChain(X, Y, CUTS, s, 5).run())
    cells = list(CountedChain(POINTS, N, total, within, guess_sigma(X, Y, "linear"), CUTS, s, 5).run())
    assert len(POINTS) < len(X) / 50
    for (_, a), (_, b) in zip(rows, cells, strict=True):
        assert a["sigma2"] == pytest.approx(b["sigma2"], rel=1e-6)
        assert [t.rules for t in a["trees"]] == [t.rules for t in b["trees"]]
        assert a["trees"][0].leaves == pytest.approx(b["trees"][0].leaves, abs=1e-9)


def test_classifiers_over_cells():
    hit = np.bincount(OF.ravel(), Y > 0)
    s = Settings(n_trees=6, ndpost=20, nskip=20)
    chain = CountedChain(POINTS, N, hit, 0.0, 1.0, CUTS, s, 5, probit=True)
    z = np.mean([chain.latent(np.full(len(N), 0.5)).sum() for _ in range(20)])
    tail = 0.5 * (1 + np.float64(0.3829249225480262))  # of a standard normal above -0.5
    up, down = 0.5 + 0.3520653267642995 / tail, 0.5 - 0.3520653267642995 / (1 - tail)
    assert z == pytest.approx(hit.sum() * up + (N - hit).sum() * down, rel=0.02, abs=30)
    f = np.mean([sum(t.values() for t in st["trees"]) for _, st in chain.run()], axis=0)
    assert ((f > 0) == (hit > N / 2)).mean() > 0.9
    logistic = CountedLogisticChain(POINTS, np.stack([N - hit, hit]), CUTS, Settings(n_trees=4, ndpost=20, nskip=20, moves={"grow": 0.5, "prune": 0.5}), 5, 2)
    f = np.mean([[sum(t.values() for t in own) for own in st["trees"]] for _, st in logistic.run()], axis=0)
    assert (f.argmax(0) == (hit > N / 2)).mean() > 0.9


def test_rows_are_counted_by_cells(spark):
    rows = spark.createDataFrame([(x.tolist(), float(y), 0) for x, y in zip(X, Y, strict=True)], "x array<double>, y double, g int")
    coded, names = ce.coded(rows, CUTS)
    made = ce.counted(coded, names, 2.0).orderBy(*names).toPandas()
    assert ce.points(made[names].to_numpy(), CUTS).tolist() == POINTS.tolist() and made["n"].tolist() == N.tolist()
    y = 2.0 * ce.total(made["s_high"].to_numpy(float), made["s_low"].to_numpy(float))
    assert np.allclose(y, np.bincount(OF.ravel(), Y), atol=1e-12)
    again = ce.counted(ce.coded(rows.repartition(7), CUTS)[0], names, 2.0).orderBy(*names).toPandas()
    assert made.equals(again)
    assert ce.sigma_guesses(rows, "g", 2)[0] == pytest.approx(guess_sigma(X, Y, "linear"), rel=1e-6)
    holes = spark.createDataFrame([([float("nan"), 0.5], 1.0)], "x array<double>, y double")
    assert ce.points(ce.coded(holes, CUTS)[0].select(*names).toPandas().to_numpy(), CUTS)[0, 0] == np.inf
    many = [np.arange(200.0)] * 20  # several longs
    wide, words = ce.coded(spark.range(3).select(F.array_repeat(F.col("id").cast("double"), 20).alias("x"), "id"), many)
    assert len(words) == 3 and ce.points(wide.orderBy("id").select(*words).toPandas().to_numpy(), many).tolist() == [[k] * 20 for k in (0.0, 1.0, 2.0)]


def test_a_row_has_the_cuts_of_its_own_model(spark):
    rows = spark.createDataFrame([([0.3], 1.0, "a"), ([0.3], 2.0, "b"), ([0.9], 3.0, "b")], "x array<double>, y double, model string")
    cuts = {"a": [np.array([0.5])], "b": [np.array([0.1, 0.2, 0.8])]}
    made, names = ce.coded(rows, cuts, of="model")
    keys = made.orderBy("y").select(*names).toPandas().to_numpy()
    codes = ce.sizes(list(cuts.values()))
    assert [ce.points(keys[:1], cuts["a"], codes)[0, 0], *ce.points(keys[1:], cuts["b"], codes)[:, 0]] == [0.5, 0.8, np.inf]
