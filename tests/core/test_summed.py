"""Chains over running sums against chains over cells and rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.plans import cells as ce
from thicket.plans.chain import CountedChain, Settings, guess_sigma
from thicket.plans.model import fit
from thicket.plans.summed import SummedChain, suits
from thicket.sources.scenarios import generate

RNG = np.random.default_rng(4)
X = RNG.random((4000, 3))
CUTS = [np.linspace(0, 1, k, endpoint=False) for k in (5, 7, 6)]
CODE = np.stack([np.searchsorted(c, X[:, k]) for k, c in enumerate(CUTS)], axis=1)
CELLS, OF = np.unique(CODE, axis=0, return_inverse=True)
POINTS = np.stack([np.append(c, np.inf)[CELLS[:, k]] for k, c in enumerate(CUTS)], axis=1)
N = np.bincount(OF.ravel())
Y = np.where(X[:, 0] > 0.5, 0.3, -0.3) * X[:, 1] + 0.05 * RNG.normal(size=len(X))
TOTAL, SQUARE = np.bincount(OF.ravel(), Y), float((Y**2).sum())
GUESS = guess_sigma(X, Y, "linear")


def pair(s):
    within = SQUARE - float((TOTAL**2 / N).sum())
    return CountedChain(POINTS, N, TOTAL, within, GUESS, CUTS, s, 5), SummedChain(CELLS, N, TOTAL, SQUARE, GUESS, CUTS, CUTS, s, 5)


def alike(a, b):
    assert a["sigma2"] == pytest.approx(b["sigma2"], rel=1e-6)
    assert [t.rules for t in a["trees"]] == [t.rules for t in b["trees"]]
    for t, u in zip(a["trees"], b["trees"], strict=True):
        assert t.leaves == pytest.approx(u.leaves, abs=1e-8)


@pytest.mark.parametrize("options", [{}, {"redraw_always": True}, {"dirichlet": True}, {"fixed_sigma2": 0.01}])
def test_a_chain_on_running_sums_is_the_chain_over_cells(options):
    cells, sums = pair(Settings(n_trees=6, ndpost=30, nskip=30, **options))
    for (_, a), (_, b) in zip(cells.run(), sums.run(), strict=True):
        alike(a, b)
    assert cells.proposer.counts == sums.proposer.counts
    assert np.allclose(sum(t.values() for t in a["trees"]), sums.grid.values(b["trees"]), atol=1e-9)


def test_a_start_from_trees_of_which_a_leaf_has_no_row():
    from thicket.plans.model import _unpack

    low, high = float(CUTS[0][1]), float(CUTS[0][3])
    packed = [[(0, 0, low, 0.0), (1, 0, high, 0.0), (2, -1, 0.0, 0.1), (3, -1, 0.0, -0.1), (4, -1, 0.0, 0.7)], [(0, -1, 0.0, 0.0)]]
    cells, sums = pair(Settings(n_trees=2, ndpost=10, nskip=0))
    a, b = cells.warm(_unpack(packed, POINTS)), sums.warm(_unpack(packed, sums.grid))
    assert b["trees"][0].leaves[4] == 0.7  # no row reaches it
    alike(a, b)
    for (_, a), (_, b) in zip(cells.run(a), sums.run(b), strict=True):
        alike(a, b)


def test_a_step_takes_as_long_over_many_cells():
    """A chain over cells passes over all of them at each step."""
    cuts = [np.linspace(0, 1, 20, endpoint=False)] * 5
    took = []
    for m in (20_000, 1_000_000):
        codes = np.unique(np.random.default_rng(1).integers(0, 21, (m, 5)), axis=0)
        assert suits(cuts, len(codes))
        y = 0.01 * codes[:, 0] - 0.1
        chain = SummedChain(codes, np.ones(len(codes)), y, float(y @ y), 0.1, cuts, cuts, Settings(n_trees=5), 1)
        state, begun = chain.start(), time.perf_counter()
        for i in range(20):
            state = chain.sweep(state, i)
        took.append(time.perf_counter() - begun)
    assert took[1] < 5 * took[0] + 0.5


def test_many_cells_are_summed(spark, monkeypatch):
    rows = generate(spark, "friedman1", 400, noise=0.2)
    x = [f"x{k}" for k in range(5)]
    options = {"seed": 1, "n_trees": 5, "ndpost": 6, "nskip": 6, "max_bins": 6}
    by = lambda m: m.trace.select("draw", "sigma2", F.to_json("trees").alias("t")).orderBy("draw").collect()
    plain = fit(rows, x, "y", **options)
    before, again = by(plain), by(plain.update(rows, 4))
    made = []
    monkeypatch.setattr("thicket.plans.cells.suits", lambda cuts, n: made.append(n) or True)
    seen = ce.chain_of.__globals__["suits"]
    assert seen(CUTS, 1) and made
    summed = fit(rows, x, "y", **options)
    assert [r["sigma2"] for r in by(summed)] == pytest.approx([r["sigma2"] for r in before], rel=1e-6)
    assert [r["sigma2"] for r in by(summed.update(rows, 4))] == pytest.approx([r["sigma2"] for r in again], rel=1e-6)


def test_a_probit_on_running_sums_and_its_latent_draws():
    hit = np.bincount(OF.ravel(), Y > 0)
    s = Settings(n_trees=6, ndpost=20, nskip=20)
    cells = CountedChain(POINTS, N, hit, 0.0, 1.0, CUTS, s, 5, probit=True)
    sums = SummedChain(CELLS, N, hit, 0.0, 1.0, CUTS, CUTS, s, 5, probit=True)
    for (_, a), (_, b) in zip(cells.run(), sums.run(), strict=True):
        alike(a, b)
    assert ((sums.grid.values(b["trees"]) > 0) == (hit > N / 2)).mean() > 0.9


def test_many_latent_draws_are_quick():
    """Six million rows in 200,000 cells: most draws are plain ones."""
    cuts = [np.linspace(0, 1, 20, endpoint=False)] * 5
    codes = np.unique(np.random.default_rng(1).integers(0, 21, (205_000, 5)), axis=0)[:200_000]
    n, share = np.full(len(codes), 30.0), codes[:, 0] / 20
    chain = SummedChain(codes, n, np.rint(n * share), 0.0, 1.0, cuts, cuts, Settings(n_trees=5), 1, probit=True)
    begun = time.perf_counter()
    z = chain.latent(2 * share - 1)
    assert time.perf_counter() - begun < 1.5
    assert np.corrcoef(z, share)[0, 1] > 0.9
