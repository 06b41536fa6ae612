import math

import numpy as np
import pytest

from thicket.functions.special import beta_i, chi2_ppf, draw_above, draw_gig, gamma_p, log_bessel_k, log_gig_norm, welch_p
from thicket.plans.chain import CONTRARY, Gaussian, LogisticChain, Proposer, RegressionChain, Settings, Tree, depth, log_prior, logistic_shape

RNG = np.random.default_rng(0)
X = RNG.random((150, 3))
CUTS = [np.unique(np.quantile(X[:, k], np.linspace(0, 1, 12, endpoint=False))) for k in range(3)]


def test_special_functions():
    assert gamma_p(1, 2) == pytest.approx(1 - math.exp(-2))
    assert chi2_ppf(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    assert welch_p(0, 1, 10, 0, 1, 10) == pytest.approx(1.0)
    assert math.isnan(welch_p(0, 0, 5, 0, 0, 5))
    for x in (0.3, 2.0, 50.0):
        assert log_bessel_k(0.5, x) == pytest.approx(0.5 * math.log(math.pi / (2 * x)) - x, abs=1e-9)
    for v in (0.3, 4.0, 70.0):  # K_{v+1} = K_{v-1} + 2 v / x K_v
        a, b, c = (float(log_bessel_k(w, 3.0)) for w in (v - 1, v, v + 1))
        assert np.logaddexp(a, b + math.log(2 * v / 3)) == pytest.approx(c, abs=1e-8)


def test_gig_limits_and_moments():
    assert log_gig_norm(2.5, 0.0, 3.0) == pytest.approx(math.lgamma(2.5) + 2.5 * math.log(2 / 3))
    assert log_gig_norm(-2.5, 3.0, 0.0) == pytest.approx(math.lgamma(2.5) - 2.5 * math.log(3 / 2))
    assert log_gig_norm(2.5, 1e-9, 3.0) == pytest.approx(float(log_gig_norm(2.5, 0.0, 3.0)), abs=1e-5)
    with pytest.raises(ValueError):
        log_gig_norm(-1.0, 0.0, 1.0)
    for eta, chi, psi in ((1.5, 2.0, 3.0), (-4.0, 7.0, 0.2), (20.0, 0.1, 5.0), (2.0, 0.0, 3.0), (-3.0, 2.0, 0.0)):
        rng = np.random.default_rng(1)
        draws = np.array([draw_gig(rng, eta, chi, psi) for _ in range(6000)])
        mean = math.exp(log_gig_norm(eta + 1, chi, psi) - log_gig_norm(eta, chi, psi))
        assert draws.mean() == pytest.approx(mean, rel=0.08)


def test_truncated_normal():
    low = np.repeat([-2.0, 0.0, 1.0, 6.0], 4000)
    z = draw_above(np.random.default_rng(2), low)
    assert (z > low).all()
    for a in (0.0, 1.0, 6.0):
        tail = 0.5 * math.erfc(a / math.sqrt(2))
        assert z[low == a].mean() == pytest.approx(math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail, rel=0.03)


def test_tree_edits_route_rows_like_a_walk():
    rng = np.random.default_rng(3)
    tree = Tree.stump(len(X))
    for _ in range(200):
        p = Proposer(X, CUTS, Settings(n_trees=1), rng)
        made = p.propose(tree, p.name())
        if made:
            tree = made[0]
        for row, leaf in zip(X, tree.at, strict=True):
            node = 0
            while node in tree.rules:
                var, thr = tree.rules[node]
                node = 2 * node + (1 if row[var] <= thr else 2)
            assert node == leaf
        assert set(np.unique(tree.at)) == set(tree.leaves)
    assert tree.extend(np.concatenate([X, X]), len(X)).at.tolist() == [*tree.at, *tree.at]
    with pytest.raises(ValueError):
        tree.grow(X, 10**6, 0, 0.5)


def test_log_prior_closed_forms():
    s = Settings(n_trees=1)
    stump = Tree.stump(len(X))
    assert log_prior(stump, s) == pytest.approx(math.log(0.05))
    grown = stump.grow(X, 0, 0, 0.5)
    p1 = 0.95 * 2**-2.0
    assert log_prior(grown, s) == pytest.approx(math.log(0.95) + 2 * math.log(1 - p1))
    assert log_prior(stump, Settings(n_trees=1, quick_decay=True, tree_alpha=0.45)) == -math.inf
    with pytest.raises(ValueError):
        Settings(quick_decay=True)
    assert [depth(i) for i in (0, 1, 2, 3, 6, 7)] == [0, 1, 1, 2, 2, 3]


def test_marginal_is_the_dense_evidence():
    g, sigma2 = Gaussian(Settings(n_trees=5)), 0.3
    at = RNG.integers(0, 4, 40)
    e = RNG.normal(size=40)
    basis = (at[:, None] == np.arange(4)).astype(float)

    def dense(b):
        cov = sigma2 * np.eye(40) + g.f_sigma2 * b @ b.T
        return -0.5 * (np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))

    none = dense(np.zeros((40, 1)))
    flat = -0.5 * e @ e / sigma2
    assert g.log_marginal(at, e, sigma2) - flat == pytest.approx(dense(basis) - none)
    assert g.log_marginal_many(basis, e, sigma2) == pytest.approx(g.log_marginal(at, e, sigma2))
    draws = np.array([g.draw(np.random.default_rng(k), at, e, sigma2)[2] for k in range(3000)])
    n, total = (at == 2).sum(), e[at == 2].sum()
    shrunk = n + sigma2 / g.f_sigma2
    assert draws.mean() == pytest.approx(total / shrunk, abs=0.02)
    assert draws.var() == pytest.approx(sigma2 / shrunk, rel=0.1)
    many = np.array([g.draw_many(np.random.default_rng(k), basis, e, sigma2)[2] for k in range(3000)])
    assert many.mean() == pytest.approx(draws.mean(), abs=0.02)


def test_transition_ratios():
    s = Settings(n_trees=1)
    p = Proposer(X, CUTS, s, np.random.default_rng(4))
    new, ratio = p.propose(Tree.stump(len(X)), "grow")
    assert ratio == pytest.approx(math.log(1) - math.log(1))
    back, ratio = p.propose(new, "prune")
    assert ratio == pytest.approx(0.0) and not back.rules
    two = new.grow(X, 1, 1, float(np.median(X[new.at == 1, 1])))
    assert p.propose(two, "prune")[1] == pytest.approx(math.log(1) - math.log(2))
    assert p.propose(Tree.stump(len(X)), "prune") is None and p.propose(Tree.stump(len(X)), "swap") is None
    assert p.ratio("grow") == 0.0 and CONTRARY["change"] == "change"
    assert Proposer(X, CUTS, Settings(moves={"grow": 1.0}), p.rng).ratio("grow") == -math.inf


def signal(x):
    return np.where(x[:, 0] > 0.5, 0.3, -0.3) + 0.1 * x[:, 1]


def test_regression_recovers_signal_and_noise():
    y = signal(X) + np.random.default_rng(5).normal(0, 0.05, len(X))
    chain = RegressionChain(X, y, CUTS, Settings(n_trees=15, ndpost=80, nskip=80), 7)
    out = list(chain.run())
    assert [d for d, _ in out] == list(range(80))
    f = np.mean([sum(t.values() for t in s["trees"]) for _, s in out], axis=0)
    assert np.sqrt(np.mean((f - signal(X)) ** 2)) < 0.05
    assert np.sqrt(np.mean([s["sigma2"] for _, s in out])) == pytest.approx(0.05, rel=0.5)
    again = list(RegressionChain(X, y, CUTS, Settings(n_trees=15, ndpost=80, nskip=80), 7).run())
    assert [s["sigma2"] for _, s in out] == [s["sigma2"] for _, s in again]
    assert sum(c[0] for c in chain.proposer.counts.values()) == 15 * 160


def test_initial_state_is_kept_without_burn_in():
    y = signal(X)
    out = list(RegressionChain(X, y, CUTS, Settings(n_trees=3, ndpost=4, nskip=0), 1).run())
    assert [d for d, _ in out] == [-1, 0, 1, 2, 3]
    more = list(RegressionChain(X, y, CUTS, Settings(n_trees=3, ndpost=2, nskip=0), 2).run(out[-1][1]))
    assert more[0][1] is out[-1][1]


def test_options():
    y = signal(X)
    out = list(RegressionChain(X, y, CUTS, Settings(n_trees=4, ndpost=6, nskip=2, dirichlet=True, fixed_sigma2=0.01, temperature=lambda i: 1 + i, redraw_always=True), 1).run())
    assert all(s["sigma2"] == 0.01 and s["s"].sum() == pytest.approx(1) for _, s in out)
    with pytest.raises(ValueError):
        LogisticChain(X, y > 0, CUTS, Settings(), 1, 1)


def test_probit_and_logistic_classify():
    label = (signal(X) > 0.05).astype(int)
    out = list(RegressionChain(X, label, CUTS, Settings(n_trees=10, ndpost=40, nskip=40), 3, probit=True).run())
    f = np.mean([sum(t.values() for t in s["trees"]) for _, s in out], axis=0)
    assert ((f > 0) == label).mean() > 0.95 and all(s["sigma2"] == 1.0 for _, s in out)
    out = list(LogisticChain(X, label, CUTS, Settings(n_trees=4, ndpost=25, nskip=25, moves={"grow": 0.5, "prune": 0.5}), 3, 2).run())
    f = np.mean([[sum(t.values() for t in forest) for forest in s["trees"]] for _, s in out], axis=0)
    assert (f.argmax(0) == label).mean() > 0.9
    c, d = logistic_shape(25)
    assert (c, d) == (pytest.approx(25 / 6.125 + 0.5), pytest.approx(25 / 6.125))
