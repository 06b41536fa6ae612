"""One Markov chain over sums of trees, in NumPy; it runs inside one executor task.

A tree keeps its rules and leaf values by heap index (children of i are 2 i + 1 and 2 i + 2) and the leaf of each
row.  Trees are values: an edit gives a new tree that shares what it leaves unchanged.

The counted chains run over cells: rows that no threshold tells apart, with their number and the sum of their targets.
These are all that the likelihoods need, so the chain is the same, and what it holds is bounded by the product of the
numbers of bins, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np

from thicket.functions.special import chi2_ppf, draw_above, draw_gig, log_gig_norm


def depth(node: int) -> int:
    return (node + 1).bit_length() - 1


def descends(node: np.ndarray, root: int) -> np.ndarray:
    """Which heap indices stand in the subtree of root."""
    out = np.zeros(len(node), dtype=bool)
    up = node.copy()
    while True:
        out |= up == root
        live = up > root
        if not live.any():
            return out
        up = np.where(live, (up - 1) >> 1, up)


def below(node: int, root: int) -> bool:
    while node > root:
        node = (node - 1) >> 1
    return node == root


def group(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct heap indices in order, and the place of each row's index among them."""
    top = int(at.max(initial=0))
    if top > 4096 + 8 * len(at):
        return np.unique(at, return_inverse=True)
    used = np.zeros(top + 1, dtype=bool)
    used[at] = True
    leaf = np.flatnonzero(used)
    place = np.empty(top + 1, dtype=np.int64)
    place[leaf] = np.arange(len(leaf))
    return leaf, place[at]


@dataclass
class Tree:
    rules: dict[int, tuple[int, float]]
    leaves: dict[int, float]
    at: np.ndarray

    @staticmethod
    def stump(n: int, value: float = 0.0) -> Tree:
        return Tree({}, {0: value}, np.zeros(n, dtype=np.int64))

    def values(self) -> np.ndarray:
        return self.spread(self.at, self.leaves)

    @staticmethod
    def spread(at: np.ndarray, leaves: dict[int, float]) -> np.ndarray:
        top = max(leaves)
        if top <= 4096 + 8 * len(at):
            table = np.zeros(top + 1)
            table[list(leaves)] = list(leaves.values())
            return table[at]
        keys = np.fromiter(sorted(leaves), dtype=np.int64)
        table = np.array([leaves[k] for k in keys.tolist()])
        return table[np.searchsorted(keys, at)]

    def route(self, x: np.ndarray, rows: np.ndarray, start: int) -> np.ndarray:
        """Leaves of the given rows, which stand at `start`."""
        node = np.full(len(rows), start, dtype=np.int64)
        live = np.arange(len(rows))
        while len(live):
            split = [k for k in group(node[live])[0].tolist() if k in self.rules]
            moved = []
            for k in split:
                own = live[node[live] == k]
                var, thr = self.rules[k]
                node[own] = 2 * k + 2 - (x[rows[own], var] <= thr)
                moved.append(own)
            live = np.concatenate(moved) if moved else np.zeros(0, dtype=np.int64)
        return node

    def terminal(self) -> list[int]:
        """Splits whose children are both leaves."""
        return [k for k in self.rules if 2 * k + 1 in self.leaves and 2 * k + 2 in self.leaves]

    def linked(self) -> list[tuple[int, int]]:
        """Pairs of a split and a child that is a split too."""
        return [(k, c) for k in self.rules for c in (2 * k + 1, 2 * k + 2) if c in self.rules]

    def grow(self, x: np.ndarray, leaf: int, var: int, thr: float) -> Tree | None:
        if leaf not in self.leaves:
            raise ValueError("only a leaf can be split")
        rows = np.flatnonzero(self.at == leaf)
        left = x[rows, var] <= thr
        if left.all() or not left.any():
            return None
        at = self.at.astype(np.promote_types(self.at.dtype, np.min_scalar_type(-2 * leaf - 2)))  # a copy
        at[rows] = 2 * leaf + 2 - left
        leaves = {k: v for k, v in self.leaves.items() if k != leaf} | {2 * leaf + 1: 0.0, 2 * leaf + 2: 0.0}
        return Tree(self.rules | {leaf: (var, thr)}, leaves, at)

    def prune(self, node: int) -> Tree:
        """Makes a split a leaf, with all below it."""
        rules = {k: r for k, r in self.rules.items() if not below(k, node)}
        leaves = {k: v for k, v in self.leaves.items() if not below(k, node)} | {node: 0.0}
        return Tree(rules, leaves, np.where(descends(self.at, node), node, self.at))

    def with_rules(self, x: np.ndarray, new: dict[int, tuple[int, float]]) -> Tree | None:
        """Other rules at some nodes; None if a leaf would be empty."""
        out = Tree(self.rules | new, self.leaves, self.at.copy())
        top = min(new)
        rows = np.flatnonzero(descends(self.at, top)) if top else np.arange(len(self.at))
        out.at[rows] = out.route(x, rows, top)
        return out if len(group(out.at[rows])[0]) == sum(below(k, top) for k in self.leaves) else None

    def swap(self, x: np.ndarray, parent: int, child: int) -> Tree | None:
        return self.with_rules(x, {parent: self.rules[child], child: self.rules[parent]})

    def extend(self, x: np.ndarray, old: int) -> Tree:
        """The same tree over more rows; rows from `old` on are new."""
        rows = np.arange(old, len(x))
        return Tree(self.rules, self.leaves, np.concatenate([self.at, self.route(x, rows, 0)]))


@dataclass
class Settings:
    """Hyper-parameters of a chain."""

    n_trees: int = 200
    ndpost: int = 1000
    nskip: int = 100
    tree_alpha: float = 0.95
    tree_beta: float = 2.0
    quick_decay: bool = False
    f_k: float = 2.0
    eps_q: float = 0.9
    eps_nu: float = 3.0
    specification: str = "linear"  # how the residual deviation is guessed: "linear" or "naive"
    fixed_sigma2: float | None = None
    dirichlet: bool = False
    s_alpha: float = 2.0
    moves: dict[str, float] = field(default_factory=lambda: {"grow": 0.25, "prune": 0.25, "change": 0.4, "swap": 0.1})
    tries: int = 100
    temperature: float | Callable[[int], float] = 1.0
    redraw_always: bool = False
    mixture_draw: bool = False
    proposals: dict[str, Callable] = field(default_factory=dict)  # moves of one's own: f(proposer, tree) -> (tree, log ratio) or None
    contrary: dict[str, str] = field(default_factory=dict)  # the moves that undo them, if not themselves
    prior: Callable | None = None  # log prior of a tree: f(tree, settings)
    likelihood: Callable | None = None  # f(settings) -> what has log_marginal and draw

    def plain(self) -> dict:
        """The settings that are values, as text can hold them."""
        own = {k: v for k, v in vars(self).items() if k not in ("proposals", "contrary", "prior", "likelihood")}
        return own | {"temperature": self.heat(0), "moves": dict(self.moves)}

    def log_prior(self, tree: Tree) -> float:
        return log_prior(tree, self) if self.prior is None else self.prior(tree, self)

    def __post_init__(self) -> None:
        if self.quick_decay and not 0 < self.tree_alpha < 0.5:
            raise ValueError("quick decay needs a tree_alpha between 0 and 0.5")

    def heat(self, iteration: int) -> float:
        return self.temperature(iteration) if callable(self.temperature) else self.temperature


#: The move that undoes each move.
CONTRARY = {"grow": "prune", "prune": "grow", "change": "change", "swap": "swap"}


def log_prior(tree: Tree, s: Settings) -> float:
    """Sum of log(1 - p) over the leaves and log p over the splits, p by depth."""

    def log_p(node: int) -> float:
        d = depth(node)
        return d * math.log(s.tree_alpha) if s.quick_decay else math.log(s.tree_alpha) - s.tree_beta * math.log1p(d)

    total = sum(map(log_p, tree.rules))
    for leaf in tree.leaves:
        p = math.exp(log_p(leaf))
        total += math.log1p(-p) if p < 1 else -math.inf
    return total


class Gaussian:
    """Normal leaves and noise, one tree at a time."""

    def __init__(self, s: Settings) -> None:
        self.f_sigma2 = 0.25 / (s.f_k**2 * s.n_trees)

    def stats(self, at: np.ndarray, resid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf, place = group(at)
        return leaf, np.bincount(place, minlength=len(leaf)), np.bincount(place, resid, len(leaf))

    def log_marginal(self, at: np.ndarray, resid: np.ndarray, sigma2: float) -> float:
        _, n, total = self.stats(at, resid)
        ratio = sigma2 / self.f_sigma2
        fit = total**2 / n
        return -0.5 * (np.log(n / ratio + 1).sum() + (resid @ resid - fit.sum() + (fit / (n / ratio + 1)).sum()) / sigma2)

    def draw(self, rng: np.random.Generator, at: np.ndarray, resid: np.ndarray, sigma2: float) -> dict[int, float]:
        leaf, n, total = self.stats(at, resid)
        shrunk = n + sigma2 / self.f_sigma2
        new = total / shrunk + np.sqrt(sigma2 / shrunk) * rng.standard_normal(len(leaf))
        return dict(zip(leaf.tolist(), new.tolist(), strict=True))

    def log_marginal_many(self, basis: np.ndarray, resid: np.ndarray, sigma2: float) -> float:
        """The same for several trees at once, from the singular values of their leaf basis."""
        u, sv, _ = np.linalg.svd(np.asarray(basis, dtype=float), full_matrices=False)
        keep = sv > 1e-10 * sv.max(initial=1)
        u, gain = u[:, keep], sv[keep] ** 2 * self.f_sigma2 / sigma2 + 1
        coef = u.T @ resid
        left = resid - u @ coef
        return -0.5 * (np.log(gain).sum() + (left @ left + (coef**2 / gain).sum()) / sigma2)

    def draw_many(self, rng: np.random.Generator, basis: np.ndarray, resid: np.ndarray, sigma2: float) -> np.ndarray:
        """Leaf values of several trees: posterior mean and each leaf's own deviation."""
        basis = np.asarray(basis, dtype=float)
        cov = np.linalg.inv(basis.T @ basis / sigma2 + np.eye(basis.shape[1]) / self.f_sigma2)
        return cov @ (basis.T @ resid) / sigma2 + np.sqrt(np.diag(cov)) * rng.standard_normal(len(cov))


class Logistic:
    """Leaves are logs of a mixture of two generalized inverse Gaussians; phi are the latent rates."""

    def __init__(self, s: Settings) -> None:
        self.c, self.d, self.mixture = logistic_shape(s.n_trees)[0], logistic_shape(s.n_trees)[1], s.mixture_draw

    def parts(self, at: np.ndarray, match: np.ndarray, rate: np.ndarray):
        leaf, place = group(at)
        r = np.bincount(place, match.astype(float), len(leaf))
        t = np.bincount(place, rate, len(leaf))
        z1 = log_gig_norm(-self.c + r, 2 * self.d, 2 * t)
        z2 = log_gig_norm(self.c + r, 0.0, 2 * (self.d + t))
        return leaf, r, t, z1, z2

    def log_marginal(self, at: np.ndarray, match: np.ndarray, rate: np.ndarray) -> float:
        leaf, _, _, z1, z2 = self.parts(at, match, rate)
        none = float(log_gig_norm(self.c, 0.0, 2 * self.d))
        return float((np.logaddexp(z1, z2) - math.log(2) - none).sum())

    def draw(self, rng: np.random.Generator, at: np.ndarray, match: np.ndarray, rate: np.ndarray) -> dict[int, float]:
        leaf, r, t, z1, z2 = self.parts(at, match, rate)
        out = {}
        for k, rk, tk, p in zip(leaf.tolist(), r, t, 1 / (1 + np.exp(np.clip(z2 - z1, -700, 700))), strict=True):
            a = lambda: draw_gig(rng, -self.c + rk, 2 * self.d, 2 * tk)  # noqa: B023, E731
            b = lambda: draw_gig(rng, self.c + rk, 0.0, 2 * (self.d + tk))  # noqa: B023, E731
            value = (a() if rng.random() < p else b()) if self.mixture else p * a() + (1 - p) * b()
            out[k] = math.log(max(value, 1e-300))
        return out


def logistic_shape(n_trees: int) -> tuple[float, float]:
    a0 = 3.5 / math.sqrt(2)
    return n_trees / a0**2 + 0.5, n_trees / a0**2


class Proposer:
    """Draws moves and their log transition ratios."""

    def __init__(self, x: np.ndarray, thresholds: list[np.ndarray], s: Settings, rng: np.random.Generator) -> None:
        self.x, self.thresholds, self.s, self.rng = x, thresholds, s, rng
        self.names = list(s.moves)
        self.p = np.array([s.moves[n] for n in self.names])
        self.weights = np.cumsum(self.p / self.p.sum())
        self.columns: np.ndarray | None = None  # cumulative split weights
        self.counts = {n: [0, 0, 0] for n in self.names}  # selected, proposed, accepted

    def name(self) -> str:
        return self.names[min(int(np.searchsorted(self.weights, self.rng.random(), "right")), len(self.names) - 1)]

    def rule(self) -> tuple[int, float]:
        p = len(self.thresholds)
        var = int(self.rng.integers(p)) if self.columns is None else min(int(np.searchsorted(self.columns, self.rng.random(), "left")), p - 1)
        cuts = self.thresholds[var]
        return var, float(cuts[self.rng.integers(len(cuts))])

    def propose(self, tree: Tree, name: str) -> tuple[Tree, float] | None:
        pick = lambda options: options[self.rng.integers(len(options))]
        if name in self.s.proposals:
            return self.s.proposals[name](self, tree)
        if name == "grow":
            options = list(tree.leaves)
            for _ in range(self.s.tries):
                new = tree.grow(self.x, pick(options), *self.rule())
                if new is not None:
                    return new, math.log(len(options)) - math.log(len(new.terminal()))
        elif name == "prune":
            options = tree.terminal()
            if options:
                new = tree.prune(pick(options))
                return new, math.log(len(options)) - math.log(len(new.leaves))
        elif name == "change":
            options = list(tree.rules)
            for _ in range(self.s.tries if options else 0):
                new = tree.with_rules(self.x, {pick(options): self.rule()})
                if new is not None:
                    return new, 0.0
        elif name == "swap":
            options = tree.linked()
            for k in self.rng.permutation(len(options))[: self.s.tries]:
                new = tree.swap(self.x, *options[k])
                if new is not None:
                    return new, 0.0
        else:
            raise ValueError(f"unknown move {name!r}")
        return None

    def ratio(self, name: str) -> float:
        back = self.s.moves.get(self.s.contrary.get(name) or CONTRARY.get(name, name), 0.0)
        return math.log(back) - math.log(self.s.moves[name]) if back > 0 else -math.inf

    def step(self, tree: Tree, temperature: float, marginal: Callable[[np.ndarray], float]) -> tuple[Tree, bool]:
        """One Metropolis-Hastings step; whether it was accepted."""
        name = self.name()
        self.counts[name][0] += 1
        made = self.propose(tree, name)
        if made is None:
            return tree, False
        self.counts[name][1] += 1
        new, transition = made
        now = self.s.log_prior(tree)
        prior = math.inf if now == -math.inf else self.s.log_prior(new) - now
        ratio = (prior + marginal(new.at) - marginal(tree.at)) / temperature + transition + self.ratio(name)
        if math.log(max(self.rng.random(), 1e-300)) < ratio:
            self.counts[name][2] += 1
            return new, True
        return tree, False


def guess_sigma(x: np.ndarray, y: np.ndarray, specification: str) -> float:
    if specification == "naive":
        return float(np.std(y))
    design = np.column_stack([np.ones(len(x)), x])
    coef, *_ = np.linalg.lstsq(design, y, rcond=None)
    return float(np.std(y - design @ coef))


State = dict  # draw, sigma2, s, trees: list of Tree (logistic: one list for each category)


class RegressionChain:
    """Backfitting for a numeric target on the scaled axis; `probit` keeps sigma2 at 1 and redraws a latent target."""

    def __init__(self, x: np.ndarray, y: np.ndarray, thresholds: list[np.ndarray], s: Settings, seed, probit: bool = False) -> None:
        self.x, self.y, self.s, self.probit = x, np.asarray(y, dtype=float), s, probit
        self.rng = np.random.default_rng(seed)
        self.proposer = Proposer(x, thresholds, s, self.rng)
        self.likelihood = Gaussian(s) if s.likelihood is None else s.likelihood(s)
        if probit:
            self.likelihood.f_sigma2 = (3.0 / (s.f_k * math.sqrt(s.n_trees))) ** 2
            self.lam = 0.0
        else:
            sigma = max(guess_sigma(x, self.y, s.specification), 1e-5)
            self.lam = sigma**2 * chi2_ppf(1 - s.eps_q, s.eps_nu) / s.eps_nu

    def sigma2(self, resid: np.ndarray | None) -> float:
        if self.probit:
            return 1.0
        if self.s.fixed_sigma2 is not None:
            return self.s.fixed_sigma2
        n, sse = (0, 0.0) if resid is None else (len(resid), float(resid @ resid))
        shape, scale = (self.s.eps_nu + n) / 2, (self.s.eps_nu * self.lam + sse) / 2
        return max(scale / self.rng.gamma(shape), 1e-8)

    def start(self, trees: list[Tree] | None = None) -> State:
        n, p = self.x.shape
        return {"sigma2": self.sigma2(None), "s": np.full(p, 1 / p) if self.s.dirichlet else None, "trees": trees or [Tree.stump(n) for _ in range(self.s.n_trees)]}

    def warm(self, trees: list[Tree]) -> State:
        """A state with the given trees: each tree's leaves are redrawn given the others, then the noise.  Leaves that
        no row reaches keep their values."""
        state = self.start(list(trees))
        trees, parts = state["trees"], [t.values() for t in state["trees"]]
        total = np.sum(parts, axis=0)
        for k, tree in enumerate(trees):
            drawn = self.likelihood.draw(self.rng, tree.at, self.y - (total - parts[k]), state["sigma2"])
            trees[k] = Tree(tree.rules, tree.leaves | drawn, tree.at)
            fresh = trees[k].values()
            total, parts[k] = total + fresh - parts[k], fresh
        return state | {"sigma2": self.sigma2(self.y - total)}

    def sweep(self, state: State, iteration: int) -> State:
        trees, sigma2, heat = list(state["trees"]), state["sigma2"], self.s.heat(iteration)
        self.proposer.columns = None if state["s"] is None else np.cumsum(state["s"])
        parts = [t.values() for t in trees]
        total = np.sum(parts, axis=0)
        target = self.y
        if self.probit:
            sign = np.where(self.y > 0, 1.0, -1.0)
            target = total + sign * draw_above(self.rng, -sign * total)
        for k, tree in enumerate(trees):
            resid = target - (total - parts[k])
            new, moved = self.proposer.step(tree, heat, lambda at: self.likelihood.log_marginal(at, resid, sigma2))  # noqa: B023
            if moved or self.s.redraw_always:
                new = Tree(new.rules, new.leaves | self.likelihood.draw(self.rng, new.at, resid, sigma2), new.at)
                fresh = new.values()
                total += fresh - parts[k]
                trees[k], parts[k] = new, fresh
        s = state["s"]
        if s is not None:
            used = np.zeros(self.x.shape[1])
            for tree in trees:
                for var, _ in tree.rules.values():
                    used[var] += 1
            s = self.rng.dirichlet(self.s.s_alpha / len(used) + used)
        return {"sigma2": self.sigma2(target - total), "s": s, "trees": trees}

    def run(self, state: State | None = None, draws: int | None = None, skip: int | None = None) -> Iterator[tuple[int, State]]:
        """(draw, state) after `skip` sweeps; with no sweeps to skip the state at the start comes first, as draw -1."""
        draws = self.s.ndpost if draws is None else draws
        skip = self.s.nskip if skip is None else skip
        state = state or self.start()
        if skip == 0:
            yield -1, state
        for i in range(skip + draws):
            state = self.sweep(state, i)
            if i >= skip:
                yield i - skip, state


class LogisticChain(RegressionChain):
    """Multinomial logistic sum of trees; y holds category indices from 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray, thresholds: list[np.ndarray], s: Settings, seed, categories: int) -> None:
        if categories < 2:
            raise ValueError("at least two categories are needed")
        self.x, self.y, self.s, self.categories, self.probit = x, np.asarray(y, dtype=np.int64), s, categories, False
        self.rng = np.random.default_rng(seed)
        self.proposer = Proposer(x, thresholds, s, self.rng)
        self.likelihood = Logistic(s) if s.likelihood is None else s.likelihood(s)

    def start(self, trees=None) -> State:
        n = len(self.x)
        return {"sigma2": 1.0, "s": None, "trees": trees or [[Tree.stump(n) for _ in range(self.s.n_trees)] for _ in range(self.categories)]}

    def latent(self, rate: np.ndarray) -> np.ndarray:
        return self.rng.exponential(1 / rate)

    def match(self, category: int) -> np.ndarray:
        return self.y == category

    def sweep(self, state: State, iteration: int) -> State:
        forests, heat = [list(f) for f in state["trees"]], self.s.heat(iteration)
        parts = [[t.values() for t in f] for f in forests]
        total = [np.sum(p, axis=0) for p in parts]
        phi = self.latent(np.exp(np.stack(total)).sum(0))
        for c, forest in enumerate(forests):
            match = self.match(c)
            for k, tree in enumerate(forest):
                rate = phi * np.exp(total[c] - parts[c][k])
                new, moved = self.proposer.step(tree, heat, lambda at: self.likelihood.log_marginal(at, match, rate))  # noqa: B023
                if moved or self.s.redraw_always:
                    new = Tree(new.rules, new.leaves | self.likelihood.draw(self.rng, new.at, match, rate), new.at)
                    fresh = new.values()
                    total[c] = total[c] + fresh - parts[c][k]
                    forest[k], parts[c][k] = new, fresh
        return {"sigma2": 1.0, "s": None, "trees": forests}


# -- chains over cells ----------------------------------------------------------------------------------------------------

#: Latent targets that a counted probit chain draws at a time.
LATENT_ROWS = 1 << 20


class CountedGaussian(Gaussian):
    """Normal leaves over cells of n rows each, whose residuals are given as sums; constants are left out."""

    def __init__(self, s: Settings, n: np.ndarray) -> None:
        super().__init__(s)
        self.n = n

    def stats(self, at: np.ndarray, resid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf, place = group(at)
        return leaf, np.bincount(place, self.n, len(leaf)), np.bincount(place, resid, len(leaf))

    def log_marginal(self, at: np.ndarray, resid: np.ndarray, sigma2: float) -> float:
        _, n, total = self.stats(at, resid)
        ratio = sigma2 / self.f_sigma2
        fit = total**2 / n
        return -0.5 * (np.log(n / ratio + 1).sum() + ((fit / (n / ratio + 1)).sum() - fit.sum()) / sigma2)


class CountedChain(RegressionChain):
    """Backfitting over cells: n rows each, y the sums of their targets (probit: how many are positive), `within` the sum of
    squares about the cells' means, `sigma` the guessed deviation of the residuals."""

    def __init__(self, x: np.ndarray, n: np.ndarray, y: np.ndarray, within: float, sigma: float, thresholds: list[np.ndarray], s: Settings, seed, probit: bool = False) -> None:
        self.x, self.n, self.y, self.within, self.s, self.probit = np.asfortranarray(x), np.asarray(n, dtype=float), np.asarray(y, dtype=float), within, s, probit
        self.rng = np.random.default_rng(seed)
        self.proposer = Proposer(self.x, thresholds, s, self.rng)
        self.likelihood = CountedGaussian(s, self.n)
        self.lam = 0.0
        if probit:
            self.likelihood.f_sigma2 = self.probit_variance()
        else:
            self.lam = max(sigma, 1e-5) ** 2 * chi2_ppf(1 - s.eps_q, s.eps_nu) / s.eps_nu

    def probit_variance(self) -> float:
        return (3.0 / (self.s.f_k * math.sqrt(self.s.n_trees))) ** 2

    def split_weights(self, s: np.ndarray | None, trees: list[Tree]) -> np.ndarray | None:
        """New split weights, if there are any."""
        if s is None:
            return None
        used = np.bincount(np.array([var for tree in trees for var, _ in tree.rules.values()], dtype=np.int64), minlength=len(s))
        return self.rng.dirichlet(self.s.s_alpha / len(used) + used)

    def start(self, trees: list[Tree] | None = None) -> State:
        return super().start(trees or [Tree({}, {0: 0.0}, np.zeros(len(self.n), dtype=np.int16)) for _ in range(self.s.n_trees)])

    def noise(self, total: np.ndarray) -> float:
        """The noise variance given the forest's sum."""
        if self.probit or self.s.fixed_sigma2 is not None:
            return self.sigma2(None)
        sse = self.within + float(((self.y - self.n * total) ** 2 / self.n).sum())
        shape, scale = (self.s.eps_nu + float(self.n.sum())) / 2, (self.s.eps_nu * self.lam + sse) / 2
        return max(scale / self.rng.gamma(shape), 1e-8)

    def latent(self, total: np.ndarray) -> np.ndarray:
        """Sums of the cells' latent targets, which are drawn row by row, a bounded number at a time."""
        out = np.zeros(len(total))
        for sign, count in ((1.0, self.y), (-1.0, self.n - self.y)):
            ends = np.cumsum(count.astype(np.int64))
            for begin in range(0, int(ends[-1]), LATENT_ROWS):
                end = min(begin + LATENT_ROWS, int(ends[-1]))
                a, z = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left")
                share = np.minimum(ends[a : z + 1], end) - np.maximum(np.concatenate([ends[a : a + 1] - int(count[a]), ends[a:z]]), begin)
                there = a + np.flatnonzero(share)
                share = share[there - a]
                drawn = draw_above(self.rng, np.repeat(-sign * total[there], share))
                out[there] += sign * np.add.reduceat(drawn, np.cumsum(share) - share) + total[there] * share
        return out

    def warm(self, trees: list[Tree]) -> State:
        state = self.start(list(trees))
        trees = state["trees"]
        total = np.sum([t.values() for t in trees], axis=0)
        for k, tree in enumerate(trees):
            part = tree.values()
            drawn = self.likelihood.draw(self.rng, tree.at, self.y - self.n * (total - part), state["sigma2"])
            trees[k] = Tree(tree.rules, tree.leaves | drawn, tree.at)
            total = total + trees[k].values() - part
        return state | {"sigma2": self.noise(total)}

    def sweep(self, state: State, iteration: int) -> State:
        trees, sigma2, heat = list(state["trees"]), state["sigma2"], self.s.heat(iteration)
        self.proposer.columns = None if state["s"] is None else np.cumsum(state["s"])
        total = np.zeros(len(self.n))
        for tree in trees:
            total += tree.values()
        target = self.latent(total) if self.probit else self.y
        for k, tree in enumerate(trees):
            part = tree.values()
            resid = target - self.n * (total - part)
            new, moved = self.proposer.step(tree, heat, lambda at: self.likelihood.log_marginal(at, resid, sigma2))  # noqa: B023
            if moved or self.s.redraw_always:
                trees[k] = Tree(new.rules, new.leaves | self.likelihood.draw(self.rng, new.at, resid, sigma2), new.at)
                total += trees[k].values() - part
        weights = self.split_weights(state["s"], trees)
        return {"sigma2": self.noise(total), "s": weights, "trees": trees}


class CountedLogisticChain(LogisticChain):
    """The logistic chain over cells; counts holds for each category how many rows of a cell are of it.  A cell's rows have
    one rate, and the sum of their latent rates is a gamma draw."""

    def __init__(self, x: np.ndarray, counts: np.ndarray, thresholds: list[np.ndarray], s: Settings, seed, categories: int) -> None:
        super().__init__(np.asfortranarray(x), np.zeros(len(x)), thresholds, s, seed, categories)
        self.counts = np.asarray(counts, dtype=float)
        self.n = self.counts.sum(axis=0)

    def start(self, trees=None) -> State:
        return super().start(trees or [[Tree({}, {0: 0.0}, np.zeros(len(self.n), dtype=np.int16)) for _ in range(self.s.n_trees)] for _ in range(self.categories)])

    def latent(self, rate: np.ndarray) -> np.ndarray:
        return self.rng.gamma(self.n) / rate

    def match(self, category: int) -> np.ndarray:
        return self.counts[category]
