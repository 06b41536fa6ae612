"""Chains over running sums: on a grid of all cells, the rows in a box and the sum of their targets follow from 2^d running
sums over d features.  A leaf is a box, and so is what two leaves have in common; thus a step of a chain takes as long over
any number of rows and cells.  The draws are those of the chain over cells, but for rounding."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from thicket.functions.special import chi2_ppf
from thicket.plans.chain import CountedChain, CountedGaussian, Proposer, Settings, State, Tree, below

#: Running sums of the largest grid, the most features, and cells up to which a chain over them is as fast.
MOST_SUMS, MOST_FEATURES, FEW_CELLS = 1 << 23, 8, 1 << 14


def suits(cuts: list[np.ndarray], cells: int) -> bool:
    """Whether so many cells are better summed on a grid."""
    return cells > FEW_CELLS and len(cuts) <= MOST_FEATURES and int(np.prod([len(c) + 2.0 for c in cuts])) <= MOST_SUMS


class Boxes:
    """The leaves of a tree in order as boxes of codes from low to below high, and their numbers of rows."""

    def __init__(self, grid: Grid, leaf: list[int], low: np.ndarray, high: np.ndarray) -> None:
        self.grid, self.leaf, self.low, self.high = grid, leaf, low, high
        self.n = grid.inside(grid.counts, low, high)


class Grid:
    """Cells by their codes: as many cuts of each feature lie below their rows."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, cuts: list[np.ndarray]) -> None:
        self.cuts, self.shape = cuts, tuple(len(c) + 1 for c in cuts)
        self.at = np.ravel_multi_index(tuple(codes.T), self.shape)
        sides = np.array([k + 1 for k in self.shape], dtype=np.int64)
        self.strides = np.concatenate([np.cumprod(sides[:0:-1])[::-1], [1]]).astype(np.int64)
        self.signs = np.ones(1)
        for _ in cuts:
            self.signs = np.concatenate([self.signs, -self.signs])
        self.counts = self.running(n)

    @staticmethod
    def _add_up(table: np.ndarray) -> None:
        for axis in range(table.ndim - 1):
            along = np.moveaxis(table, axis, 0)
            for k in range(1, len(along)):
                along[k] += along[k - 1]
        np.cumsum(table, axis=-1, out=table)

    def running(self, values: np.ndarray) -> np.ndarray:
        """Running sums of a value for each cell, with a zero before each feature's first code."""
        cells = np.zeros(self.shape)
        cells.reshape(-1)[self.at] = values
        self._add_up(cells)
        table = np.zeros([k + 1 for k in self.shape])
        table[(slice(1, None),) * len(self.shape)] = cells
        return table.reshape(-1)

    def inside(self, table: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums over boxes, whose bounds are in the last axis; a box that ends before it begins is empty."""
        begin, end = low * self.strides, np.maximum(low, high) * self.strides
        corner = np.zeros((*low.shape[:-1], 1), dtype=np.int64)
        for k in range(low.shape[-1]):
            corner = np.concatenate([corner + end[..., k : k + 1], corner + begin[..., k : k + 1]], axis=-1)
        return table[corner] @ self.signs

    def common(self, a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> np.ndarray:
        """How many rows each of some boxes has in common with each of others."""
        low, high = np.maximum(a_low[:, None], b_low), np.minimum(a_high[:, None], b_high)
        out = np.zeros(low.shape[:2])
        meet = (low < high).all(axis=-1)
        out[meet] = self.inside(self.counts, low[meet], high[meet])
        return out

    def place(self, var: int, thr: float) -> int:
        """The code at which a rule's right side begins."""
        return int(np.searchsorted(self.cuts[var], thr, "left")) + 1

    def tree(self, rules: dict[int, tuple[int, float]], leaves: dict[int, float]) -> BoxTree:
        found: dict[int, tuple[list[int], list[int]]] = {}
        todo = [(0, [0] * len(self.shape), list(self.shape))]
        while todo:
            node, low, high = todo.pop()
            if node not in rules:
                found[node] = low, high
                continue
            var, thr = rules[node]
            at = self.place(var, thr)
            left, right = high.copy(), low.copy()
            left[var], right[var] = min(high[var], at), max(low[var], at)
            todo += [(2 * node + 1, low, left), (2 * node + 2, right, high)]
        leaf = sorted(found)
        return BoxTree(rules, leaves, Boxes(self, leaf, *(np.array([found[k][i] for k in leaf], dtype=np.int64) for i in (0, 1))))

    def values(self, trees: list[BoxTree]) -> np.ndarray:
        """The sum of the trees in each cell, from its changes at the boxes' corners."""
        table = np.zeros([k + 1 for k in self.shape])
        for tree in trees:
            at = tree.at
            begin, end = at.low * self.strides, np.maximum(at.low, at.high) * self.strides
            corner = np.zeros((len(at.leaf), 1), dtype=np.int64)
            for k in range(len(self.shape)):
                corner = np.concatenate([corner + begin[:, k : k + 1], corner + end[:, k : k + 1]], axis=1)
            np.add.at(table.reshape(-1), corner, np.array([tree.leaves[k] for k in at.leaf])[:, None] * self.signs)
        self._add_up(table)
        return table[tuple(slice(0, -1) for _ in self.shape)].reshape(-1)[self.at]


class BoxTree(Tree):
    """A tree whose leaves are boxes of a grid, which takes the place of the rows."""

    at: Boxes

    def values(self) -> np.ndarray:
        return self.at.grid.values([self])

    def grow(self, x: Grid, leaf: int, var: int, thr: float) -> BoxTree | None:
        if leaf not in self.leaves:
            raise ValueError("only a leaf can be split")
        k, at = self.at.leaf.index(leaf), x.place(var, thr)
        low, high = self.at.low[k], self.at.high[k].copy()
        if not low[var] < at < high[var]:
            return None
        high[var] = at
        if float(x.inside(x.counts, low, high)) in (0.0, float(self.at.n[k])):
            return None
        leaves = {k: v for k, v in self.leaves.items() if k != leaf} | {2 * leaf + 1: 0.0, 2 * leaf + 2: 0.0}
        return x.tree(self.rules | {leaf: (var, thr)}, leaves)

    def prune(self, node: int) -> BoxTree:
        rules = {k: r for k, r in self.rules.items() if not below(k, node)}
        leaves = {k: v for k, v in self.leaves.items() if not below(k, node)} | {node: 0.0}
        return self.at.grid.tree(rules, leaves)

    def with_rules(self, x: Grid, new: dict[int, tuple[int, float]]) -> BoxTree | None:
        top = min(new)
        out = x.tree(self.rules | new, self.leaves)
        return out if all(n > 0 for k, n in zip(out.at.leaf, out.at.n.tolist(), strict=True) if below(k, top)) else None


class Forest:
    """The leaves of all trees one after another: their values, sums of targets, and the rows that each two have in common."""

    def __init__(self, grid: Grid, trees: list[BoxTree], table: np.ndarray) -> None:
        self.grid, self.table, self.boxes = grid, table, [t.at for t in trees]
        self.low, self.high = (np.concatenate([getattr(b, c) for b in self.boxes]) for c in ("low", "high"))
        self.value = np.concatenate([[t.leaves[k] for k in t.at.leaf] for t in trees])
        self.counts = np.concatenate([grid.common(b.low, b.high, self.low, self.high) for b in self.boxes])
        self.summed(table)

    def holds(self, trees: list[BoxTree]) -> bool:
        return len(trees) == len(self.boxes) and all(t.at is b for t, b in zip(trees, self.boxes, strict=True))

    def summed(self, table: np.ndarray) -> None:
        self.table, self.y = table, self.grid.inside(table, self.low, self.high)

    def others(self, k: int) -> tuple[slice, np.ndarray]:
        """The places of tree k's leaves, and those of all others."""
        begin = sum(len(b.leaf) for b in self.boxes[:k])
        own = slice(begin, begin + len(self.boxes[k].leaf))
        return own, np.delete(np.arange(len(self.value)), own)

    def residuals(self, k: int) -> Callable[[Boxes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For leaves in the place of tree k's: those with rows, their numbers, and the sums of what the other trees leave of
        the targets."""
        own, rest = self.others(k)
        old, value = self.boxes[k], self.value[rest]
        self.found = {}

        def of(at: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if id(at) not in self.found:
                place = {j: i for i, j in enumerate(old.leaf)}
                same = np.array([place.get(j, -1) for j in at.leaf])
                same[(old.low[same] != at.low).any(axis=1) | (old.high[same] != at.high).any(axis=1)] = -1
                kept, new = np.flatnonzero(same >= 0), np.flatnonzero(same < 0)
                common, y = np.empty((len(at.leaf), len(rest))), np.empty(len(at.leaf))
                common[kept], y[kept] = self.counts[own][same[kept]][:, rest], self.y[own][same[kept]]
                common[new] = self.grid.common(at.low[new], at.high[new], self.low[rest], self.high[rest])
                y[new] = self.grid.inside(self.table, at.low[new], at.high[new])
                there = np.flatnonzero(at.n > 0)
                self.found[id(at)] = at, common, y, (np.array(at.leaf)[there], at.n[there], (y - common @ value)[there])
            return self.found[id(at)][3]

        return of

    def put(self, k: int, tree: BoxTree) -> None:
        """The tree in the place of tree k, whose residuals have been asked for."""
        own, rest = self.others(k)
        at, common, y, _ = self.found[id(tree.at)]
        value = np.array([tree.leaves[j] for j in at.leaf])
        if at is self.boxes[k]:
            self.value[own] = value
            return
        begin, gone, m = own.start, own.stop - own.start, len(at.leaf)
        to = np.where(rest < begin, rest, rest - gone + m)
        counts = np.empty((len(rest) + m,) * 2)
        counts[np.ix_(to, to)] = self.counts[np.ix_(rest, rest)]
        mine = slice(begin, begin + m)
        counts[mine, to], counts[to, mine], counts[mine, mine] = common, common.T, np.diag(at.n)
        put = lambda a, b: np.concatenate([a[:begin], b, a[own.stop :]])
        self.low, self.high, self.value, self.y = put(self.low, at.low), put(self.high, at.high), put(self.value, value), put(self.y, y)
        self.counts, self.boxes[k] = counts, at

    def left(self, square: float) -> float:
        """The sum of squares that the trees leave of the targets, of which `square` is the sum of squares."""
        return max(square - 2 * float(self.value @ self.y) + float(self.value @ self.counts @ self.value), 0.0)


class BoxGaussian(CountedGaussian):
    """Normal leaves over boxes, whose residuals are a function of them."""

    def stats(self, at: Boxes, resid: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return resid(at)


class SummedChain(CountedChain):
    """The chain over cells, on running sums: `codes` of the cells, n rows each, y the sums of their targets (probit: how many
    are positive), `square` the sum of the targets' squares, `sigma` the guessed deviation of the residuals."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, y: np.ndarray, square: float, sigma: float, cuts: list[np.ndarray], thresholds: list[np.ndarray], s: Settings, seed, probit: bool = False) -> None:
        self.n, self.y, self.square, self.s, self.probit = np.asarray(n, dtype=float), np.asarray(y, dtype=float), square, s, probit
        self.x = self.grid = Grid(codes, self.n, cuts)
        self.rng = np.random.default_rng(seed)
        self.proposer = Proposer(self.grid, thresholds, s, self.rng)
        self.likelihood, self.lam, self.forest = BoxGaussian(s, self.n), 0.0, None
        if probit:
            self.likelihood.f_sigma2 = self.probit_variance()
        else:
            self.lam = max(sigma, 1e-5) ** 2 * chi2_ppf(1 - s.eps_q, s.eps_nu) / s.eps_nu
            self.table = self.grid.running(self.y)

    def start(self, trees: list[Tree] | None = None) -> State:
        p = len(self.grid.cuts)
        return {"sigma2": self.sigma2(None), "s": np.full(p, 1 / p) if self.s.dirichlet else None, "trees": trees or [self.grid.tree({}, {0: 0.0}) for _ in range(self.s.n_trees)]}

    def gathered(self, trees: list[BoxTree]) -> Forest:
        """The forest of the trees over this sweep's targets."""
        table = self.grid.running(self.latent(self.grid.values(trees))) if self.probit else self.table
        if self.forest is None or not self.forest.holds(trees):
            self.forest = Forest(self.grid, trees, table)
        elif self.probit:
            self.forest.summed(table)
        return self.forest

    def noise(self, forest: Forest) -> float:
        if self.probit or self.s.fixed_sigma2 is not None:
            return self.sigma2(None)
        shape, scale = (self.s.eps_nu + float(self.n.sum())) / 2, (self.s.eps_nu * self.lam + forest.left(self.square)) / 2
        return max(scale / self.rng.gamma(shape), 1e-8)

    def redrawn(self, k: int, tree: BoxTree, resid: Callable, sigma2: float) -> BoxTree:
        resid(tree.at)
        out = BoxTree(tree.rules, tree.leaves | self.likelihood.draw(self.rng, tree.at, resid, sigma2), tree.at)
        self.forest.put(k, out)
        return out

    def warm(self, trees: list[BoxTree]) -> State:
        state = self.start(list(trees))
        trees, forest = state["trees"], self.gathered(state["trees"])
        for k, tree in enumerate(trees):
            trees[k] = self.redrawn(k, tree, forest.residuals(k), state["sigma2"])
        return state | {"sigma2": self.noise(forest)}

    def sweep(self, state: State, iteration: int) -> State:
        trees, sigma2, heat = list(state["trees"]), state["sigma2"], self.s.heat(iteration)
        self.proposer.columns = None if state["s"] is None else np.cumsum(state["s"])
        forest = self.gathered(trees)
        for k, tree in enumerate(trees):
            resid = forest.residuals(k)
            new, moved = self.proposer.step(tree, heat, lambda at: self.likelihood.log_marginal(at, resid, sigma2))  # noqa: B023
            if moved or self.s.redraw_always:
                trees[k] = self.redrawn(k, new, resid, sigma2)
        weights = self.split_weights(state["s"], trees)
        return {"sigma2": self.noise(forest), "s": weights, "trees": trees}
